"""PII: detected entities get keyed surrogates of their own type, gender, script and format.

Detected are e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards (Luhn) and
other long account numbers, IBANs, US social security numbers, cloud access keys, values assigned to
password, token, secret or key, and names: what follows a title, a known given name before or a known surname after another
capitalised name, what is introduced as a name, and later mentions of these words in the same text.

A surrogate is the successor of the entity in a keyed cycle through all strings of its format
(``permute``): digits stay digits, vowels vowels of their script, upper case stays.  What is permuted is the
entity's value, apart from how it is written: a phone number's national digits, a card's digits, an IPv6 address's groups. The
result is laid into the notation at hand, so that one entity has one surrogate in all its notations.  Check digits
(cards, IBANs) are made anew; given names go to given names of the same gender and script, endings that tell
a gender (a, o, ova, ская, ...) stay; private, link-local, loopback, multicast and reserved addresses stay what they
are.  Collisions are ruled out rather than repaired: the cycle passes over what
another rule could produce (a surname never becomes a listed given name), so the mapping is one to
one over the whole corpus without any exchange between tasks, the same entity is the same everywhere,
and no entity maps to itself unless its format admits only one string.  Every text is checked once more:
``collisions`` counts entities that share a surrogate's value with another one of their type; it is 0.

The key is the caller's, or drawn for the application: who has it can undo the mapping, without it nobody can.

Defined results: null and empty texts come back as they are, with no entities.  Repeated rows get equal results.  A text of n
characters with m entities takes time in proportion to n + m log m.  Numbers without a country code and not
of ten digits are taken as they stand, so that a national and an international notation of them differ.
"""

from __future__ import annotations

import re
import secrets
from bisect import bisect
from functools import lru_cache
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .permute import cycle, permute

_FEMALE = {
    "latin": "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy margaret lisa betty sandra ashley emily donna michelle carol amanda melissa deborah stephanie rebecca laura sharon cynthia kathleen amy angela shirley anna brenda pamela emma nicole helen samantha katherine christine debra rachel carolyn janet catherine maria heather diane ruth julie olivia joyce virginia victoria kelly lauren christina joan evelyn judith megan andrea cheryl hannah jacqueline martha gloria teresa ann sara madison frances kathryn janice jean abigail alice julia judy sophia grace denise amber doris marilyn danielle beverly isabella theresa diana natalie brittany charlotte marie kayla alexis lori priya ananya divya kavita lakshmi neha pooja sunita deepa shreya aisha fatima zainab khadija leila yasmin mei xiu yuki sakura aiko haruka linh thuy ngoc amara adaeze ngozi ingrid ursula heike sabine petra monika claudia birgit renate greta lena katharina chantal brigitte sylvie nathalie isabelle sandrine aurelie camille manon chloe lucia carmen pilar dolores rosario paula elena beatriz",
    "cyrillic": "анна мария елена ольга наталья татьяна ирина светлана екатерина юлия анастасия дарья ксения людмила галина",
    "greek": "μαρία ελένη αικατερίνη βασιλική σοφία αγγελική γεωργία δήμητρα κωνσταντίνα ιωάννα",
}
_MALE = {
    "latin": "james robert john michael david william richard joseph thomas christopher charles daniel matthew anthony mark donald steven andrew paul joshua kenneth kevin brian timothy ronald george jason edward jeffrey ryan jacob nicholas gary eric jonathan stephen larry justin scott brandon benjamin samuel gregory alexander patrick frank raymond jack dennis jerry tyler aaron jose adam nathan henry zachary douglas peter kyle noah ethan jeremy christian walter keith austin roger terry sean gerald carl dylan harold jordan jesse bryan lawrence arthur gabriel bruce logan billy joe alan juan elijah willie albert wayne randy mason vincent liam roy bobby caleb bradley russell rahul amit arjun vijay sanjay ravi anil rajesh suresh vikram mohammed muhammad ahmed ali omar hassan ibrahim yusuf khalid wei jun hiroshi kenji takeshi haruto minh tuan kwame chidi emeka lucas hans klaus jürgen wolfgang dieter helmut stefan uwe pierre michel philippe laurent nicolas julien guillaume antoine thierry carlos manuel antonio javier fernando alejandro miguel pablo sergio diego",
    "cyrillic": "иван александр сергей дмитрий андрей алексей михаил владимир николай павел юрий константин виктор олег игорь",
    "greek": "γεώργιος ιωάννης κωνσταντίνος δημήτριος νικόλαος παναγιώτης βασίλειος χρήστος αθανάσιος μιχαήλ",
}
GIVEN = {(g, s): sorted(set(names.split())) for g, of in (("f", _FEMALE), ("m", _MALE)) for s, names in of.items()}
OF_GIVEN: dict[str, tuple[str, str]] = {}
for _k, _names in GIVEN.items():
    for _n in _names:
        OF_GIVEN.setdefault(_n, _k)
GIVEN = {k: [n for n in names if OF_GIVEN[n] == k] for k, names in GIVEN.items()}
_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĪĮŁŃŇŌŐŘŚŠŞŤŪŮŰŹŻŽΑ-ΩА-ЯЁІЇЄ"
_LOWER = "a-zß-öø-ÿāăąćčďđēėęěğīįłńňōőřśšşťūůűźżžα-ωάέήίόύώа-яёіїє"
#: Surnames that are no common words.
SURNAMES = frozenset("patel singh sharma kumar gupta khan nguyen tran pham chen wang zhang liu yamamoto tanaka suzuki garcia martinez rodriguez hernandez lopez gonzalez perez sanchez ramirez torres smith johnson williams jones davis wilson anderson thompson robinson harris lewis walker o'brien o'connor murphy kelly ryan müller mueller schmidt schneider fischer weber meyer becker hoffmann dubois lefebvre moreau laurent rossi russo ferrari silva santos oliveira ferreira okafor adeyemi mensah kowalski nowak novak ivanov ivanova petrov petrova smirnov smirnova иванов иванова петров петрова смирнов смирнова παπαδόπουλος παπαδοπούλου".split())
#: Capitalised words that begin sentences or address people, but name nobody.
_COMMON = frozenset("the a an this that these those and or but if in on at of for from to by with as is are was were be it he she we they you i my his her our their dear hello hi sir madam team customer client patient all everyone us mr mrs ms miss dr prof herr frau monsieur madame mme señor señora der die das ein eine und oder le la les un une des et ou el los las una y o de du del von van no not when while after before since our your".split())
_PART = rf"(?:[{_UPPER}]['’])?[{_UPPER}][{_LOWER}]+(?:[{_UPPER}][{_LOWER}]+)?"
_NAME = rf"{_PART}(?:-{_PART})*"
TITLE = re.compile(rf"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra|Don|Doña|г-н|г-жа)\b\.?[ ]+({_NAME}(?:[ ]+{_NAME}){{0,2}})")
#: Any two capitalised words; the first must be a listed given name, or the second a listed surname.
FULL = re.compile(rf"(?<!\w)({_NAME})((?:[ ]+(?:[{_UPPER}]\.|de|van|von|der|la|del))*[ ]+)({_NAME})(?!\w)")
CUE = re.compile(rf"(?<!\w)(?i:my name is|name[ ]?:|(?:sincerely|regards),)\s+({_NAME}(?:[ ]+{_NAME}){{1,2}})(?!\w)")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_GENDER = re.compile(r"(?:ова|ева|ёва|ина|ская|ская|ский|цкий|цкая|ова|ов|ев|ёв|ин|ий|ая|а|я|ou|ova|eva|ina|a|o)$")
_BEFORE, _AFTER = r"(?<![\w.@-])", r"(?![\w@-]|\.\w)"
EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w-])")
SECRET = re.compile(r"(?i)(?<![A-Za-z])((?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?)([A-Za-z0-9_+/.~-]{6,}={0,2})")
CLOUD = re.compile(r"(?<![A-Za-z0-9])(AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|sk-(?:proj-|live-|test-)?|[sr]k_(?:live|test)_|xox[abprs]-)([A-Za-z0-9](?:[A-Za-z0-9_-]*[A-Za-z0-9])?)(?![A-Za-z0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(_BEFORE + r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}" + _AFTER)
IPV4 = re.compile(_BEFORE + r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w@-]|\.\d)")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![\w:])")
CARD = re.compile(_BEFORE + r"\d(?:[ -]?\d){11,18}" + _AFTER)
PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,5}){1,4}(?![\w@-]|\.\d)")
BARE_PHONE = re.compile(r"(?<![\w.+-])\+\d{8,15}(?![\w@-]|\.\d)")
DIGITS = re.compile(r"\d.{0,5}\d")
WORDS = re.compile(r"[^\W\d_]+|\d+")
#: Country codes of one and two digits; all others have three.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def luhn(digits: str) -> int:
    """The sum that is 0 modulo 10 for a valid number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10


def _case(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1] != like[:1].lower() else word


def word(key: bytes, text: str) -> str:
    """Of a part of a name, wherever it stands: the same for Smith, SMITH and smith@."""
    low = text.lower()
    if (k := OF_GIVEN.get(low)) is not None:
        names = GIVEN[k]
        return _case(text, names[cycle(key, "given|" + "|".join(k), len(names)).after(names.index(low))])
    ending = _ending(low)
    return permute(key, "name", text, allowed=lambda x: x not in OF_GIVEN and _ending(x) == ending, tail=len(ending))


def _ending(low: str) -> str:
    """What tells a name's gender and is kept, where two letters at least go before it."""
    m = _GENDER.search(low, 2)
    return m[0] if m else ""


def email(key: bytes, text: str) -> str:
    local, _, host = text.rpartition("@")
    labels = host.split(".")
    keep = {"example", "test", "invalid", "localhost"}
    new = [label if i == len(labels) - 1 or label.lower() in keep or (len(label) <= 3 and i == len(labels) - 2 and len(labels) > 2) else WORDS.sub(lambda m: _part(key, m[0]), label) for i, label in enumerate(labels)]
    return WORDS.sub(lambda m: _part(key, m[0]), local) + "@" + ".".join(new)


def _part(key: bytes, text: str) -> str:
    return permute(key, "digits", text) if text.isdigit() else word(key, text)


def ipv4(key: bytes, text: str) -> str:
    octets = [int(x) for x in text.split(".")]

    def kind(o: list[int]) -> str:
        if o[0] in (0, 127):
            return str(o[0])
        if o[0] >= 224:
            return "multicast" if o[0] < 240 else "reserved"
        return "10" if o[0] == 10 else "172" if o[0] == 172 and 16 <= o[1] < 32 else "192" if o[:2] == [192, 168] else "link" if o[:2] == [169, 254] else "public"

    own = kind(octets)
    fixed = {"0": 1, "127": 1, "10": 1, "192": 2, "172": 1, "link": 2}.get(own, 0)
    ring = cycle(key, "ipv4|" + own, 256 ** (4 - fixed))
    x = int.from_bytes(bytes(octets[fixed:]))
    while True:
        x = ring.after(x)
        new = octets[:fixed] + list(x.to_bytes(4 - fixed))
        if kind(new) == own:
            return ".".join(map(str, new))


def card(key: bytes, text: str) -> str:
    """The first digit stays, the last checks the others if it did before."""
    digits = re.sub(r"\D", "", text)
    at = [i for i, c in enumerate(text) if c.isdigit()]
    valid = luhn(digits) == 0
    body = digits[:-1] if valid else digits
    new = permute(key, "card" if valid else "account", body, [None] + ["0123456789"] * (len(body) - 1))
    if valid:
        new += str(-luhn(new + "0") % 10)
    out = list(text)
    for i, d in zip(at, new):
        out[i] = d
    return "".join(out)


def iban(key: bytes, text: str) -> str:
    flat = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    valid = number(flat[4:] + flat[:4]) % 97 == 1
    body = permute(key, "iban|" + flat[:2], flat[4:], ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" for c in flat[4:]])
    check = f"{98 - number(body + flat[:2] + '00') % 97:02d}" if valid else flat[2:4]
    new, out = iter(flat[:2] + check + body), []
    for c in text:
        out.append(c if c == " " else next(new))
    return "".join(out)


def ssn(key: bytes, text: str) -> str:
    return permute(key, "ssn", text, ["0123456789" if c.isdigit() else None for c in text], lambda x: SSN.fullmatch(x) is not None)


def _dialled(text: str) -> tuple[str, list[int]]:
    """A number's country code, and where its national digits stand."""
    at = [i for i, c in enumerate(text) if c.isdigit()]
    digits = "".join(text[i] for i in at)
    if text.startswith("+"):
        n = next((k for k in (1, 2) if digits[:k] in _CODES), 3)
        trunk = re.search(r"\((0)\)", text)  # a zero that is only dialled inside the country
        return digits[:n], [i for i in at[n:] if not trunk or i != trunk.start(1)]
    if len(digits) == 11 and digits[0] == "1":
        return "1", at[1:]
    return "1" if len(digits) == 10 and digits[0] != "0" else "", at


def phone(key: bytes, text: str) -> str:
    """The country code stays, a fictional 555 stays, and what begins with 0 or 1 still does."""
    country, at = _dialled(text)
    digits = "".join(text[i] for i in at)
    alphabets: list[str | None] = []
    american = country == "1" and len(digits) == 10
    for i, c in enumerate(digits):
        if american and 3 <= i < 6 and digits[3:6] == "555":
            alphabets.append(None)
        elif i == 0 or american and i == 3:
            alphabets.append("01" if c in "01" else "23456789")
        else:
            alphabets.append("0123456789")

    def fictional(x: str) -> bool:
        return american and x[3:6] == "555"

    own = fictional(digits)
    new = permute(key, "phone|" + country, digits, alphabets, lambda x: fictional(x) == own)
    out = list(text)
    for i, d in zip(at, new):
        out[i] = d
    return "".join(out)


def secret(key: bytes, text: str) -> str:
    hexa = re.fullmatch(r"[0-9a-fA-F]+", text) is not None
    return permute(key, "hex", text, ["0123456789abcdef"] * len(text)) if hexa else permute(key, "secret", text, ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.isascii() and c.isalpha() else None for c in text])


def cloud(key: bytes, text: str) -> str:
    head, body = CLOUD.match(text).groups()
    if body.upper() == body:
        return head + permute(key, "cloud", body.lower(), ["0123456789abcdefghijklmnopqrstuvwxyz" if c.isalnum() else None for c in body]).upper()
    return head + permute(key, "cloud", body, ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.isalpha() else None for c in body])


def ipv6(key: bytes, text: str) -> str:
    """Groups of zeros stay, as does what tells an address's scope; other groups keep their length."""
    groups = [f"{int.from_bytes(IPv6Address(text).packed[i : i + 2]):x}" for i in range(0, 16, 2)]
    first = int(groups[0], 16)
    # Link-local and multicast: the first group; private: its first two digits; global: which of two blocks.
    fixed = 4 if first >> 6 == 0xFE80 >> 6 or first >> 8 == 0xFF else 2 if first >> 9 == 0xFC >> 1 else 1
    alphabets: list[str | None] = []
    for k, g in enumerate(groups):
        alphabets += [None] * (k > 0) + [None if g == "0" or not k and i < fixed and len(g) == 4 else "0123456789abcdef"[not i :] for i in range(len(g))]
    new = permute(key, "ipv6", ":".join(groups), alphabets).split(":")
    if "::" in text:
        out = str(IPv6Address(":".join(new)))
    else:
        out = ":".join(n.zfill(len(o)) for n, o in zip(new, text.split(":")))
    return out.upper() if text.upper() == text and text.lower() != text else out


def _is_ipv6(text: str) -> bool:
    if not any(map(str.isdigit, text)):  # a::b in a program
        return False
    try:
        return IPv6Address(text).packed[:2] != b"\0\0"
    except ValueError:
        return False


def value(kind: str, text: str) -> str:
    """What an entity is, apart from its notation."""
    if kind == "phone":
        country, at = _dialled(text)
        return country + "|" + "".join(text[i] for i in at)
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ipv6":
        return str(IPv6Address(text))
    if kind == "ipv4":
        return ".".join(str(int(x)) for x in text.split("."))
    return text.lower() if kind in ("name", "email") else text


MAKERS = {"email": email, "phone": phone, "ipv4": ipv4, "ipv6": ipv6, "card": card, "iban": iban, "ssn": ssn, "secret": secret, "cloud": cloud}


@lru_cache(1 << 16)
def surrogate(key: bytes, kind: str, text: str) -> str:
    if kind == "name":
        return re.sub(r"[^\W\d_]+", lambda m: word(key, m[0]), text)
    return MAKERS[kind](key, text)


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order, without overlap; the earlier rules win."""
    found: list[tuple[int, int, str]] = []

    def add(kind: str, pattern: re.Pattern, group: int = 0, ok=lambda _: True) -> None:
        for m in pattern.finditer(text):
            if ok(m[group]):
                found.append((m.start(group), m.end(group), kind))

    if "@" in text:
        add("email", EMAIL)
    if "=" in text or ":" in text:
        add("secret", SECRET, 2)
    add("cloud", CLOUD, ok=lambda x: len(x) >= 20)
    if DIGITS.search(text):
        add("iban", IBAN, ok=lambda x: 15 <= len(x.replace(" ", "")) <= 34)
        add("ssn", SSN)
        add("ipv4", IPV4)
        if ":" in text:
            add("ipv6", IPV6, ok=_is_ipv6)
        add("phone", BARE_PHONE)
        add("phone", PHONE, ok=lambda x: x[0] in "+(" and 8 <= sum(map(str.isdigit, x)) <= 15 or re.fullmatch(r"\d{3}[ .-]\d{3}[ .-]\d{4}", x) is not None)
        add("card", CARD, ok=lambda x: len(set(re.sub(r"\D", "", x))) > 1)
    names: set[str] = set()
    for m in TITLE.finditer(text):
        found.append((*m.span(1), "name"))
        names.update(m[1].split())
    for m in CUE.finditer(text):
        if not _COMMON & set(m[1].lower().split()):
            found.append((*m.span(1), "name"))
            names.update(m[1].split())
    at = 0
    while m := FULL.search(text, at):
        low = m[1].lower()
        if low.split("-")[0] in OF_GIVEN or m[3].lower().replace("’", "'") in SURNAMES and low not in _COMMON:
            found.append((*m.span(1), "name"))
            found.append((*m.span(3), "name"))
            names.update((m[1], m[3]))
            at = m.end(3)
        else:
            at = m.end(1)
    if names:
        names |= {x.upper() for x in names}
        for m in _TOKEN.finditer(text):
            if (token := m[0]) in names or (token := re.sub(r"['’][sS]$", "", token)) in names:
                found.append((m.start(), m.start() + len(token), "name"))
    starts: list[int] = []
    out: list[tuple[int, int, str]] = []
    for a, b, kind in found:
        k = bisect(starts, a)
        if (not k or out[k - 1][1] <= a) and (k == len(out) or out[k][0] >= b):
            starts.insert(k, a)
            out.insert(k, (a, b, kind))
    return out


def replace(key: bytes, text: str) -> tuple[str, int, int]:
    """The text with surrogates, the number of entities, and of collisions among them."""
    spans = detect(text)
    if not spans:
        return text, 0, 0
    out, at, origin, bad = [], 0, {}, 0
    for a, b, kind in spans:
        new = surrogate(key, kind, text[a:b])
        old = value(kind, text[a:b])
        bad += origin.setdefault((kind, value(kind, new)), old) != old
        out += (text[at:a], new)
        at = b
    return "".join(out) + text[at:], len(spans), bad


def key_of(spark: SparkSession) -> bytes:
    """The key set as ``spark.cairn.pii.key``.

    Where it is unset, a local session, as in tests, has a public one; on a cluster a secret one is drawn at random, once for
    an application, so that all it writes agrees.  It is kept nowhere else: to have the same surrogates in a later run, set a key.
    """
    if own := spark.conf.get("spark.cairn.pii.key", None):
        return own.encode()
    context = spark.sparkContext
    if context.master.startswith("local"):
        return b"public, for tests"
    if getattr(context, "_cairn_pii_key", None) is None:
        context._cairn_pii_key = secrets.token_bytes(32)
    return context._cairn_pii_key


def surrogate_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, the text with surrogates, ``entities`` and ``collisions``."""

    def run(batches):
        for batch in batches:
            done = [(None, 0, 0) if t is None else replace(key, t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32())], [id_col, "text", "entities", "collisions"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, text string, entities int, collisions int")


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its texts replaced and ``chars_col`` counted anew; other columns as they are."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            new = pa.array([None if t is None else replace(key, t)[0] for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    out = docs.mapInArrow(run, docs.schema)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col)).cast(docs.schema[chars_col].dataType))
    return out.select(docs.columns)
