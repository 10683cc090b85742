import pytest

from cairn.functions import text as T
from cairn.sources import ignore, settings


@pytest.mark.parametrize("word,want", [("getUserById", "getUserById get user by id"), ("parse_json", "parse_json parse json"), ("HTTPSClient", "HTTPSClient https client"), ("plain", "plain"), ("aB2", "aB2 a b2"), ("x", "x"), ("foo_Foo", "foo_Foo")])
def test_identifiers(spark, word, want):
    assert T.expand_identifiers_text(word) == want
    terms = spark.createDataFrame([(word,)], "t string").select(T.identifier_terms("t").alias("x")).first()["x"]
    assert terms == [w for w in want.split(" ") if len(w) > 1 or len(want.split(" ")) > 1][-len(terms) :]


def test_query_phrases():
    assert T.query_phrases('foo "bar baz*" foo_bar x:y --') == [("foo",), ("bar",), ("baz",), ("foo", "bar"), ("xy",)]
    assert T.query_phrases("") == [] == T.query_phrases("-- **")


def test_truncation(spark):
    text = "".join(chr(97 + i % 26) for i in range(500))
    df = spark.createDataFrame([(text,), ("short",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(T.truncate_middle("t", 100)).collect()]
    assert got == [T.truncate_text(text, 100), "short", "", None] and len(got[0]) == 100
    assert [r[0] for r in df.select(T.split_fixed("t", 200)).collect()][:3] == [T.pieces(text, 200), ["short"], [""]]
    assert len(T.head_and_tail("x" * 5000)) < 2000 and T.head_and_tail("abc") == "abc"


def test_capitalise_and_location(spark):
    row = spark.sql("select 'state_variable' a, 3 b, 9 c").select(T.capitalise("a"), T.location("a", "b", "c")).first()
    assert tuple(row) == ("State_variable", "state_variable:3-9")


@pytest.mark.parametrize("pattern,path,hit", [("src/*.ts", "src/a/b.ts", True), ("src/*.ts", "src/a.tsx", False), ("a?.ts", "a?.ts", True), ("a?.ts", "ab.ts", False), ("a.b", "axb", False)])
def test_path_globs(spark, pattern, path, hit):
    from cairn.operators.filters import by_path

    assert spark.createDataFrame([(path,)], "file_path string").where(by_path(pattern)).count() == hit


@pytest.mark.parametrize("path,out", [(".env", True), ("a/.git/x", True), ("node_modules/x/y.js", True), ("src/node_modules/z.ts", True), ("src/index.ts", False), ("vite.config.ts", True), ("a/tsconfig.base.json", True), ("go.mod", True), ("x.min.js", True), ("docs/readme.md", False), ("requirements-dev.txt", True)])
def test_default_excludes(path, out):
    import re

    assert bool(re.search(ignore.any_of(ignore.default_excludes()), path)) == out


def test_ignore_rules():
    assert ignore.ignore_rules("# c\n\n!keep\ndist/\n/root.txt\na/b\n*.log\n*.log", "") == ["**/dist/**", "root.txt", "a/b", "**/*.log"]
    assert ignore.ignore_rules("dist/\n/x", "pkg") == ["pkg/**/dist/**", "pkg/x"]


def test_comments_and_aliases(tmp_path):
    import json

    assert json.loads(settings.strip_comments('{"a": "http://x", /* c */ "b": [1, 2,], // d\n}')) == {"a": "http://x", "b": [1, 2]}
    (tmp_path / "base.json").write_text('{"compilerOptions": {"paths": {"~old": ["old.ts"], "@u/*": ["wrong/*"]}}}')
    (tmp_path / "tsconfig.json").write_text('{"extends": "./base", // c\n"compilerOptions": {"baseUrl": ".", "paths": {"@u/*": ["src/u/*", "other/*"],}}}')
    assert settings.path_aliases(str(tmp_path)) == [("@u/*", ["src/u/*", "other/*"]), ("~old", ["old.ts"])]
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "cairn.toml").write_text('[embedding]\nprovider = "hash"\n')
    assert settings.find_settings(str(tmp_path / "a" / "b"))["embedding"]["provider"] == "hash"


def test_only_compound_identifiers_are_taken_apart(monkeypatch):
    import random
    import re

    real, asked = T.identifier_parts, []

    def each(text):
        spread = lambda m: m[0] if len(p := real(m[0])) < 2 else " ".join((m[0], *p))
        return re.sub(r"[A-Za-z][A-Za-z0-9_]*[A-Za-z0-9]", spread, text)

    rng = random.Random(8)
    for n in range(20_000):
        text = "".join(rng.choices(["a", "b", "B", "C", "_", "9", " ", "é", "É", ".", "aB", "foo", "HTTPs", "x_y"], k=rng.randint(0, 12)))
        assert T.expand_identifiers_text(text) == each(text), text
    monkeypatch.setattr(T, "identifier_parts", lambda t: (asked.append(t), real(t))[1])
    assert T.expand_identifiers_text("Plain words of Prose, then getUser and a_b; HTTP 404.") == "Plain words of Prose, then getUser get user and a_b a b; HTTP 404."
    assert asked == ["getUser", "a_b"]
