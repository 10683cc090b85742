import re
from collections import Counter

import pytest

from cairn.llm import repetition as R


def brute(text):
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text)
    total = max(1, sum(map(len, words)))
    out = []
    for n in R.TOP:
        c = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        out.append(max([k * sum(map(len, g)) for g, k in c.items() if k >= R.TOP_TIMES], default=0) / total)
    for n in R.COVERED:
        seen, inside = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in seen:
                inside.update(range(i, i + n))
            seen.add(g)
        out.append(sum(len(words[i]) for i in inside) / total)
    lines = [x for x in (y.strip(" \t\n\x0b\f\r") for y in text.split("\n")) if x]
    seen, again = set(), []
    for x in lines:
        if x in seen:
            again.append(x)
        seen.add(x)
    return [*out, len(again) / max(1, len(lines)), sum(map(len, again)) / max(1, sum(map(len, lines)))]


def cases():
    from conftest import texts

    plain = texts(20, low=1, high=80, vocabulary=15)
    return [*plain, "a b c d e f g h i j k " * 30, "same line\n" * 9 + "other", "é ü ß\n é ü ß \n\n", "", " ", "x", "p q\n" + plain[0] + "\np q"]


def test_figures_equal_brute_force():
    got = R.figures(cases())
    for text, row in zip(cases(), got):
        assert row.tolist() == pytest.approx(brute(text), abs=1e-9), text[:60]


def test_texts_of_one_batch_do_not_meet():
    both = R.figures(["a b c d e f", "a b c d e f"])
    assert not both.any()


def test_report_and_filter(spark, docs_of, odd_rows):
    rows = [*odd_rows, (20, "spam and eggs for you today " * 50), (21, "a text that says each thing once and then ends")]
    docs = docs_of(rows)
    report = R.repetition_report(docs).collect()
    assert len(report) == len(rows)
    rejected = {r["doc_id"] for r in report if r["rejected"]}
    assert 20 in rejected and not rejected & {1, 2, 3, 4, 5, 21}
    kept = R.drop_repetitive(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r["rejected"] for r in report)
    assert R.drop_repetitive(docs_of([])).count() == 0 and R.repetition_report(docs_of([])).count() == 0


def test_a_frame_of_equal_lines_is_kept():
    body = " ".join(f"w{i}" for i in range(200))
    assert not (R.figures([f"Menu home about\n{body}\nMenu home about"]) > R.LIMITS).any()
