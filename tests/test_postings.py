"""Postings made row by row."""

import random

from cairn.operators import bm25


def test_postings_need_no_shuffle(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"c{i}", " ".join(rng.choices(["b", "a", "ünï", "x1", "the"], k=rng.randint(0, 40))) if i % 7 else [None, "", "..."][i // 7 % 3], i) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, search_content string, of long").coalesce(2)
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(bm25, "WORDS", most)
        postings, lengths = bm25.build_postings(df, keep=("of",))
        assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["chunk_id"], r["term"], r["tf"], tuple(r["positions"]), r["of"]) for r in postings.collect())
        want = []
        for i, text, of in rows:
            words = [w for w in (text or "").split() if w != "..."]
            want += [(i, w, words.count(w), tuple(k for k, x in enumerate(words) if x == w), of) for w in set(words)]
        assert got == sorted(want)
        assert {r["chunk_id"]: r["dl"] for r in lengths.collect()} == {i: len([w for w in (t or "").split() if w != "..."]) for i, t, _ in rows}
