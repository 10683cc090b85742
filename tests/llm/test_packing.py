import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import packing as K


def best_fit_decreasing(sizes, capacity):
    """One piece after the other into the smallest gap that holds it: the contexts' contents."""
    boxes = []
    for n in sorted(sizes, reverse=True):
        fit = min((b for b in boxes if capacity - sum(b) >= n), key=lambda b: capacity - sum(b), default=None)
        if fit is None:
            boxes.append(fit := [])
        fit.append(n)
    return boxes


@pytest.mark.parametrize("seed", range(30))
def test_rounds_are_sequential_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    sizes = [min(capacity, 1 + int(rng.paretovariate(rng.choice([0.5, 1.1])) * rng.choice([1, 5]))) for _ in range(rng.randrange(1, 400))]
    counts = {n: sizes.count(n) for n in set(sizes)}
    boxes = defaultdict(list)
    slots = K.fit(counts, capacity)
    for n, (low, first, each, place) in slots.items():
        for r in range(counts[n]):
            at = np.searchsorted(low, r, side="right") - 1
            boxes[int(first[at] + (r - low[at]) // each[at])].append((int(place[at] + (r - low[at]) % each[at] * n), n))
    for spans in boxes.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at <= capacity
    want = best_fit_decreasing(sizes, capacity)
    assert sorted(boxes) == list(range(len(want)))
    assert sorted(sum(n for _, n in b) for b in boxes.values()) == sorted(map(sum, want))
    assert sum(len(x[0]) for x in slots.values()) <= 3 * capacity * (2 * capacity) ** 0.5


def test_slots_do_not_grow_with_the_input():
    rng = random.Random(1)
    base = {n: 1 + int(40_000 / n * rng.random()) for n in range(1, 2049)}
    few, many = (sum(len(x[0]) for x in K.fit({n: c * k for n, c in base.items()}, 2048).values()) for k in (1, 1_000_000))
    assert many < 3 * few and many < 3 * 2048 * 64


def check(rows, out, capacity):
    want = []
    for i, t in rows:
        n = len((t or "").split())
        want += [(i, 0, 0)] if n == 0 else [(i, k, min(capacity, n - k * capacity)) for k in range(-(-n // capacity))]
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["doc_id"], r["piece"], r["length"]) for r in out), key=lambda x: (x[0] is None, x[0] or 0, *x[1:])) == sorted(want, key=lambda x: (x[0] is None, x[0] or 0, *x[1:]))
    boxes = defaultdict(list)
    for r in out:
        if r["length"] == 0:
            assert r["context"] is None and r["start"] == 0
        else:
            boxes[r["context"]].append((r["start"], r["length"]))
    for spans in boxes.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at <= capacity
    return len(boxes), sum(n for *_, n in want)


def test_every_word_is_packed_once_and_tightly(spark, docs_of):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 20))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "w " * 128), (1004, "w " * 1000), (None, "a b c"), (None, "a b c"), (5, "dup"), (5, "dup")]
    out = K.pack(docs_of(rows), 128).collect()
    boxes, words = check(rows, out, 128)
    sizes = [min(128, len((t or "").split()) - k * 128) for _, t in rows for k in range(-(-len((t or "").split()) // 128))]
    assert boxes == len(best_fit_decreasing(sizes, 128)) >= -(-words // 128)


def test_partitions_make_no_difference(spark, docs_of):
    rng = random.Random(5)
    rows = [(rng.randrange(200) if i % 9 else None, " ".join(["w"] * int(rng.paretovariate(0.9) * 4))) for i in range(500)]
    docs = docs_of(rows)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    one, seven = (sorted(map(key, K.pack(docs.repartition(n), 64).collect())) for n in (1, 7))
    assert one == seven and len({r[0] for r in one}) > 20


def test_string_ids(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, None)]).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert sorted(map(tuple, K.pack(docs, 4).collect()), key=lambda r: r[2]) == [(0, 0, "1", 0, 2), (None, 0, "2", 0, 0)]


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")], [(1, "a")], [(i, "w " * 64) for i in range(9)], [(i, "w " * 128) for i in range(5)]])
def test_small_tables(spark, docs_of, rows):
    check(rows, K.pack(docs_of(rows), 128).collect(), 128)
