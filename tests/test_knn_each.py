"""The neighbours of all vectors: exact whatever the blocks, in memory that doesn't follow them."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cairn.operators import knn


def brute(m, k, own):
    d = np.sqrt(((m[:, None] - m) ** 2).sum(2))
    out = {}
    for i in range(len(m)):
        order = sorted((x, own[j]) for j, x in enumerate(d[i].tolist()) if own[j] != own[i])
        out[own[i]] = [j for _, j in order[:k]]
    return out


@pytest.mark.parametrize("kind, scale", [("float", 1.0), ("double", 1e-3), ("double", 1e20), ("float", 1e-21)])
def test_any_blocks_and_scales(spark, kind, scale):
    rng = np.random.default_rng(5)
    m = (rng.normal(size=(700, 9)) * scale).astype("f4").astype("f8")
    m[300:330] = m[5]  # ties, more than k
    m[400:500] = m[100:200] * (1 + 1e-6)  # nearer than single precision tells
    m = m.astype("f4").astype("f8")
    names = [f"v{i:04d}" for i in range(len(m))]
    df = spark.createDataFrame(list(zip(names, m.tolist())), f"id string, v array<{kind}>").repartition(3)
    want = brute(m, 6, names)
    for rows in (64, 333, 4096):
        got = {}
        for r in knn.nearest_each(df, df, 6, "id", "v", rows=rows).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["id"])
        assert got == want


def test_fewer_vectors_than_k_and_none(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)] + [(9, [1.0])], "id long, v array<double>")
    assert sorted((r["query"], r["rank"], r["id"]) for r in knn.nearest_each(df, df, 5, "id", "v").collect()) == [(0, 0, 1), (0, 1, 2), (1, 0, 0), (1, 1, 2), (2, 0, 1), (2, 1, 0)]
    assert knn.nearest_each(df.limit(0), df, 5, "id", "v").count() == 0 == knn.nearest_each(df, df.limit(0), 5, "id", "v").count()


def test_memory_of_a_pair_of_blocks():
    rng = np.random.default_rng(6)
    q = rng.normal(size=(4096, 64))
    tracemalloc.start()
    n = knn._Nearest(pa.array(np.arange(4096)), q, 10)
    for a in range(3):
        n.meet(pa.array(np.arange(4096) + 5000 * a), q if a == 0 else rng.normal(size=(4096, 64)))
    found = n.found()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 40960 and peak < 120e6  # a whole product takes 134 MB, and there were several
