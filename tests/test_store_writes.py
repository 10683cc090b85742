"""How often a store's writes move their rows, and that they hold the right ones whichever way they take."""

import os

import pytest

from cairn import model
from cairn.operators import store
from cairn.operators.store import IndexStore, Snapshots
from cairn.plans import fixtures

SMALL = "/root/testdata/sf0.001"


def chunks(spark, rows):
    full = [(i, "p", path, "x", "function", i, None, None, 1, 1, None, text, n) for n, (i, path, text) in enumerate(rows)]
    return spark.createDataFrame(full, model.CHUNKS)


def edges(spark, rows):
    return spark.createDataFrame([(i, "p", a, path, b, "CALLS", meta) for i, a, path, b, meta in rows], model.EDGES)


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that is written, by table."""
    seen, real = [], Snapshots.write

    def write(self, name, df, moved=True):
        seen.append((name, moved, df._jdf.queryExecution().executedPlan().toString()))
        return real(self, name, df, moved)

    monkeypatch.setattr(Snapshots, "write", write)
    return seen


def test_first_edges_are_written_once(spark, tmp_path, plans):
    s = IndexStore(Snapshots(spark, str(tmp_path), 4))
    s.upsert_edges(edges(spark, [(f"e{i}", f"a{i}", f"f{i % 3}", f"b{i % 5}", "{}") for i in range(40)]))
    assert [(n, moved) for n, moved, _ in plans] == [("edges", True)] and "Exchange" not in plans[0][2]
    assert s.count_edges() == 40 and len(os.listdir(tmp_path / "edges")) == 1


def test_deletes_shuffle_nothing(spark, tmp_path, plans):
    s = IndexStore(Snapshots(spark, str(tmp_path), 2))
    s.upsert(chunks(spark, [(f"c{i}", f"f{i % 4}", "some words") for i in range(40)]))
    s.upsert_edges(edges(spark, [(f"e{i}", f"c{i}", f"f{i % 4}", f"c{i % 7}" if i else None, "{}") for i in range(40)]))
    plans.clear()
    s.delete(["c3", "c11", "nobody", None])
    s.delete_by_file("f2")
    s.delete_edges_by_file("f1")
    s.delete_edges_by_target(["c5"])
    assert {n for n, *_ in plans} == {"chunks", "vectors", "postings", "lengths", "edges"}
    assert not any(moved or "Exchange hashpartitioning" in plan or "SortMergeJoin" in plan for _, moved, plan in plans)
    left = {f"c{i}" for i in range(40) if i not in (3, 11) and i % 4 != 2}
    assert {r[0] for r in s.chunks.select("id").collect()} == {r[0] for r in s.snapshots.table("postings").select("chunk_id").collect()} == left
    assert {r[0] for r in s.edges.select("id").collect()} == {f"e{i}" for i in range(40) if i % 4 != 1 and (i == 0 or i % 7 != 5)}


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_upserts_with_repeated_ids_and_moved_rows(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(store, "BROADCAST_ROWS", broadcast)
    s = IndexStore(Snapshots(spark, str(tmp_path), 3))
    s.upsert(chunks(spark, [("a", "f1", "one"), ("b", "f1", "two"), ("a", "f9", "one again")]))
    s.upsert(chunks(spark, [("b", "f2", "three"), ("c", "f3", "four"), ("c", "f3", "five")]))
    assert sorted(map(tuple, s.chunks.select("id", "file_path", "search_content").collect())) == [("a", "f9", "one again"), ("b", "f2", "three"), ("c", "f3", "five")]
    assert sorted(map(tuple, s.snapshots.table("postings").select("chunk_id", "term").collect())) == [("a", "again"), ("a", "one"), ("b", "three"), ("c", "five")]
    s.upsert_edges(edges(spark, [("e", "a", "f1", "b", "1"), ("e", "a", "f1", "b", "1"), ("d", "b", "f1", "a", "1")]))
    s.upsert_edges(edges(spark, [("e", "a", "f5", "b", "2")]))
    assert sorted(map(tuple, s.edges.select("id", "source_file_path", "metadata").collect())) == [("d", "f1", "1"), ("e", "f5", "2")]
    s.upsert_edges(edges(spark, []))
    s.upsert(chunks(spark, []))
    assert s.count_edges() == 2 and s.count() == 3


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_keys_are_made_distinct_before_they_are_text(spark):
    plan = fixtures.edges(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(l_orderkey" in plan and plan.count("Exchange hashpartitioning") == 1
