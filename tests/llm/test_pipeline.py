import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from cairn.llm import jaccard, packing, pii, repetition, toxicity
from cairn.llm import queries as Q


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    """A corpus with planted cases: repetitive 1000s, toxic 2000s, copies 3000s."""
    from conftest import texts
    from test_toxicity import corpus

    values, label = corpus(200)
    rows = [(i, t) for i, t in enumerate(values)]
    rows += [(1000 + i, f"buy now cheap {i} " * 60) for i in range(5)]
    base = texts(1, seed=70, low=100, high=101)[0]
    rows += [(3000 + i, base) for i in range(6)] + [(3010, base + " one more word")]
    rows += [(4000, "Write to jane.roe@example.org soon"), (4001, None), (4002, "")]
    d = tmp_path_factory.mktemp("sf")
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64())}), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(200), pa.int64()), "quality": pa.array([1] * 200), "toxic": pa.array(label)}), d / "labels.parquet")
    return str(d), label


def test_stages_one_by_one(spark, sf):
    d, label = sf
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        seen[name] = out.collect()
        if name != "packing":
            assert out.columns == columns
            docs = spark.createDataFrame(seen[name], docs.schema)
    ids = {n: {r["doc_id"] for r in rows} for n, rows in seen.items()}
    toxic = {i for i, y in enumerate(label) if y}
    assert not ids["quality"] & set(range(1000, 1005)) and set(range(200)) - toxic <= ids["quality"]
    assert ids["toxicity"] == ids["quality"] - toxic
    assert ids["near_duplicates"] == ids["toxicity"] - {3001, 3002, 3003, 3004, 3005, 3010}
    assert ids["pii"] == ids["near_duplicates"] and not any("jane" in (r["text"] or "") for r in seen["pii"])
    assert ids["packing"] == ids["pii"]


def test_run_equals_the_stages(spark, sf):
    d, _ = sf
    rows = corpus_pipeline.run(spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
    want = {(r["doc_id"], i, n) for r in docs.collect() for i, n in enumerate([min(2048, len((r["text"] or "").split()) - k) for k in range(0, max(1, len((r["text"] or "").split())), 2048)])}
    assert {(r["doc_id"], r["piece"], r["length"]) for r in rows} == want


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (None, ""), (1, None)]])
def test_empty_and_null_only_tables(spark, docs_of, tmp_path, rows):
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())}), tmp_path / "labels.parquet")
    docs = docs_of(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert sorted((r["doc_id"] or 0, r["context"], r["length"]) for r in out.collect()) == sorted((i or 0, None, 0) for i, _ in rows)
        else:
            assert out.columns == docs.columns and sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, rows))


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in Q.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(Q.ORACLES) <= set(Q.QUERIES)


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    shown = lambda rows: sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    sql = con.sql(Q.ORACLES[name])
    order = [sql.columns.index(c) for c in columns]
    assert shown(got) == shown([tuple(r[i] for i in order) for r in sql.fetchall()])
