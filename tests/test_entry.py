import json
import os

import pytest

import __spark_entry__ as entry
from cairn.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def test_catalogue_is_registered():
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(catalogue.ORACLES) <= set(entry.oracle_sql())
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"html_elements", "chunk_documents"}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    sql = duck.sql(catalogue.ORACLES[name])
    assert sorted(sql.columns) == columns
    order = [sql.columns.index(c) for c in columns]
    shown = lambda rows: sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert shown([tuple(r[c] for c in columns) for r in df.collect()]) == shown([tuple(r[i] for i in order) for r in sql.fetchall()])


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10


def test_filters_reach_the_scan(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    plan = catalogue.QUERIES["language_filter"](spark, SMALL)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(lang" in plan and "text" not in plan.split("ReadSchema")[-1]


def test_command_line(spark, tmp_path, capsys):
    from cairn.cli import run

    root = tmp_path / "p"
    root.mkdir()
    (root / "a.py").write_text("def authenticate(user):\n    return user\n")
    common = ["--dir", str(root), "--format", "json"]
    assert run([*common, "index"], spark) == 0
    assert run([*common, "search", "authenticate"], spark) == 0
    out = capsys.readouterr().out.strip().split("\n")
    assert json.loads(out[0])[0]["total_files"] == 1
    page = json.loads(out[1])
    assert page["results"][0]["loc"] == "a.py:1-2" and page["warning"]
