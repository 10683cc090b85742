import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import vectors as V
from cairn.operators import bm25, diff, fusion, graph, knn, report, resolve, structure


def ids(df, order="rank", column="id"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_bm25_texts_and_postings_agree(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta foo_bar user id".split()
    rows = [(f"c{i}", " ".join(rng.choices(words, k=rng.randint(0, 30))) if i else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, search_content string")
    for q in ("alpha", "alpha beta", "foo_bar gamma", "alpha-beta delta", "nothing", ""):
        a = {r[0]: round(r[1], 9) for r in bm25.score_texts(df, q).collect()}
        b = {r[0]: round(r[1], 9) for r in bm25.score_postings(*bm25.build_postings(df), q).collect()}
        assert a == b
    phrase = {r[0] for r in bm25.score_texts(df, "alpha-beta").collect()}
    assert phrase == {i for i, t in rows if t and "alpha beta" in t}


def test_overlapping_phrases_count_alike(spark):
    df = spark.createDataFrame([("a", "x x x x"), ("b", "y")], "id string, search_content string")
    a = bm25.score_texts(df, "x-x").collect()
    b = bm25.score_postings(*bm25.build_postings(df), "x-x").collect()
    assert len(a) == len(b) == 1 and a[0][1] == pytest.approx(b[0][1])


def test_or_semantics_filter_and_like(spark):
    df = spark.createDataFrame([("a", "function authenticate(token)", "ts"), ("b", "function logout()", "py")], "id string, search_content string, language string")
    assert {r[0] for r in bm25.score_texts(df, "authenticate logout").collect()} == {"a", "b"}
    assert {r[0] for r in bm25.score_texts(df, "function", where=F.col("language") == "py").collect()} == {"b"}
    assert ids(bm25.like_search(df, "()", 5)) == ["b"]


def vectors(spark, n=300, d=16, seed=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d)).astype("f4")
    rows = [(i, m[i].tolist()) for i in range(n)]
    rows += [(1000, None), (1001, [1.0]), (1002, [None] + [0.0] * (d - 1)), (1003, [])]
    return spark.createDataFrame(rows, "id long, v array<float>"), m.astype("f8")


def test_exact_neighbours(spark):
    df, m = vectors(spark)
    got = ids(knn.nearest(df, m[7].tolist(), 10, "id", "v"))
    want = np.lexsort((np.arange(len(m)), ((m - m[7]) ** 2).sum(1)))[:10].tolist()
    assert got == want
    assert knn.nearest(df.limit(0), m[7].tolist(), 10, "id", "v").count() == 0
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "id long, v array<float>")
    assert ids(knn.nearest(ties, [0.0, 0.0], 3, "id", "v")) == [0, 1, 2]


def test_neighbours_of_all(spark):
    df, m = vectors(spark, 120)
    got = {}
    for r in knn.nearest_each(df, df, 4, "id", "v", rows=50).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    d = ((m[:, None] - m) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert got == {i: np.argsort(d[i], kind="stable")[:4].tolist() for i in range(len(m))}


def test_ties_and_repeated_ids_of_all(spark):
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in random.Random(2).sample(range(50), 50)], "id long, v array<float>")
    found = knn.nearest_each(ties, ties, 5, "id", "v").orderBy("query", "rank").collect()
    assert [r["id"] for r in found] == [j for i in range(50) for j in [x for x in range(6) if x != i][:5]]
    again = spark.createDataFrame([(7, [0.0, 0.0])] * 40 + [(i, [float(i), 0.0]) for i in range(10, 60)], "id long, v array<float>")
    assert ids(knn.nearest_each(again.where("id = 7").limit(1), again, 5, "id", "v")) == [10, 11, 12, 13, 14]


def test_inverted_file_recall(spark):
    df, m = vectors(spark, 2000, 8)
    cells = knn.fit_cells(df, 16, "v")
    assigned = knn.assign_cells(df, cells, "id", "v").cache()
    hits = 0
    for q in range(10):
        exact = set(ids(knn.nearest(df, m[q].tolist(), 10, "id", "v")))
        hits += len(exact & set(ids(knn.probe(assigned, cells, m[q].tolist(), 10, 8, "id", "v"))))
    assert hits >= 90


def test_registered_inverted_file_is_exact(spark, tmp_path, monkeypatch):
    from cairn.plans import catalogue

    df, m = vectors(spark, 2000, 64)
    df = df.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")).cache()
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    for q in (0, 7, 400, 999, 1500, 1999):
        monkeypatch.setattr(catalogue, "_probe_vector", lambda *_: m[q].tolist())
        got = ids(catalogue.QUERIES["knn_inverted_file"](spark, str(tmp_path)), column="vec_id")
        assert got == np.lexsort((np.arange(len(m)), ((m - m[q]) ** 2).sum(1)))[:10].tolist()


def test_cells_out_of_reach_are_not_read(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 6)) * 50
    m = (middles[np.arange(1200) % 12] + rng.normal(size=(1200, 6))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "id long, v array<float>")
    centres = knn.fit_cells(df, 12, "v")
    assigned = knn.assign_cells(df, centres, "id", "v").cache()
    radii = knn.cell_radii(assigned, centres, "v")
    read = []
    real = knn.nearest
    for q in (0, 5, 11):
        try:
            knn.nearest = lambda d, *a: (read.append(d.count()), real(d, *a))[1]
            got = ids(knn.nearest_in_cells(assigned, centres, radii, m[q].tolist(), 10, 1, "id", "v"))
        finally:
            knn.nearest = real
        assert got == np.lexsort((np.arange(len(m)), ((m - m[q]) ** 2).sum(1)))[:10].tolist() and read[-1] < 600


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    row = df.select(V.l2_distance("a", "b"), V.l2_normalise("a"), V.l2_normalise("b")).first()
    assert row[0] == 5.0 and row[1] == [0.6, 0.8] and row[2] == [0.0, 0.0]


def test_rrf_order(spark):
    s = spark.createDataFrame([("b", 0), ("solo_vec", 1)], "id string, rank int")
    lex = spark.createDataFrame([("b", 0), ("solo_lex", 1)], "id string, rank int")
    fused = fusion.fuse(s, lex)
    assert ids(fused) == ["b", "solo_vec", "solo_lex"]
    assert fused.where("id = 'b'").first()["score"] == pytest.approx(2 / 46)


def test_rerank_missing_scores_and_errors(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("c", 2, None)], "id string, rank int, context_content string")
    assert ids(fusion.rerank(df, "q", lambda q, t: [0.0, 2.0])) == ["b", "a", "c"]
    with pytest.raises(ValueError):
        fusion.rerank(df, "q", lambda q, t: (_ for _ in ()).throw(ValueError()))


def test_pages(spark):
    df = spark.range(30).withColumnRenamed("id", "n")
    p = fusion.page(df, [F.col("n")], 10, 20).collect()
    assert [r["n"] for r in p] == list(range(20, 30)) and not p[0]["has_more"]
    assert fusion.page(df, [F.col("n")], 10, 19).first()["has_more"]


def edges(spark, pairs):
    return spark.createDataFrame([(f"e{i:03d}", a, b, t, "f") for i, (a, b, t) in enumerate(pairs)], "id string, source_chunk_id string, target_chunk_id string, type string, source_file_path string")


def test_neighbourhood(spark):
    e = edges(spark, [("A", "B", "CALLS"), ("B", "C", "CALLS"), ("A", "C", "EXTENDS"), ("D", "A", "CALLS"), ("C", "A", "CALLS")])
    got = [(r["hop"], r["direction"], r["neighbour"], r["id"]) for r in graph.neighbourhood(e, "A", 2).orderBy("pos").collect()]
    assert got == [(1, "outgoing", "B", "e000"), (1, "outgoing", "C", "e002"), (1, "incoming", "D", "e003"), (1, "incoming", "C", "e004")]
    only = graph.neighbourhood(e, "A", 2, None, ("CALLS",)).collect()
    assert {(r["hop"], r["neighbour"]) for r in only} == {(1, "B"), (1, "D"), (1, "C")}
    star = edges(spark, [("c", f"n{i}", "CALLS") for i in range(30)])
    assert graph.neighbourhood(star, "c").count() == 20 and graph.neighbourhood(star, "nobody").count() == 0
    chain = edges(spark, [("A", "B", "CALLS"), ("B", "C", "CALLS")])
    assert [graph.neighbourhood(chain, "A", d, None).count() for d in (1, 2, 3)] == [1, 2, 2]


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, file_path string, type string, name string, ord int")


def test_resolution(spark):
    chunks = chunk_rows(spark, [("u0", "utils.ts", "function", "formatDate", 0), ("i1", "user.ts", "import", None, 0), ("c1", "user.ts", "class", "User", 1), ("m1", "user.ts", "method", "User#get", 2), ("i2", "svc/service.ts", "import", None, 0), ("f2", "svc/service.ts", "function", "build", 1), ("x", "z.ts", "function", "formatDate", 0)])
    raw = spark.createDataFrame(
        [("i2", "svc/service.ts", "IMPORTS", "../user", "../user", "{}", 0), ("i1", "user.ts", "IMPORTS", "./utils.js", "./utils.js", "{}", 0), ("c1", "user.ts", "CALLS", "formatDate", None, "{}", 1), ("u0", "utils.ts", "CALLS", "formatDate", None, "{}", 0),
         ("f2", "svc/service.ts", "EXTENDS", "User", "../user", "{}", 1), ("f2", "svc/service.ts", "CALLS", "get", None, "{}", 2), ("i1", "user.ts", "DEFINES", "c1", None, "{}", 9), ("f2", "svc/service.ts", "IMPORTS", "react", "react", "{}", 3), ("f2", "svc/service.ts", "CALLS", "build", None, "{}", 4), ("f2", "svc/service.ts", "CALLS", "get", None, "{}", 5)],
        "source_chunk_id string, source_file_path string, type string, target_symbol string, target_file_path string, metadata string, ord int",
    )
    got = {(r["source_chunk_id"], r["type"], r["target_chunk_id"]) for r in resolve.resolve_all(raw, chunks, chunks.select("file_path"), "p").collect()}
    assert got == {("i2", "IMPORTS", "i1"), ("i1", "IMPORTS", "u0"), ("c1", "CALLS", "u0"), ("u0", "CALLS", "x"), ("f2", "EXTENDS", "c1"), ("f2", "CALLS", "m1"), ("i1", "DEFINES", "c1")}


def test_import_probing(spark):
    files = spark.createDataFrame([(p,) for p in ("a/b.ts", "a/b.tsx", "lib/index.js", "src/u/x.ts", "c.mjs", "d.cts")], "file_path string")
    imports = spark.createDataFrame([("a/x.ts", s) for s in ("./b", "../lib", "@u/x", "./b.js", "../c.mjs", "../d.cjs", "../../out", "pkg", "./nope")], "from_file string, specifier string")
    got = {r["specifier"]: r["target"] for r in resolve.resolve_imports(imports, files, resolve.aliases_frame(spark, [("@u/*", ["src/u/*"])])).collect()}
    assert got == {"./b": "a/b.ts", "../lib": "lib/index.js", "@u/x": "src/u/x.ts", "./b.js": "a/b.ts", "../c.mjs": "c.mjs", "../d.cjs": "d.cts", "../../out": None, "pkg": None, "./nope": None}


def test_defines_and_sources(spark):
    chunks = chunk_rows(spark, [("i", "a", "import", None, 0), ("f", "a", "function", "f", 1), ("g", "a", "const", None, 2), ("h", "b", "function", "h", 0)])
    assert [tuple(r) for r in graph.defines(chunks).collect()] == [("i", "f", "a")]
    raw = spark.createDataFrame([("", "a"), ("h", "b"), (None, "b")], "source_chunk_id string, source_file_path string")
    assert sorted(r[0] for r in graph.fill_sources(raw, chunks).collect()) == ["h", "h", "i"]


def test_diff_and_upsert(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file_path string, sha1 string")
    old = spark.createDataFrame([("b", "2"), ("c", "0"), ("d", "4")], "file_path string, sha1 string")
    assert dict(map(tuple, diff.manifest_diff(now, old).collect())) == {"a": "new", "b": "unchanged", "c": "changed", "d": "removed"}
    t = spark.createDataFrame([("a", 1, 0)], "id string, v int, ord int")
    n = spark.createDataFrame([("a", 2, 0), ("a", 3, 1), ("b", 4, 0)], "id string, v int, ord int")
    assert {(r["id"], r["v"]) for r in diff.upsert(t, n, order="ord").collect()} == {("a", 3), ("b", 4)}


def test_sibling_runs_agree_with_the_extractor(spark):
    from cairn.chunking.extract import Chunk, merge_small

    rng = random.Random(2)
    chunks, line = [], 1
    for i in range(200):
        line += rng.choice([1, 1, 2, 5])
        n = rng.choice([1, 1, 3])
        chunks.append(Chunk(rng.choice(["function", "const", "type", "class"]), rng.choice([None, f"n{i}"]), "x" * rng.choice([5, 50]), "", line, line + n - 1, {"className": "K"} if rng.random() < 0.3 else {}))
        line += n - 1
    df = spark.createDataFrame([("f", i, c.type, c.name, c.content, c.start, c.end, c.metadata.get("className")) for i, c in enumerate(chunks)], "file_path string, ord int, type string, name string, content string, start_line int, end_line int, class_name string")
    got = [(r["type"], r["name"], r["start_line"], r["end_line"], r["content"]) for r in structure.merge_siblings(df, 20).orderBy("ord").collect()]
    assert got == [(c.type, c.name, c.start, c.end, c.content) for c in merge_small(chunks, 20)]


def test_line_formats_agree_with_the_extractor(spark):
    from cairn.plans.samples import SAMPLES

    from cairn.chunking.formats import FORMATS

    for kind, op in (("json", structure.json_keys), ("yaml", structure.yaml_keys), ("toml", structure.toml_tables)):
        text = SAMPLES[kind][0]
        got = [(r["name"], r["start_line"], r["end_line"]) for r in op(spark.createDataFrame([("f", text), ("g", "x")], "file_path string, text string")).where("file_path = 'f'").orderBy("start_line").collect()]
        assert got == [(s.name, s.first + 1, s.last + 1) for s in FORMATS[kind](text.split("\n"), 6000)], kind
    heads = structure.headings(spark.createDataFrame([("f", "# A\n### B\n### C\n## D")], "file_path string, text string")).orderBy("line").collect()
    assert [h["breadcrumb"] for h in heads] == ["A", "A > B", "A > B > C", "A > D"]


def test_budget_and_percentiles_and_recall(spark):
    df = spark.createDataFrame([("k", i, "x" * n) for i, n in enumerate([5, 5, 5, 20, 1, 1, 1, 1])], "k string, i int, t string")
    got = [r["batch"] for r in structure.budget_batches(df, "k", "i", "t", 10, 3).orderBy("i").collect()]
    from cairn.embedding.services import budget

    want = [n for n, b in enumerate(budget(["x" * n for n in [5, 5, 5, 20, 1, 1, 1, 1]], 10, 3)) for _ in b]
    assert got == want
    v = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    assert {r["p"]: r["value"] for r in report.percentiles(v, "v").collect()} == {50: 50.0, 95: 95.0, 99: 99.0}
    h = spark.createDataFrame([("a", 0), ("b", 3), ("c", None)], "query string, hit_rank int")
    assert {r["k"]: r["recall"] for r in report.recall_at(h).collect()} == {1: 0.3333, 5: 0.6667, 10: 0.6667}


def test_related_ends_are_sent_once(spark):
    rows = [("a", "c", "USES"), ("a", "c", "USES"), ("b", "c", "USES"), ("a", "d", "CALLS"), ("x", "c", "USES")]
    edges = spark.createDataFrame(rows, "source_chunk_id string, target_chunk_id string, type string")
    chunks = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, name string")
    found = graph.related(edges, chunks.hint("merge"), *graph.RELATED["usages"])
    assert sorted(map(tuple, found.collect())) == [("c", "a", "A"), ("c", "b", "B")]
    plan = graph.related(edges, chunks.hint("merge"), *graph.RELATED["usages"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # one for each side of the join
