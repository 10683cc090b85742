"""All queries over the benchmark tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..functions import vectors as V
from ..operators import bm25, diff, filters, fusion, graph, knn, report, resolve, structure
from ..operators.shared import cut
from ..sources.languages import language_of
from ..streaming.watch import latest_per_burst
from . import fixtures as X
from .samples import SAMPLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
QUERY = "the nder pour"
K = 10


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _probe_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: that of the smallest id."""
    return list(X.table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"])


# ------------------------------------------------------------------ scans and changes

_PREVIOUS = "prev AS (SELECT 'd' || doc_id AS file_path, sha1(CASE WHEN lang = 'en' AND n_chars > 1000 THEN lower(text) ELSE text END) AS sha1 FROM documents WHERE lang <> 'es')"
_CURRENT = "cur AS (SELECT 'd' || doc_id AS file_path, sha1(text) AS sha1 FROM documents WHERE lang <> 'fr')"


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus: without French now, without Spanish before, long English texts changed since."""
    d = X.table(spark, sf_dir, "documents").withColumn("file_path", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    old = F.when((F.col("lang") == "en") & (F.col("n_chars") > 1000), F.lower("text")).otherwise(F.col("text"))
    return d.where("lang <> 'fr'").select("file_path", F.sha1("text").alias("sha1")), d.where("lang <> 'es'").select("file_path", F.sha1(old).alias("sha1"))


@query("SELECT source || '/d' || doc_id || '.md' AS file_path, sha1(text) AS sha1, octet_length(encode(text)) AS size, 'markdown' AS language FROM documents WHERE source <> 'src0'")
def scan_files(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), "text")
    from ..sources.ignore import any_of

    kept = d.where(~F.col("file_path").rlike(any_of(["src0/**", "**/.*"])))
    return kept.select("file_path", F.sha1("text").alias("sha1"), F.octet_length("text").alias("size"), language_of("file_path").alias("language"))


@query(f"WITH {_PREVIOUS}, {_CURRENT} SELECT coalesce(cur.file_path, prev.file_path) AS file_path, CASE WHEN cur.sha1 IS NULL THEN 'removed' WHEN prev.sha1 IS NULL THEN 'new' WHEN cur.sha1 = prev.sha1 THEN 'unchanged' ELSE 'changed' END AS status FROM cur FULL OUTER JOIN prev ON cur.file_path = prev.file_path")
def manifest_diff(spark, sf_dir):
    return diff.manifest_diff(*_manifests(spark, sf_dir))


@query(f"WITH {_PREVIOUS}, {_CURRENT} SELECT file_path FROM prev WHERE file_path NOT IN (SELECT file_path FROM cur)")
def removed_files(spark, sf_dir):
    return diff.removed_files(*_manifests(spark, sf_dir))


# ------------------------------------------------------------------ filters, ids, listings


@query(f"WITH {X.CHUNKS} SELECT id, language FROM chunks WHERE language IN ('en', 'de')")
def language_filter(spark, sf_dir):
    return X.chunks(spark, sf_dir).where(filters.by_language(("en", "de"))).select("id", "language")


@query(f"WITH {X.CHUNKS} SELECT id, type FROM chunks WHERE type IN ('class', 'function')")
def type_filter(spark, sf_dir):
    return X.chunks(spark, sf_dir).where(filters.by_type(("class", "function"))).select("id", "type")


@query(f"WITH {X.CHUNKS} SELECT id, file_path FROM chunks WHERE file_path LIKE 'src1%/en'")
def path_glob_filter(spark, sf_dir):
    return X.chunks(spark, sf_dir).where(filters.by_path("src1*/en")).select("id", "file_path")


@query(f"WITH {X.CHUNKS} SELECT id, substr(sha1(concat_ws(':', project_id, file_path, start_line)), 1, 16) AS chunk_id FROM chunks")
def chunk_ids(spark, sf_dir):
    return X.chunks(spark, sf_dir).select("id", ids.chunk_id("project_id", "file_path", "start_line").alias("chunk_id"))


@query(f"WITH {X.EDGES} SELECT id, source_chunk_id, target_chunk_id FROM edges")
def edge_ids(spark, sf_dir):
    return X.edges(spark, sf_dir).select("id", "source_chunk_id", "target_chunk_id")


@query(f"WITH {X.CHUNKS} SELECT DISTINCT file_path FROM chunks ORDER BY file_path")
def list_files(spark, sf_dir):
    return report.list_files(X.chunks(spark, sf_dir))


@query(f"WITH {X.CHUNKS} SELECT language, count(*) AS n FROM chunks GROUP BY language")
def count_by_language(spark, sf_dir):
    return report.count_by(X.chunks(spark, sf_dir), "language")


@query(f"WITH {X.CHUNKS} SELECT type, count(*) AS n FROM chunks GROUP BY type")
def count_by_type(spark, sf_dir):
    return report.count_by(X.chunks(spark, sf_dir), "type")


@query(f"WITH {X.EDGES} SELECT type, count(*) AS n FROM edges GROUP BY type")
def count_edges_by_type(spark, sf_dir):
    return report.count_by(X.edges(spark, sf_dir), "type")


@query(f"""WITH {X.CHUNKS}, {X.EDGES}, c(k, v) AS (SELECT language, count(*) FROM chunks GROUP BY language), t(k, v) AS (SELECT type, count(*) FROM chunks GROUP BY type), e(k, v) AS (SELECT type, count(*) FROM edges GROUP BY type)
    SELECT 'corpus' AS project_id, (SELECT count(*) FROM chunks) AS total_chunks, (SELECT count(DISTINCT file_path) FROM chunks) AS total_files, (SELECT count(*) FROM edges) AS total_edges,
        (SELECT string_agg(k || '=' || v, ',' ORDER BY k) FROM c) AS by_language, (SELECT string_agg(k || '=' || v, ',' ORDER BY k) FROM t) AS by_type, (SELECT string_agg(k || '=' || v, ',' ORDER BY k) FROM e) AS by_edge_type""")
def stats(spark, sf_dir):
    out = report.stats(X.chunks(spark, sf_dir), X.edges(spark, sf_dir), "corpus")
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return out.select("project_id", "total_chunks", "total_files", "total_edges", *map(shown, ("by_language", "by_type", "by_edge_type")))


@query(f"WITH {X.CHUNKS} SELECT file_path, type, name, start_line, end_line FROM chunks WHERE type IN ('function', 'class', 'method', 'interface', 'type', 'enum') AND name IS NOT NULL")
def symbols(spark, sf_dir):
    return report.symbols(X.chunks(spark, sf_dir))


_OUTLINE = f"""WITH {X.CHUNKS}, s AS (SELECT * FROM chunks WHERE type IN ('function', 'class') AND name IS NOT NULL)
    SELECT file_path, file_path || chr(10) || string_agg('  ' || type || ' ' || name || ' (' || start_line || '-' || end_line || ')', chr(10) ORDER BY start_line, type, name) AS outline, count(*) AS n FROM s GROUP BY file_path"""


@query(_OUTLINE)
def repo_map(spark, sf_dir):
    return report.repo_map(X.chunks(spark, sf_dir), ("function", "class")).select("file_path", "outline", F.size("symbols").cast("long").alias("n"))


@query(f"SELECT * FROM ({_OUTLINE}) ORDER BY n DESC, file_path LIMIT 5")
def repo_map_largest(spark, sf_dir):
    return report.repo_map(X.chunks(spark, sf_dir), ("function", "class"), 5).select("file_path", "outline", F.size("symbols").cast("long").alias("n"))


# ------------------------------------------------------------------ text


@query(r"""WITH word AS (SELECT p_partkey, unnest(regexp_extract_all(replace(p_name, ' ', '_') || ' ' || list_reduce(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), lambda a, b: a || b) || ' ' || p_brand, '[A-Za-z][A-Za-z0-9_]*[A-Za-z0-9]')) AS t FROM part),
    part_of AS (SELECT p_partkey, t, list_distinct(list_filter(string_split(lower(replace(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '_', ' ')), ' '), lambda x: x <> '')) AS ps FROM word),
    term AS (SELECT p_partkey, t FROM part_of UNION ALL SELECT p_partkey, unnest(ps) FROM part_of WHERE len(ps) > 1)
    SELECT p_partkey, string_agg(t, ' ' ORDER BY t COLLATE "C") AS terms FROM term GROUP BY p_partkey""".replace(' COLLATE "C"', ""))
def expand_identifiers(spark, sf_dir):
    camel = F.array_join(F.transform(F.split("p_name", " "), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), "")
    text = F.concat_ws(" ", F.regexp_replace("p_name", " ", "_"), camel, "p_brand")
    return X.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(T.identifier_terms(text)), " ").alias("terms"))


@query(r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents) SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_terms FROM t")
def tokenize(spark, sf_dir):
    t = X.table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_terms"))


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 176) || '/* … */' || right(text, 117) END AS short, CASE WHEN length(text) > 200 THEN rtrim(ltrim(substr(text, 1, 200), ' '), ' ') || '...' ELSE rtrim(ltrim(text, ' '), ' ') END AS snippet FROM documents")
def truncate_ellipsis(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.truncate_middle("text", 300).alias("short"), T.snippet("text").alias("snippet"))


@query("WITH p AS (SELECT doc_id, unnest(range(0, greatest(1, (length(text) + 999) // 1000))) AS i, text FROM documents) SELECT doc_id, i::INT AS piece, md5(substr(text, i * 1000 + 1, 1000)) AS md5 FROM p")
def split_text(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_fixed("text", 1000)).alias("piece", "t"))
    return d.select("doc_id", "piece", F.md5("t").alias("md5"))


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    b AS (SELECT source, doc_id, i, 0 AS batch, 1 AS items, n::BIGINT AS chars FROM o WHERE i = 1
        UNION ALL SELECT o.source, o.doc_id, o.i, b.batch + (b.chars + o.n > 18000 OR b.items >= 10)::INT, CASE WHEN b.chars + o.n > 18000 OR b.items >= 10 THEN 1 ELSE b.items + 1 END, CASE WHEN b.chars + o.n > 18000 OR b.items >= 10 THEN o.n ELSE b.chars + o.n END
        FROM b JOIN o ON o.source = b.source AND o.i = b.i + 1)
    SELECT source, doc_id, batch FROM b""")
def char_budget_batches(spark, sf_dir):
    return structure.budget_batches(X.table(spark, sf_dir, "documents"), "source", "doc_id", "text", 18000, 10)


# ------------------------------------------------------------------ lexical search

_TOKENS = r"""tok AS (SELECT id, file_path, language, type, regexp_extract_all(lower(search_content), '[\p{L}\p{N}]+') AS w FROM chunks),
    corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tok)"""


def _bm25_sql(phrases: list[list[str]], where: str = "true") -> str:
    tf = ", ".join(
        f"len(list_filter(w, lambda x: x = '{p[0]}')) AS f{i}" if len(p) == 1 else f"len(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p) - 1}] = {p})) AS f{i}" for i, p in enumerate(phrases)
    )
    score = " + ".join(
        f"greatest(ln(((SELECT n FROM corpus) - (SELECT count(*) FROM tf WHERE f{i} > 0) + 0.5) / ((SELECT count(*) FROM tf WHERE f{i} > 0) + 0.5)), 1e-6) * (f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / (SELECT mean FROM corpus))))" for i in range(len(phrases))
    )
    some = " OR ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f"{X.CHUNKS}, {_TOKENS}, tf AS (SELECT id, file_path, language, type, len(w) AS dl, {tf} FROM tok), scored AS (SELECT id, {score} AS score FROM tf WHERE ({some}) AND {where}), lexical AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM scored)"


def _top(scored: DataFrame, k: int = K) -> DataFrame:
    """Scores are rounded before they are compared, so that summation order decides no tie."""
    return bm25.top_k(scored.withColumn("score", F.round("score", 9)), k)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_bm25_sql([['the'], ['nder'], ['pour']])} SELECT id, round(score, 6) AS score, rank FROM lexical WHERE rank < {K}")
def bm25_topk(spark, sf_dir):
    return _shown(_top(bm25.score_texts(X.chunks(spark, sf_dir), QUERY)))


@query(f"WITH {_bm25_sql([['the'], ['nder'], ['pour']], chr(34) + 'language' + chr(34) + ' IN (' + chr(39) + 'en' + chr(39) + ') AND file_path LIKE ' + chr(39) + 'src1%' + chr(39))} SELECT id, round(score, 6) AS score, rank FROM lexical WHERE rank < {K}")
def bm25_filtered(spark, sf_dir):
    return _shown(_top(bm25.score_texts(X.chunks(spark, sf_dir), QUERY, where=filters.chunk_filter("en", None, "src1*"))))


@query(f"WITH {_bm25_sql([['the'], ['nder'], ['pour']])} SELECT id, round(score, 6) AS score FROM scored")
def bm25_postings(spark, sf_dir):
    postings, lengths = bm25.build_postings(X.chunks(spark, sf_dir))
    return bm25.score_postings(postings, lengths, QUERY).select(F.col("chunk_id").alias("id"), F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql([['on', 'the'], ['en', 'le']])} SELECT id, round(score, 6) AS score, rank FROM lexical WHERE rank < {K}")
def phrase_match(spark, sf_dir):
    return _shown(_top(bm25.score_texts(X.chunks(spark, sf_dir), "on-the en_le".replace("_", "."))))


@query(f"WITH {X.CHUNKS} SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM chunks WHERE contains(lower(search_content), '@') ORDER BY id LIMIT {K}")
def like_fallback(spark, sf_dir):
    found = bm25.like_search(X.chunks(spark, sf_dir), "@", K)
    return found.select("id", F.col("rank").cast("long").alias("rank"))


# ------------------------------------------------------------------ vectors

_Q = "q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1)"
_DIST = f"{_Q}, near AS (SELECT vec_id, label, list_distance(embedding::DOUBLE[], (SELECT e FROM q)) AS d FROM embeddings)"


def _near(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_DIST} SELECT vec_id, round(d, 6) AS dist, row_number() OVER (ORDER BY d, vec_id) - 1 AS rank FROM near ORDER BY d, vec_id LIMIT {K}")
def knn_topk(spark, sf_dir):
    return _near(knn.nearest(X.table(spark, sf_dir, "embeddings"), _probe_vector(spark, sf_dir), K, "vec_id"))


@query(f"WITH {_DIST} SELECT vec_id, round(d, 6) AS dist, row_number() OVER (ORDER BY d, vec_id) - 1 AS rank FROM near WHERE label IN (1, 2, 3) ORDER BY d, vec_id LIMIT {K}")
def knn_filtered(spark, sf_dir):
    return _near(knn.nearest(X.table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 2, 3)), _probe_vector(spark, sf_dir), K, "vec_id"))


@query("WITH d AS (SELECT a.vec_id AS query, b.vec_id AS id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) - 1 AS rank FROM d) SELECT query, id, round(d, 6) AS dist, rank FROM r WHERE rank < 5")
def knn_each(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    return knn.nearest_each(e, e, 5, "vec_id", "embedding").select("query", "id", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(ORACLES["knn_topk"])
def knn_inverted_file(spark, sf_dir):
    """The exact neighbours, through cells: one is passed over only if its radius proves that none is inside."""
    e = X.table(spark, sf_dir, "embeddings")
    return _near(_through_cells(e, _probe_vector(spark, sf_dir)))


def _through_cells(e: DataFrame, vector: list[float]) -> DataFrame:
    centres = knn.fit_cells(e, max(8, knn.cells_for(e.count())))
    assigned = cut(knn.assign_cells(e, centres, "vec_id"), "cells")
    return knn.nearest_in_cells(assigned, centres, knn.cell_radii(assigned, centres), vector, K, 4, "vec_id")


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))))), 6) AS l1 FROM embeddings")
def l2_normalize(spark, sf_dir):
    n = X.table(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalise("embedding").alias("u"))
    return n.select("vec_id", F.round(F.aggregate(F.transform("u", F.abs), F.lit(0.0), lambda a, x: a + x), 6).alias("l1"))


@query("WITH x AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings) SELECT label, (i - 1)::INT AS place, round(avg(v), 6) AS mean FROM x GROUP BY label, i")
def vector_mean(spark, sf_dir):
    m = V.mean_vectors(X.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("embedding").alias("place", "x")).select("label", "place", F.round("x", 6).alias("mean"))


# ------------------------------------------------------------------ fusion

#: The vector of number n stands for the document of that number, as far as there is one.
_LEGS = f"{_bm25_sql([['the'], ['nder'], ['pour']])}, {_DIST}, semantic AS (SELECT format('d{{:08d}}', vec_id) AS id, row_number() OVER (ORDER BY d, vec_id) - 1 AS rank FROM near WHERE vec_id IN (SELECT doc_id FROM documents))"
_FUSED = f"{_LEGS}, both_legs AS (SELECT id, rank AS s, NULL AS l FROM semantic WHERE rank < {{n}} UNION ALL SELECT id, NULL, rank FROM lexical WHERE rank < {{n}}), per AS (SELECT id, min(s) AS s, min(l) AS l FROM both_legs GROUP BY id), fused AS (SELECT id, coalesce(1 / (45 + s + 1), 0) + coalesce(1 / (45 + l + 1), 0) AS score, row_number() OVER (ORDER BY coalesce(1 / (45 + s + 1), 0) + coalesce(1 / (45 + l + 1), 0) DESC, s NULLS LAST, l NULLS LAST, id) - 1 AS rank FROM per)"


def _legs(spark, sf_dir, n: int) -> tuple[DataFrame, DataFrame]:
    c = X.chunks(spark, sf_dir)
    lexical = _top(bm25.score_texts(c, QUERY), n)
    vectors = X.table(spark, sf_dir, "embeddings").join(X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    semantic = knn.nearest(vectors, _probe_vector(spark, sf_dir), n, "vec_id").select(F.format_string("d%08d", "vec_id").alias("id"), "rank")
    return semantic, lexical


@query(f"WITH {_FUSED.replace('{n}', '20')} SELECT id, round(score, 6) AS score, rank FROM fused")
def rrf_fusion(spark, sf_dir):
    return _shown(fusion.fuse(*_legs(spark, sf_dir, 20)))


@query(f"WITH {_FUSED.replace('{n}', '90')} SELECT rank, id, language, type, name, 'hybrid' AS match_type FROM fused JOIN chunks USING (id) WHERE rank < 10")
def hybrid_search(spark, sf_dir):
    hits = fusion.fuse(*_legs(spark, sf_dir, 9 * K), limit=3 * K).where(F.col("rank") < K)
    joined = X.chunks(spark, sf_dir).join(F.broadcast(hits), "id")
    return joined.select(F.col("rank").cast("long").alias("rank"), "id", "language", "type", "name", F.lit("hybrid").alias("match_type"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search(spark, sf_dir)


@query(f"WITH {_FUSED.replace('{n}', '90')}, s AS (SELECT id, fused.rank, length(search_content)::DOUBLE AS score FROM fused JOIN chunks USING (id) WHERE fused.rank < 30) SELECT id, score AS rerank_score, row_number() OVER (ORDER BY score DESC, rank) - 1 AS rank FROM s")
def rerank(spark, sf_dir):
    """By a reranker that prefers long texts, over all that was fused."""
    hits = fusion.fuse(*_legs(spark, sf_dir, 9 * K), limit=3 * K).drop("score")
    joined = X.chunks(spark, sf_dir).join(F.broadcast(hits), "id").select("id", "rank", "search_content")
    out = fusion.rerank(joined, QUERY, lambda q, texts: [float(len(t)) for t in texts], "search_content")
    return out.select("id", "rerank_score", F.col("rank").cast("long").alias("rank"))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE n = 1")
def dedupe_by_id(spark, sf_dir):
    return fusion.dedupe(X.table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 75 AS has_more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paginate(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return fusion.page(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 25, 50)


# ------------------------------------------------------------------ graph


@query(f"WITH {X.EDGES} SELECT id, target_chunk_id FROM edges WHERE source_chunk_id = 'n:3'")
def out_edges(spark, sf_dir):
    return graph.outgoing(X.edges(spark, sf_dir), "n:3").select("id", "target_chunk_id")


@query(f"WITH {X.EDGES} SELECT id, source_chunk_id FROM edges WHERE target_chunk_id = 'n:3' AND type = 'IMPLEMENTS'")
def in_edges(spark, sf_dir):
    return graph.incoming(X.edges(spark, sf_dir), "n:3", ("IMPLEMENTS",)).select("id", "source_chunk_id")


def _relation(name: str) -> None:
    direction, types = graph.RELATED[name]
    near, far = ("target_chunk_id", "source_chunk_id") if direction == "in" else ("source_chunk_id", "target_chunk_id")
    listed = ", ".join(f"'{t}'" for t in types)

    def run(spark, sf_dir):
        return graph.related(X.edges(spark, sf_dir), X.entities(spark, sf_dir), direction, types)

    query(f'WITH {X.EDGES} SELECT DISTINCT e.{near} AS "of", n.id, n.name, n.type FROM edges e JOIN entities n ON n.id = e.{far} WHERE e.type IN ({listed})', name)(run)


for _name in graph.RELATED:
    _relation(_name)

_BOTH = "walk AS (SELECT source_chunk_id AS near, target_chunk_id AS far, 'outgoing' AS direction, id FROM edges UNION ALL SELECT target_chunk_id, source_chunk_id, 'incoming', id FROM edges)"


def _hops(depth: int) -> str:
    parts = ["h0 AS (SELECT 'n:3' AS far)"]
    for h in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT far FROM h{k}" for k in range(h))
        parts.append(f"h{h} AS (SELECT DISTINCT {h} AS hop, w.* FROM walk w SEMI JOIN h{h - 1} ON w.near = h{h - 1}.far WHERE w.far NOT IN ({seen}))")
    return ", ".join(parts)


def _bfs(depth: int) -> None:
    def run(spark, sf_dir):
        return graph.neighbourhood(X.edges(spark, sf_dir), "n:3", depth, None).select("hop", "direction", "neighbour", "id")

    rows = " UNION ALL ".join(f"SELECT hop, direction, far AS neighbour, id FROM h{h}" for h in range(1, depth + 1))
    query(f"WITH {X.EDGES}, {_BOTH}, {_hops(depth)} {rows}", f"bfs_depth{depth}")(run)


for _depth in (1, 2, 3):
    _bfs(_depth)


@query(f"WITH {X.EDGES}, {_BOTH}, {_hops(1)} SELECT row_number() OVER (ORDER BY direction DESC, id) - 1 AS pos, direction, far AS neighbour, id FROM h1 ORDER BY direction DESC, id LIMIT 20")
def bfs_limited(spark, sf_dir):
    return graph.neighbourhood(X.edges(spark, sf_dir), "n:3").select(F.col("pos").cast("long").alias("pos"), "direction", "neighbour", "id")


#: One import chunk for each file: that of its smallest start line counts as such.
_TYPED = f"{X.CHUNKS}, typed AS (SELECT * REPLACE (CASE WHEN language = 'de' AND type = 'const' THEN 'import' ELSE type END AS type) FROM chunks)"


def _typed(spark, sf_dir) -> DataFrame:
    return X.chunks(spark, sf_dir).withColumn("type", F.when((F.col("language") == "de") & (F.col("type") == "const"), "import").otherwise(F.col("type")))


@query(f"WITH {_TYPED}, f AS (SELECT file_path, arg_min(id, ord) AS source_chunk_id FROM typed WHERE type = 'import' GROUP BY file_path) SELECT source_chunk_id, id AS target_chunk_id, file_path AS source_file_path FROM f JOIN typed USING (file_path) WHERE type <> 'import' AND name IS NOT NULL")
def defines_edges(spark, sf_dir):
    return graph.defines(_typed(spark, sf_dir))


@query(f"WITH {X.CHUNKS}, f AS (SELECT file_path, arg_min(id, ord) AS first FROM chunks GROUP BY file_path) SELECT id, CASE WHEN type = 'class' THEN id ELSE first END AS source FROM chunks JOIN f USING (file_path)")
def fill_sources(spark, sf_dir):
    c = X.chunks(spark, sf_dir)
    raw = c.select(F.when(F.col("type") == "class", F.col("id")).otherwise("").alias("source_chunk_id"), F.col("file_path").alias("source_file_path"), "id")
    return graph.fill_sources(raw, c).select("id", F.col("source_chunk_id").alias("source"))


_IMPORTS = "WITH {cte}, last AS (SELECT file_path, arg_max(id, ord) AS i FROM typed WHERE type = 'import' GROUP BY file_path), e AS (SELECT a.i AS s, b.i AS t FROM last a JOIN last b ON split_part(a.file_path, '/', 1) < split_part(b.file_path, '/', 1)) "


def _import_edges(typed: DataFrame) -> DataFrame:
    """Import chunks of each folder lead to those of all later folders."""
    last = filters.one_per(typed.where("type = 'import'"), "file_path", F.desc("ord")).select("id", F.split("file_path", "/")[0].alias("folder"))
    return last.alias("a").join(last.alias("b"), F.expr("a.folder < b.folder")).select(F.col("a.id").alias("source_chunk_id"), F.col("b.id").alias("target_chunk_id"), F.lit("IMPORTS").alias("type"))


@query(_IMPORTS.format(cte=_TYPED) + "SELECT l.file_path AS of_file, c.id, c.file_path FROM last l JOIN e ON e.s = l.i JOIN typed c ON c.id = e.t")
def dependencies(spark, sf_dir):
    c = _typed(spark, sf_dir).select("id", "file_path", "type", "ord")
    return graph.related_files(_import_edges(c), c, "out").select("of_file", "id", "file_path")


@query(_IMPORTS.format(cte=_TYPED) + "SELECT l.file_path AS of_file, c.id, c.file_path FROM last l JOIN e ON e.t = l.i JOIN typed c ON c.id = e.s")
def dependents(spark, sf_dir):
    c = _typed(spark, sf_dir).select("id", "file_path", "type", "ord")
    return graph.related_files(_import_edges(c), c, "in").select("of_file", "id", "file_path")


# ------------------------------------------------------------------ resolution

_EXPORTS = f"{_TYPED}, exported AS (SELECT file_path, name AS symbol, arg_max(id, ord) AS chunk_id FROM typed WHERE type <> 'import' AND name IS NOT NULL GROUP BY file_path, name)"


@query(f"WITH {_EXPORTS} SELECT file_path, symbol, chunk_id FROM exported")
def export_map(spark, sf_dir):
    return resolve.export_map(_typed(spark, sf_dir)).select("file_path", "symbol", "chunk_id")


@query(f"WITH {X.PROJECT} SELECT DISTINCT specifier, CASE WHEN specifier LIKE '@region/%' THEN 'src/region/' || substr(specifier, 9) END AS aliased FROM imports")
def alias_rewrite(spark, sf_dir):
    s = X.project_imports(spark, sf_dir).select("specifier").distinct()
    return resolve.rewrite_aliases(s, resolve.aliases_frame(spark, X.ALIASES)).select("specifier", "aliased")


@query(f"WITH {X.PROJECT} SELECT from_file, specifier, CASE WHEN specifier LIKE '@region/%' THEN 'src/region/' || substr(specifier, 9) || '/index.ts' WHEN specifier LIKE '../../nation/%' THEN 'src/nation/' || regexp_replace(substr(specifier, 14), '\\.js$', '.ts') END AS target FROM imports".replace("\\\\", "\\"))
def resolve_imports(spark, sf_dir):
    return resolve.resolve_imports(X.project_imports(spark, sf_dir), X.project_files(spark, sf_dir), resolve.aliases_frame(spark, X.ALIASES)).select("from_file", "specifier", "target")


@query(f"""WITH {_EXPORTS}, raw AS (SELECT id AS source_chunk_id, file_path AS source_file_path, name AS target_symbol FROM typed WHERE name IS NOT NULL AND type = 'function'),
    t AS (SELECT source_chunk_id, source_file_path, arg_min(chunk_id, file_path) AS target_chunk_id FROM raw JOIN exported ON symbol = target_symbol AND file_path <> source_file_path GROUP BY source_chunk_id, source_file_path)
    SELECT substr(sha1(concat_ws(':', 'corpus', source_chunk_id, target_chunk_id, 'CALLS')), 1, 16) AS id, source_chunk_id, target_chunk_id, 'CALLS' AS type FROM t WHERE source_chunk_id <> target_chunk_id""")
def resolve_global(spark, sf_dir):
    c = _typed(spark, sf_dir)
    none = F.lit(None).cast("string")
    raw = c.where("name is not null and type = 'function'").select(F.col("id").alias("source_chunk_id"), F.col("file_path").alias("source_file_path"), F.lit("CALLS").alias("type"), F.col("name").alias("target_symbol"), none.alias("target_file_path"), F.lit("{}").alias("metadata"), "ord")
    return resolve.resolve_all(raw, c, c.select("file_path"), "corpus").select("id", "source_chunk_id", "target_chunk_id", "type")


@query(f"""WITH {_EXPORTS}, raw AS (SELECT id AS source_chunk_id, file_path AS source_file_path, name AS target_symbol FROM typed WHERE name IS NOT NULL AND type = 'function')
    SELECT r.source_chunk_id, e.chunk_id AS target_chunk_id FROM raw r JOIN exported e ON e.symbol = r.target_symbol AND e.file_path = split_part(r.source_file_path, '/', 1) || '/en' WHERE e.chunk_id <> r.source_chunk_id""")
def resolve_with_hint(spark, sf_dir):
    """Symbols looked up in the English file of the same folder."""
    c = _typed(spark, sf_dir)
    suffix = lambda col: F.concat(col, F.lit(".ts"))
    c = c.withColumn("file_path", suffix(F.col("file_path")))
    raw = c.where("name is not null and type = 'function'").select(F.col("id").alias("source_chunk_id"), F.col("file_path").alias("source_file_path"), F.lit("EXTENDS").alias("type"), F.col("name").alias("target_symbol"), F.lit("./en").alias("target_file_path"), F.lit("{}").alias("metadata"), "ord")
    return resolve.resolve_all(raw, c, c.select("file_path"), "corpus").select("source_chunk_id", "target_chunk_id")


# ------------------------------------------------------------------ structure


@query(f"""WITH {X.CHUNKS}, o AS (SELECT id, file_path, start_line AS a, end_line AS b, name, ord FROM chunks WHERE type = 'class'), m AS (SELECT c.id, arg_min(o.name, o.ord) AS parent FROM chunks c JOIN o ON o.file_path = c.file_path AND o.a <= c.start_line AND o.b >= c.end_line AND o.id <> c.id GROUP BY c.id)
    SELECT id, parent FROM chunks LEFT JOIN m USING (id)""")
def parent_attribution(spark, sf_dir):
    c = X.chunks(spark, sf_dir)
    return structure.enclosing(c, c, ("class",)).select("id", "parent")


@query(f"""WITH {X.CHUNKS}, s AS (SELECT *, type NOT IN ('class', 'file') AND length(search_content) < 1000 AS small FROM chunks),
    l AS (SELECT *, lag(small) OVER w AS ps, lag(end_line) OVER w AS pe FROM s WINDOW w AS (PARTITION BY file_path ORDER BY ord)),
    r AS (SELECT *, sum(CASE WHEN coalesce(ps AND small AND start_line <= pe + 2, false) THEN 0 ELSE 1 END) OVER (PARTITION BY file_path ORDER BY ord) AS run FROM l)
    SELECT file_path, min(ord) AS ord, arg_min(type, ord) AS type, CASE WHEN count(*) > 1 AND first(name ORDER BY ord) IS NOT NULL THEN first(name ORDER BY ord) || ' +' || (count(*) - 1) ELSE first(name ORDER BY ord) END AS name, md5(string_agg(search_content, chr(10) ORDER BY ord)) AS content_md5, first(start_line ORDER BY ord) AS start_line, last(end_line ORDER BY ord) AS end_line FROM r GROUP BY file_path, run""")
def sibling_merge(spark, sf_dir):
    c = X.chunks(spark, sf_dir).withColumn("content", F.col("search_content")).withColumn("class_name", F.lit(None).cast("string"))
    return structure.merge_siblings(c, 1000).select("file_path", "ord", "type", "name", F.md5("content").alias("content_md5"), "start_line", "end_line")


def _sections_sql(kind: str, name: str) -> str:
    return f"""WITH {X.texts_sql(kind)}, b AS (SELECT file_path, ls, n, line, {name} AS name FROM line WHERE {name} IS NOT NULL),
        e AS (SELECT *, coalesce(lead(line) OVER (PARTITION BY file_path ORDER BY line), n + 1) - 1 AS end_line, count(*) OVER (PARTITION BY file_path) AS c FROM b)
        SELECT file_path, name, line AS start_line, end_line, array_to_string(ls[line:end_line], chr(10)) AS content FROM e WHERE c > 3"""


@query(_sections_sql("json", "nullif(regexp_extract(v, '^ {2}\"([^\"]+)\"\\s*:', 1), '')"))
def split_json_keys(spark, sf_dir):
    return structure.json_keys(X.texts_of_customers(spark, sf_dir, "json"))


@query(_sections_sql("yaml", "coalesce(nullif(regexp_extract(v, '^([a-zA-Z_][a-zA-Z0-9_-]*):', 1), ''), CASE WHEN v LIKE '---%' THEN '---' END)"))
def split_yaml_keys(spark, sf_dir):
    return structure.yaml_keys(X.texts_of_customers(spark, sf_dir, "yaml"))


@query(_sections_sql("toml", "nullif(trim(regexp_extract(v, '^\\[{1,2}([^\\]]+)\\]{1,2}', 1)), '')"))
def split_toml_tables(spark, sf_dir):
    return structure.toml_tables(X.texts_of_customers(spark, sf_dir, "toml"))


@query(f"""WITH RECURSIVE {X.texts_sql("markdown")}, h AS (SELECT file_path, line, length(regexp_extract(v, '^(#{{1,3}})\\s+(.+)', 1))::INT AS level, trim(regexp_extract(v, '^(#{{1,3}})\\s+(.+)', 2)) AS heading, row_number() OVER (PARTITION BY file_path ORDER BY line) AS i FROM line WHERE regexp_matches(v, '^#{{1,3}}\\s+.')),
    f AS (SELECT file_path, line, level, heading, i, [heading] AS stack FROM h WHERE i = 1 UNION ALL SELECT h.file_path, h.line, h.level, h.heading, h.i, list_append(f.stack[1:least(len(f.stack), h.level - 1)], h.heading) FROM f JOIN h ON h.file_path = f.file_path AND h.i = f.i + 1)
    SELECT file_path, line, level, heading, array_to_string(stack, ' > ') AS breadcrumb FROM f""")
def heading_breadcrumb(spark, sf_dir):
    return structure.headings(X.texts_of_customers(spark, sf_dir, "markdown"))


@query()
def html_elements(spark, sf_dir):
    """The pages' outermost elements, by the HTML parser; tested against fixtures."""
    from ..chunking.spark import chunks_of, parse_files

    pages = X.table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), F.lit("html").alias("language"), F.col("html").alias("text"))
    return chunks_of(parse_files(pages, "pages")).select("file_path", "type", "name", "start_line", "end_line", "id")


@query()
def chunk_documents(spark, sf_dir):
    """All documents through the chunker; tested against a brute-force splitter on a fixture with headings, empty and null texts."""
    from ..chunking.spark import chunks_of, parse_files

    d = X.table(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.lit("markdown").alias("language"), "text")
    c = chunks_of(parse_files(files, "corpus"))
    return c.select("file_path", "type", F.coalesce("name", "file_path").alias("name"), "start_line", "end_line", "id", F.md5("content").alias("content_md5"))


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _sample(language: str) -> None:
    """A source of each language through the chunker; the SQL lists what it holds."""
    source, chunks, edges = SAMPLES[language]
    rows = [("chunk", t, n, c, a, b) for t, n, c, a, b in chunks] + [("edge", t, s, f, a, None) for t, s, f, a in edges]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)

    def run(spark, sf_dir):
        from ..chunking.spark import chunks_of, parse_files, raw_edges_of

        parsed = cut(parse_files(spark.createDataFrame([("dir/a.x", language, source)], "file_path string, language string, text string"), "samples"), "sample")
        c = chunks_of(parsed)
        held = c.select(F.lit("chunk").alias("kind"), "type", "name", F.get_json_object("metadata", "$.className").alias("of"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))
        start = c.select(F.col("id").alias("source_chunk_id"), F.col("start_line").alias("first"))
        e = raw_edges_of(parsed).join(start, "source_chunk_id")
        return held.unionAll(e.select(F.lit("edge"), "type", F.col("target_symbol"), F.col("target_file_path"), "first", F.lit(None).cast("int")))

    query(f"SELECT kind, type, name, \"of\", first::INT AS first, last::INT AS last FROM (VALUES {values}) AS t(kind, type, name, \"of\", first, last)", f"extract_{language}")(run)


for _language in SAMPLES:
    _sample(_language)


# ------------------------------------------------------------------ writing


@query(f"WITH {X.CHUNKS}, new AS (SELECT id, upper(name) AS name, type FROM chunks WHERE language = 'de' UNION ALL SELECT 'x' || id, name, type FROM chunks WHERE language = 'es') SELECT id, name, type FROM chunks WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new")
def upsert(spark, sf_dir):
    c = X.chunks(spark, sf_dir).select("id", "name", "type", "language")
    new = c.where("language = 'de'").withColumn("name", F.upper("name")).unionAll(c.where("language = 'es'").withColumn("id", F.concat(F.lit("x"), "id")))
    return diff.upsert(c, new).select("id", "name", "type")


@query(f"WITH {X.CHUNKS} SELECT id FROM chunks WHERE type <> 'const'")
def delete_by_ids(spark, sf_dir):
    c = X.chunks(spark, sf_dir).select("id", "type")
    return diff.delete(c, c.where("type = 'const'")).select("id")


@query(f"WITH {X.CHUNKS} SELECT id, file_path FROM chunks WHERE file_path <> 'src3/en'")
def delete_by_file(spark, sf_dir):
    c = X.chunks(spark, sf_dir).select("id", "file_path")
    return diff.delete(c, spark.createDataFrame([("src3/en",)], "file_path string"), "file_path").select("id", "file_path")


@query(f"WITH {X.EDGES} SELECT id FROM edges WHERE source_file_path <> 'supplier' AND target_chunk_id NOT IN (SELECT id FROM entities WHERE type = 'supplier' OR type = 'part')")
def cascade_edge_delete(spark, sf_dir):
    gone = spark.createDataFrame([("supplier",), ("part",)], "file_path string")
    return diff.cascade_edges(X.edges(spark, sf_dir), gone, X.entities(spark, sf_dir).withColumn("file_path", F.col("type"))).select("id")


# ------------------------------------------------------------------ evaluation, streams


@query("""WITH d AS (SELECT a.label AS la, b.label AS lb, a.vec_id AS q, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) - 1 AS rank FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
    h AS (SELECT q, min(rank) FILTER (la = lb) AS r FROM d WHERE rank < 10 GROUP BY q) SELECT k, round(avg(CASE WHEN r < k THEN 1.0 ELSE 0.0 END), 4) AS recall FROM h, (SELECT unnest([1, 5, 10]) AS k) GROUP BY k""")
def recall_at_k(spark, sf_dir):
    """Whether a vector's nearest neighbours include one of its own label."""
    e = X.table(spark, sf_dir, "embeddings")
    label = e.select("vec_id", "label")
    near = knn.nearest_each(e, e, 10, "vec_id", "embedding")
    hit = near.join(label.withColumnRenamed("label", "la"), F.expr("query = vec_id")).drop("vec_id").join(label.withColumnRenamed("label", "lb"), F.expr("id = vec_id"))
    return report.recall_at(hit.groupBy("query").agg(F.min(F.when(F.col("la") == F.col("lb"), F.col("rank"))).alias("hit_rank")))


@query("WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT p, value FROM s, (SELECT unnest([50, 95, 99]) AS p) WHERE i = least(floor(p / 100 * n), n - 1)")
def percentiles(spark, sf_dir):
    return report.percentiles(X.table(spark, sf_dir, "events"), "value")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS events FROM s GROUP BY user_id, burst""")
def debounce_latest_event(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return latest_per_burst(e, "user_id", "ts", "10 minutes", F.col("event_id")).select("user_id", "event_id", "event_type", "events")
