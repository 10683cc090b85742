"""Queries through an index: a small project written down here, and a store of all documents, vectors and keys.

Both are built once a session in the shared folder.  What the project must give is listed in the SQL; what the store
must give is computed by it.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..embedding.base import HashEmbedder
from ..functions import text as T
from ..operators import filters
from ..operators.shared import shared_dir
from ..operators.store import IndexStore, Snapshots
from ..sources import scan, settings
from . import catalogue as C
from . import fixtures as X
from .catalogue import query
from .indexer import Indexer

FILES = {
    "lib/shape.ts": "export interface Shape { area(): number }\nexport function scaled(x: number): number {\n  return x * 2;\n}\n",
    "lib/circle.ts": "import { Shape, scaled } from './shape';\n\nexport class Circle implements Shape {\n  area(): number {\n    return scaled(3);\n  }\n}\n",
    "app.ts": "import { Circle } from '@lib/circle';\n\nexport function paint(): number {\n  const c = new Circle();\n  return scaled(c.area());\n}\n",
    "tools/report.py": "from math import floor\n\ndef summarise(rows):\n    return floor(len(rows))\n",
    "docs/guide.md": "# Guide\nHow to paint a circle.\n## Colours\nPick some.\n",
    "tsconfig.json": '{\n  // paths\n  "compilerOptions": { "baseUrl": ".", "paths": { "@lib/*": ["lib/*"] } }\n}\n',
    "build/out.js": "function gone() {}\n",
    "notes.log": "noise\n",
    "pkg/.gitignore": "dist/\n",
    "pkg/dist/a.js": "function hidden() {}\n",
    "pkg/b.js": "function shown() { return 1; }\n",
    "node_modules/x/index.js": "function third() {}\n",
    ".gitignore": "*.log\n# a comment\n",
    "evaluation.jsonl": '{"query": "paint", "expectedFile": "app.ts", "expectedSymbol": "paint"}\n\n{"query": "summarise rows", "expectedFile": "tools/report.py"}\n{"query": "nothing of that", "expectedFile": "x.ts"}\n',
    "cairn.toml": "[embedder]\nservice = 'jina'\n",
}
EXCLUDED = ["build/**", "evaluation.jsonl", "cairn.toml", "tsconfig.json"]
_open: dict[tuple, object] = {}


def _once(spark: SparkSession, name: str, make):
    key = (spark.sparkContext.applicationId, name)
    if key not in _open:
        _open[key] = make()
    return _open[key]


def _folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, which has to be mounted everywhere: the small project is written as plain files."""
    path = shared_dir(spark, name).removeprefix("file://")
    if "://" in path:
        raise ValueError("these queries need a shared folder that is mounted on every machine")
    return path


def _written(spark: SparkSession) -> str:
    root = _folder(spark, "project")
    for path, text in FILES.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(text)
    return root


def project_root(spark: SparkSession) -> str:
    return _once(spark, "root", lambda: _written(spark))


def _built(spark: SparkSession, root: str, **options) -> Indexer:
    ix = Indexer(spark, root, _folder(spark, "index"), exclude=EXCLUDED, buckets=2, **options)
    ix.initialize()
    ix.index_project()
    return ix


def project(spark: SparkSession) -> Indexer:
    return _once(spark, "project", lambda: _built(spark, project_root(spark)))


def listed(columns: str, rows: list[tuple], types: str = "") -> str:
    """SQL of literal rows; ``types``: casts of some columns, as name:type."""
    cast = dict(t.split(":") for t in types.split())
    names = [f'"{n}"' for n in columns.split()]
    shown = ", ".join(f"{n}::{cast[n[1:-1]]} AS {n}" if n[1:-1] in cast else n for n in names)
    values = ", ".join("(" + ", ".join(C._literal(x) for x in r) + ")" for r in rows)
    return f"SELECT {shown} FROM (VALUES {values}) AS t({', '.join(names)})"


# ------------------------------------------------------------------ files

_KEPT = {"lib/shape.ts": "typescript", "lib/circle.ts": "typescript", "app.ts": "typescript", "tools/report.py": "python", "docs/guide.md": "markdown", "pkg/b.js": "javascript"}
_FILE_ROWS = ", ".join(f"({C._literal(p)}, {C._literal(FILES[p])}, {C._literal(k)})" for p, k in _KEPT.items())


@query(f"SELECT file_path, sha1(text) AS sha1, octet_length(encode(text)) AS size, language, text FROM (VALUES {_FILE_ROWS}) AS t(file_path, text, language)")
def project_scan(spark, sf_dir):
    """A scan with default excludes, ignore files in two folders and excludes of its own."""
    files = scan.scan(spark, project_root(spark), None, [*EXCLUDED, "**/.gitignore"])
    return files.select("file_path", "sha1", "size", "language", "text")


@query(listed("file_path", [("lib/shape.ts",), ("lib/circle.ts",), ("app.ts",), ("pkg/dist/a.js",), ("pkg/b.js",), ("build/out.js",), ("node_modules/x/index.js",)]))
def project_scan_bare(spark, sf_dir):
    """Include patterns alone, no rule by default."""
    return scan.scan(spark, project_root(spark), ["**/*.ts", "**/*.js"], defaults=False).select("file_path")


@query(listed("query expectedFile expectedSymbol", [("paint", "app.ts", "paint"), ("summarise rows", "tools/report.py", None), ("nothing of that", "x.ts", None)]))
def project_eval_set(spark, sf_dir):
    return scan.eval_set(spark, project_root(spark) + "/evaluation.jsonl")


@query(listed("pattern target", [("@lib/*", "lib/*")]))
def project_aliases(spark, sf_dir):
    rows = [(p, t) for p, targets in settings.path_aliases(project_root(spark)) for t in targets]
    return spark.createDataFrame(rows, "pattern string, target string")


# ------------------------------------------------------------------ what is made of them

#: File, type, name, first and last line, characters with breadcrumb, imports and class header.
_CHUNKS = [
    ("app.ts", "import", None, 1, 1, 37), ("app.ts", "function", "paint", 3, 6, 147), ("docs/guide.md", "section", "Guide", 1, 2, 37), ("docs/guide.md", "section", "Colours", 3, 5, 38),
    ("lib/circle.ts", "import", None, 1, 1, 40), ("lib/circle.ts", "class", "Circle", 3, 7, 145), ("lib/circle.ts", "method", "area", 4, 6, 160),
    ("lib/shape.ts", "interface", "Shape", 1, 1, 62), ("lib/shape.ts", "function", "scaled", 2, 4, 82), ("pkg/b.js", "function", "shown", 1, 1, 50),
    ("tools/report.py", "import", None, 1, 1, 22), ("tools/report.py", "function", "summarise", 3, 4, 96),
]
_EDGES = [
    ("CALLS", "area", "lib/circle.ts", "scaled", "lib/shape.ts"), ("CALLS", "paint", "app.ts", "Circle", "lib/circle.ts"), ("CALLS", "paint", "app.ts", "area", "lib/circle.ts"), ("CALLS", "paint", "app.ts", "scaled", "lib/shape.ts"),
    ("DEFINES", "import", "app.ts", "paint", "app.ts"), ("DEFINES", "import", "lib/circle.ts", "Circle", "lib/circle.ts"), ("DEFINES", "import", "lib/circle.ts", "area", "lib/circle.ts"), ("DEFINES", "import", "tools/report.py", "summarise", "tools/report.py"),
    ("IMPORTS", "import", "app.ts", "import", "lib/circle.ts"), ("IMPORTS", "import", "lib/circle.ts", "scaled", "lib/shape.ts"),
]
_OUTLINE = "app.ts\n  function paint (3-6)\n\nlib/circle.ts\n  class Circle (3-7)\n  method area (4-6)\n\nlib/shape.ts\n  interface Shape (1-1)\n  function scaled (2-4)\n\npkg/b.js\n  function shown (1-1)\n\ntools/report.py\n  function summarise (3-4)"
_JSON = json.dumps([{"file": "lib/circle.ts", "symbols": [{"type": "class", "name": "Circle", "startLine": 3, "endLine": 7}, {"type": "method", "name": "area", "startLine": 4, "endLine": 6}]}], indent=2)


@query(f"SELECT c.file_path, type, name, a::INT AS start_line, b::INT AS end_line, md5(rtrim(array_to_string(string_split(text, chr(10))[a:b], chr(10)), chr(10))) AS content_md5, n::INT AS context_length FROM ({listed('file_path type name a b n', _CHUNKS)}) c JOIN (VALUES {_FILE_ROWS}) AS t(file_path, text, language) ON t.file_path = c.file_path")
def project_chunks(spark, sf_dir):
    return project(spark).store.chunks.select("file_path", "type", "name", "start_line", "end_line", F.md5("content").alias("content_md5"), F.length("context_content").alias("context_length"))


@query(listed("type source source_file target target_file", _EDGES))
def project_edges(spark, sf_dir):
    s = project(spark).store
    end = lambda side: s.chunks.select(F.col("id").alias(f"{side}_chunk_id"), F.coalesce("name", "type").alias(side), F.col("file_path").alias(f"{side}_file"))
    return s.edges.join(end("source"), "source_chunk_id").join(end("target"), "target_chunk_id").select("type", "source", "source_file", "target", "target_file")


# ------------------------------------------------------------------ asking it


def _hits(df: DataFrame) -> DataFrame:
    return df.select("rank", "match_type", "file_path", F.coalesce("name", "type").alias("name"))


@query(listed("rank match_type file_path name", [(0, "lexical", "lib/circle.ts", "Circle"), (1, "lexical", "app.ts", "import"), (2, "lexical", "app.ts", "paint"), (3, "lexical", "lib/circle.ts", "area")]))
def project_search(spark, sf_dir):
    """Without an embedder a search is lexical."""
    return _hits(project(spark).search("circle area", model.SearchOptions(limit=4)))


@query(listed("rank match_type file_path name", [(0, "lexical", "docs/guide.md", "Guide")]))
def project_search_filtered(spark, sf_dir):
    return _hits(project(spark).search_lexical("paint circle", model.SearchOptions(limit=5, language="markdown")))


@query(listed("file_path name", [("tools/report.py", "summarise"), ("tools/report.py", "import")]))
def project_context(spark, sf_dir):
    """One hit, filled up with its neighbours."""
    found = project(spark).search_with_context("summarise", model.ContextOptions(limit=6)).select("file_path", F.coalesce("name", "type").alias("name"))
    return found


@query(listed("hop direction type name", [(1, "incoming", "CALLS", "paint"), (1, "incoming", "DEFINES", "import"), (2, "incoming", "DEFINES", "import"), (2, "incoming", "IMPORTS", "import"), (2, "outgoing", "CALLS", "area"), (2, "outgoing", "CALLS", "scaled"), (2, "outgoing", "DEFINES", "area"), (2, "outgoing", "IMPORTS", "scaled")]))
def project_neighbourhood(spark, sf_dir):
    ix = project(spark)
    circle = ix.store.chunks.where("name = 'Circle'").first()["id"]
    return ix.neighbourhood(circle, model.TraversalOptions(depth=2)).select("hop", "direction", "type", F.coalesce("chunk_name", "chunk_type").alias("name"))


@query(listed("of relation name", [("scaled", "callers", "area"), ("scaled", "callers", "paint"), ("paint", "callees", "Circle"), ("paint", "callees", "area"), ("paint", "callees", "scaled"), ("app.ts", "dependencies", "lib/circle.ts"), ("lib/circle.ts", "dependencies", "lib/shape.ts"), ("lib/circle.ts", "dependents", "app.ts")]))
def project_related(spark, sf_dir):
    ix = project(spark)
    ids = {r["name"]: r["id"] for r in ix.store.chunks.where("name is not null").select("name", "id").collect()}
    out = None
    for of, relation in (("scaled", "callers"), ("paint", "callees"), ("Shape", "implementors"), ("Circle", "supertypes"), ("scaled", "usages")):
        part = ix.related(ids[of], relation).select(F.lit(of).alias("of"), F.lit(relation).alias("relation"), "name")
        out = part if out is None else out.unionAll(part)
    for path in ("app.ts", "lib/circle.ts", "lib/shape.ts"):
        for relation in ("dependencies", "dependents"):
            out = out.unionAll(getattr(ix, relation)(path).select(F.lit(path), F.lit(relation), F.col("file_path")))
    return out


@query(listed("format map", [("text", _OUTLINE), ("json", _JSON)]))
def project_map(spark, sf_dir):
    """The repository map as text and as JSON, files with most symbols first where they are limited."""
    ix = project(spark)
    rows = [("text", ix.repo_map(model.RepoMapOptions())), ("json", ix.repo_map(model.RepoMapOptions(format="json", max_files=1)))]
    return spark.createDataFrame(rows, "format string, map string")


@query(listed("figure n", [("total_chunks", 12), ("total_files", 6), ("total_edges", 10), ("by_language.typescript", 7), ("by_language.markdown", 2), ("by_language.python", 2), ("by_language.javascript", 1), ("by_type.function", 4), ("by_type.import", 3), ("by_type.section", 2), ("by_type.class", 1), ("by_type.interface", 1), ("by_type.method", 1), ("by_edge_type.CALLS", 4), ("by_edge_type.DEFINES", 4), ("by_edge_type.IMPORTS", 2)], "n:BIGINT"))
def project_stats(spark, sf_dir):
    s = project(spark).stats()
    rows = [(k, s[k]) for k in ("total_chunks", "total_files", "total_edges")] + [(f"{m}.{k}", n) for m in ("by_language", "by_type", "by_edge_type") for k, n in s[m].items()]
    return spark.createDataFrame(rows, "figure string, n long")


@query(listed("k recall", [(1, "0.6667"), (5, "0.6667")], "k:BIGINT recall:DOUBLE"))
def project_recall(spark, sf_dir):
    ix = project(spark)
    return ix.evaluate(scan.eval_set(spark, project_root(spark) + "/evaluation.jsonl"), (1, 5)).select(F.col("k").cast("long").alias("k"), "recall")


@query(listed("run event file_path reason chunks", [(1, "indexed", "app.ts", "new", 2), (1, "indexed", "docs/guide.md", "new", 2), (1, "indexed", "lib/circle.ts", "new", 3), (1, "indexed", "lib/shape.ts", "new", 2), (1, "indexed", "pkg/b.js", "new", 1), (1, "indexed", "tools/report.py", "new", 2), (2, "indexed", "lib/shape.ts", "changed", 3), (2, "indexed", "new.py", "new", 1), (2, "removed", "docs/guide.md", None, None), (3, "removed", "new.py", None, None)]))
def project_changes(spark, sf_dir):
    """Events of a first and of a second indexing, between which one file changed, one went and one came."""

    def run():
        root, told = _written(spark), []
        ix = _built(spark, root, on_event=told.append)
        rows = [(1, e["type"], e["file_path"], e.get("reason"), e.get("chunks_affected")) for e in told]
        told.clear()
        with open(f"{root}/lib/shape.ts", "a") as f:
            f.write("export function halved(x: number): number {\n  return x / 2;\n}\n")
        os.remove(f"{root}/docs/guide.md")
        with open(f"{root}/new.py", "w") as f:
            f.write("def fresh():\n    return 1\n")
        ix.index_project()
        rows += [(2, e["type"], e["file_path"], e.get("reason"), e.get("chunks_affected")) for e in told]
        told.clear()
        ix.index_project()  # nothing changed
        ix.remove_file("new.py")
        rows += [(3, e["type"], e["file_path"], e.get("reason"), e.get("chunks_affected")) for e in told]
        ix.close()
        return rows

    return spark.createDataFrame(_once(spark, "changes", run), "run int, event string, file_path string, reason string, chunks int")


@query(listed("match_type n", [("hybrid", 1), ("semantic", 1)]))
def project_hybrid(spark, sf_dir):
    """With an embedder a search is hybrid, semantic where hybrid is switched off; the best hit of each."""
    ix = _once(spark, "embedded", lambda: _built(spark, project_root(spark), embedder=HashEmbedder(64), reranker=lambda q, texts: [float("paint" in t) for t in texts]))
    both = ix.search("paint a circle", model.SearchOptions(limit=3)).where("rank = 0").select("match_type", F.lit(1).alias("n"))
    alone = ix.search("summarise rows", model.SearchOptions(limit=2, hybrid=False)).where("rank = 0").select("match_type", F.lit(1))
    return both.unionAll(alone)


# ------------------------------------------------------------------ a store of the benchmark tables


def store(spark: SparkSession, sf_dir: str) -> IndexStore:
    def make():
        s = IndexStore(Snapshots(spark, _folder(spark, "store"), 8), 64, "table")
        c = X.chunks(spark, sf_dir)
        full = c.withColumns({k: F.lit(None).cast("string") for k in ("content", "context_content", "metadata")})
        v = X.table(spark, sf_dir, "embeddings").select(F.format_string("d%08d", "vec_id").alias("chunk_id"), "embedding")
        s.upsert(full, v)
        s.upsert_edges(X.edges(spark, sf_dir))
        s.optimize(ann_rows=1)
        return s

    return _once(spark, "store " + sf_dir, make)


@query(C.ORACLES["bm25_topk"])
def store_search_text(spark, sf_dir):
    """BM25 from the store's postings, over all documents."""
    return C._shown(store(spark, sf_dir).search_text(C.QUERY, C.K))


@query(C.ORACLES["bm25_filtered"])
def store_search_text_filtered(spark, sf_dir):
    return C._shown(store(spark, sf_dir).search_text(C.QUERY, C.K, language="en", file_path="src1*"))


@query(C.ORACLES["phrase_match"])
def store_search_phrase(spark, sf_dir):
    return C._shown(store(spark, sf_dir).search_text("on-the en.le", C.K))


@query(C.ORACLES["like_fallback"])
def store_search_literal(spark, sf_dir):
    return store(spark, sf_dir).search_text("@", C.K).select("id", F.col("rank").cast("long").alias("rank"))


_OWN = "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1), near AS (SELECT vec_id, list_distance(embedding::DOUBLE[], (SELECT e FROM q)) AS d FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents {where})) SELECT format('d{{:08d}}', vec_id) AS id, round(d, 6) AS dist, row_number() OVER (ORDER BY d, vec_id) - 1 AS rank FROM near ORDER BY d, vec_id LIMIT 10"


def _vectors(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(_OWN.format(where=""))
def store_search_vector(spark, sf_dir):
    """Through the inverted file that ``optimize`` made; vectors without a chunk aren't kept."""
    return _vectors(store(spark, sf_dir).search_vector(C._probe_vector(spark, sf_dir), C.K))


@query(_OWN.format(where="WHERE lang = 'de'"))
def store_search_vector_filtered(spark, sf_dir):
    return _vectors(store(spark, sf_dir).search_vector(C._probe_vector(spark, sf_dir), C.K, language="de"))


@query("WITH a AS (" + _OWN.format(where="").replace("LIMIT 10", "LIMIT 30") + "), b AS (SELECT a.* FROM a JOIN documents ON id = format('d{:08d}', doc_id) WHERE lang = 'de') SELECT id, dist, row_number() OVER (ORDER BY rank) - 1 AS rank FROM b ORDER BY rank LIMIT 10")
def store_search_vector_after(spark, sf_dir):
    """Filters applied to three times as many as asked for."""
    return _vectors(store(spark, sf_dir).search_vector(C._probe_vector(spark, sf_dir), C.K, language="de", post_filter=3))


@query(f"WITH {X.CHUNKS} SELECT id, type, start_line FROM chunks WHERE id IN ('d00000003', 'd00000017') OR file_path = 'src2/en'")
def store_look_ups(spark, sf_dir):
    s = store(spark, sf_dir)
    return s.get(["d00000003", "d00000017"]).unionByName(s.chunks_by_file("src2/en")).distinct().select("id", "type", "start_line")


@query(f"WITH {X.EDGES} SELECT id, 'out' AS side FROM edges WHERE source_chunk_id = 'n:3' UNION ALL SELECT id, 'in' FROM edges WHERE target_chunk_id = 'n:3' AND type = 'IMPLEMENTS'")
def store_edges(spark, sf_dir):
    s = store(spark, sf_dir)
    return s.outgoing("n:3").select("id", F.lit("out").alias("side")).unionAll(s.incoming("n:3", ("IMPLEMENTS",)).select("id", F.lit("in")))


@query(f"WITH {X.CHUNKS}, {X.EDGES} SELECT 'chunks' AS what, count(*) AS n FROM chunks UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'files', count(DISTINCT file_path) FROM chunks UNION ALL SELECT language, count(*) FROM chunks GROUP BY language UNION ALL SELECT type, count(*) FROM chunks GROUP BY type UNION ALL SELECT type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'symbols', count(*) FROM chunks WHERE name IS NOT NULL AND type IN ('function', 'class')")
def store_counts(spark, sf_dir):
    s = store(spark, sf_dir)
    single = spark.createDataFrame([("chunks", s.count()), ("edges", s.count_edges()), ("files", s.list_files().count()), ("symbols", s.symbols().count())], "what string, n long")
    return single.unionAll(s.count_by_language().select("language", "n")).unionAll(s.count_by_type().select("type", "n")).unionAll(s.count_edges_by_type().select("type", "n"))


def _changed(spark: SparkSession, sf_dir: str) -> IndexStore:
    """Another store, written to in all ways."""

    def make():
        s = IndexStore(Snapshots(spark, _folder(spark, "changed"), 8))
        c = X.chunks(spark, sf_dir).withColumns({k: F.lit(None).cast("string") for k in ("content", "context_content", "metadata")})
        s.upsert(c)
        s.upsert(c.where("language = 'de'").withColumn("name", F.upper("name")).withColumn("search_content", F.lit("changed text")))
        s.delete(["d00000003", "d00000017", "nobody"])
        s.delete_by_file("src3/en")
        e = X.edges(spark, sf_dir)
        s.upsert_edges(e)
        s.upsert_edges(e.where("type = 'EXTENDS'").withColumn("metadata", F.lit('{"again": 1}')))
        s.delete_edges_by_file("supplier")
        s.delete_edges_by_target(["n:3", "r:1"])
        s.optimize()
        return s

    return _once(spark, "changed " + sf_dir, make)


@query(f"WITH {X.CHUNKS} SELECT id, CASE WHEN language = 'de' THEN upper(name) ELSE name END AS name FROM chunks WHERE id NOT IN ('d00000003', 'd00000017') AND file_path <> 'src3/en'")
def store_written_chunks(spark, sf_dir):
    return _changed(spark, sf_dir).chunks.select("id", "name")


@query(f"WITH {X.EDGES} SELECT id, CASE WHEN type = 'EXTENDS' THEN '{{\"again\": 1}}' ELSE '{{}}' END AS metadata FROM edges WHERE source_file_path <> 'supplier' AND target_chunk_id NOT IN ('n:3', 'r:1')")
def store_written_edges(spark, sf_dir):
    return _changed(spark, sf_dir).edges.select("id", "metadata")


@query(f"WITH {X.CHUNKS}, kept AS (SELECT id, CASE WHEN language = 'de' THEN 'changed text' ELSE search_content END AS t FROM chunks WHERE id NOT IN ('d00000003', 'd00000017') AND file_path <> 'src3/en') SELECT id, len(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+'))::INT AS dl, len(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+'), lambda x: x IN ('changed', 'the')))::INT AS tf FROM kept".replace("\\\\", "\\"))
def store_written_postings(spark, sf_dir):
    """What the full-text index holds after all that was written."""
    s = _changed(spark, sf_dir).snapshots
    tf = s.table("postings").where("term in ('changed', 'the')").groupBy("chunk_id").agg(F.sum("tf").cast("int").alias("tf"))
    return s.table("lengths").join(tf, "chunk_id", "left").select(F.col("chunk_id").alias("id"), "dl", F.coalesce("tf", F.lit(0)).alias("tf"))
