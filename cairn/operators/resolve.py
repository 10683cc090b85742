"""Symbol resolution: raw edges become edges between chunks, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import edge_id
from .filters import one_per

#: Tried in this order after a path without extension; then the index files.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")
INDEX_FILES = ("index.ts", "index.tsx", "index.js")
COMPILED = ("js", "mjs", "cjs")
COMPILED_FROM = ("ts", "tsx", "mts", "cts")
ALIASES = "ord int, prefix string, suffix string, exact boolean, target string"


def export_map(chunks: DataFrame) -> DataFrame:
    """(file_path, symbol, chunk_id, ord): of equal names the last chunk; ``Class#method`` also answers to its short name where that is free.

    Import chunks and chunks without a name export nothing.
    """
    named = chunks.where("type <> 'import' and coalesce(name, '') <> ''")
    last = named.groupBy("file_path", F.col("name").alias("symbol")).agg(F.max_by("id", "ord").alias("chunk_id"), F.min("ord").alias("ord"))
    short = named.where("name like '%#%'").withColumn("symbol", F.expr("substr(name, instr(name, '#') + 1)"))
    free = short.groupBy("file_path", "symbol").agg(F.min_by("id", "ord").alias("chunk_id"), F.min("ord").alias("ord"))
    return last.unionByName(free.join(last.select("file_path", "symbol"), ["file_path", "symbol"], "left_anti"))


def rewrite_aliases(specifiers: DataFrame, aliases: DataFrame, column: str = "specifier") -> DataFrame:
    """Adds ``aliased``: the first target of the first alias that fits, null where none does."""
    s = F.col(column)
    fits = F.when(F.col("exact"), s == F.col("prefix")).otherwise(s.startswith(F.col("prefix")) & s.endswith(F.col("suffix")) & (F.length(s) >= F.length("prefix") + F.length("suffix")))
    middle = F.substring(s, F.length("prefix") + 1, F.length(s) - F.length("prefix") - F.length("suffix"))
    star = F.instr("target", "*")
    target = F.when(F.col("exact") | (star == 0), F.col("target")).otherwise(F.concat(F.expr("substr(target, 1, instr(target, '*') - 1)"), middle, F.expr("substr(target, instr(target, '*') + 1)")))
    distinct = specifiers.select(column).distinct()
    # The aliases come from one project's configuration.
    best = distinct.join(F.broadcast(aliases), fits).groupBy(column).agg(F.min_by(target, "ord").alias("aliased"))
    return specifiers.join(best, column, "left")


def normalise_path(path):
    """A slash-separated path without ``.`` and ``..``; going above the root gives null."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    up = F.lit("..")
    done = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("s"), F.lit(True).alias("ok")),
        lambda a, p: F.when(
            p == up,
            F.struct(F.slice(a["s"], 1, F.greatest(F.size(a["s"]) - 1, F.lit(0))).alias("s"), (a["ok"] & (F.size(a["s"]) > 0)).alias("ok")),
        ).otherwise(F.struct(F.concat(a["s"], F.array(p)).alias("s"), a["ok"].alias("ok"))),
    )
    return F.when(done["ok"], F.array_join(done["s"], "/"))


def candidates(base):
    """The paths tried for an import, in order."""
    name = F.element_at(F.split(base, "/"), -1)
    ext = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext) - 1)
    mapped = F.concat(F.array(base), F.when(ext.isin(*COMPILED), F.array(*[F.concat(stem, F.lit("." + e)) for e in COMPILED_FROM])).otherwise(F.array().cast("array<string>")))
    bare = F.array(*[F.concat(base, F.lit("." + e)) for e in EXTENSIONS], *[F.concat(base, F.lit("/" + f)) for f in INDEX_FILES])
    return F.when(name.rlike(r"^.+\.[^.]*$"), mapped).otherwise(bare)


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``imports`` (from_file, specifier) with ``target``: the file it leads to, null for what lies outside.

    An alias is tried first, then relative paths; the candidates meet the file list in one equi-join and the
    first in order wins.
    """
    spark = imports.sparkSession
    keys = imports.select("from_file", "specifier").distinct()
    aliased = rewrite_aliases(keys, aliases if aliases is not None else spark.createDataFrame([], ALIASES))
    folder = F.regexp_replace("from_file", r"[^/]*$", "")
    base = F.when(F.col("aliased").isNotNull(), normalise_path(F.col("aliased"))).when(F.col("specifier").startswith("."), normalise_path(F.concat(folder, F.col("specifier"))))
    tried = aliased.withColumn("_base", base).where("_base is not null").select("from_file", "specifier", F.posexplode(candidates(F.col("_base"))).alias("_at", "path"))
    known = files.select(F.col("file_path").alias("path")).distinct()
    best = tried.join(known, "path").groupBy("from_file", "specifier").agg(F.min_by("path", "_at").alias("target"))
    return imports.join(best, ["from_file", "specifier"], "left")


def resolve_all(raw_edges: DataFrame, chunks: DataFrame, files: DataFrame, project: str, aliases: DataFrame | None = None) -> DataFrame:
    """Edges: DEFINES carry their target's id, IMPORTS lead to the target file's import chunk or else its first symbol,
    edges with a file hint to the symbol in that file, the others to the symbol in the first other file (by path)
    that exports it.  Unresolved edges, those to themselves and repeated ids are dropped; of equal ids the first stays."""
    exports = export_map(chunks)
    hinted = raw_edges.where("type <> 'DEFINES' and coalesce(target_file_path, '') <> ''")
    pairs = hinted.select(F.col("source_file_path").alias("from_file"), F.col("target_file_path").alias("specifier"))
    found = resolve_imports(pairs.distinct(), files, aliases).where("target is not null").select(F.col("from_file").alias("source_file_path"), F.col("specifier").alias("target_file_path"), F.col("target").alias("_file"))
    hinted = hinted.join(found, ["source_file_path", "target_file_path"])
    import_chunk = one_per(chunks.where("type = 'import'"), "file_path", F.desc("ord")).select(F.col("file_path").alias("_file"), F.col("id").alias("_import"))
    first = exports.groupBy(F.col("file_path").alias("_file")).agg(F.min_by("chunk_id", "ord").alias("_first"))
    columns = raw_edges.columns
    by_import = hinted.where("type = 'IMPORTS'").join(import_chunk, "_file", "left").join(first, "_file", "left").withColumn("target_chunk_id", F.coalesce("_import", "_first"))
    symbols = exports.select(F.col("file_path").alias("_file"), F.col("symbol").alias("target_symbol"), F.col("chunk_id").alias("target_chunk_id"))
    by_hint = hinted.where("type <> 'IMPORTS'").join(symbols, ["_file", "target_symbol"])
    # Of each symbol the first two files are enough: one of them is another than the source.
    two = one_per_two(exports)
    free = raw_edges.where("type <> 'DEFINES' and coalesce(target_file_path, '') = ''").join(two.withColumnRenamed("symbol", "target_symbol"), "target_symbol")
    free = free.withColumn("target_chunk_id", F.when(F.col("_file1") != F.col("source_file_path"), F.col("_chunk1")).otherwise(F.col("_chunk2")))
    own = raw_edges.where("type = 'DEFINES'").withColumn("target_chunk_id", F.col("target_symbol"))
    parts = [p.select(*columns, "target_chunk_id") for p in (own, by_import, by_hint, free)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("target_chunk_id is not null and target_chunk_id <> source_chunk_id")
    made = every.withColumn("project_id", F.lit(project)).withColumn("id", edge_id("project_id", "source_chunk_id", "target_chunk_id", "type"))
    kept = one_per(made, "id", F.col("source_file_path"), F.col("ord"))
    return kept.select("id", "project_id", "source_chunk_id", "source_file_path", "target_chunk_id", "type", "metadata")


def one_per_two(exports: DataFrame) -> DataFrame:
    """(symbol, _file1, _chunk1, _file2, _chunk2): the first two exporting files of each symbol, by path."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("symbol").orderBy("file_path"))
    near = exports.withColumn("_n", n).where("_n <= 2")
    pick = lambda k, c: F.max(F.when(F.col("_n") == k, F.col(c)))
    return near.groupBy("symbol").agg(pick(1, "file_path").alias("_file1"), pick(1, "chunk_id").alias("_chunk1"), pick(2, "file_path").alias("_file2"), pick(2, "chunk_id").alias("_chunk2"))


def aliases_frame(spark: SparkSession, aliases: list[tuple[str, list[str]]]) -> DataFrame:
    """From (pattern, targets) in order; only the first target of a pattern counts."""
    rows = []
    for n, (pattern, targets) in enumerate(aliases):
        if targets:
            prefix, star, suffix = pattern.partition("*")
            rows.append((n, prefix, suffix, not star, targets[0]))
    return spark.createDataFrame(rows, ALIASES)
