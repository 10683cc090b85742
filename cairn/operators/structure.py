"""Chunk structure by windows and folds: runs of small neighbours, line formats, enclosing chunks, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ANCHORS


def merge_siblings(chunks: DataFrame, min_chars: int, class_col: str = "class_name") -> DataFrame:
    """Joins runs of neighbours that are both short, no anchors, at most two lines apart and of the same class.

    The condition holds between neighbours only, so runs are a running count of its breaks.  A run is named after
    its first chunk and the number of the others.
    """
    order = Window.partitionBy("file_path").orderBy("ord")
    small = ~F.col("type").isin(*ANCHORS) & (F.length("content") < min_chars)
    joined = F.lag(small).over(order) & small & (F.col("start_line") <= F.lag("end_line").over(order) + 2) & F.col(class_col).eqNullSafe(F.lag(class_col).over(order))
    runs = chunks.withColumn("_break", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_break").over(order))
    first = lambda c: F.min_by(c, "ord").alias(c)
    merged = runs.groupBy("file_path", "_run").agg(
        F.min("ord").alias("ord"), first("type"), first("name"), first(class_col), F.count("*").alias("_n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda s: s["content"]), "\n").alias("content"),
        F.min_by("start_line", "ord").alias("start_line"), F.max_by("end_line", "ord").alias("end_line"),
    )
    name = F.when((F.col("_n") > 1) & F.col("name").isNotNull(), F.concat("name", F.lit(" +"), (F.col("_n") - 1).cast("string"))).otherwise(F.col("name"))
    return merged.select("file_path", "ord", "type", name.alias("name"), class_col, "content", "start_line", "end_line")


def lines(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(file_path, line, value), lines from 1; trailing empty lines count."""
    return files.select("file_path", F.posexplode(F.split(text_col, "\n", -1)).alias("_at", "value")).select("file_path", (F.col("_at") + 1).alias("line"), "value")


def boundary_sections(files: DataFrame, name: Column, text_col: str = "text", least: int = 4) -> DataFrame:
    """(file_path, name, start_line, end_line, content) from each boundary line to the next.

    ``name`` maps ``value`` (a line) to the section's name, null elsewhere.  A file with fewer than ``least`` boundaries
    is one section without a name.  Everything happens inside the row, by array functions.
    """
    ls = F.split(text_col, "\n", -1)
    rows = files.select("file_path", ls.alias("_lines"))
    named = F.transform(F.col("_lines"), lambda v, i: F.struct((i + 1).alias("line"), _on(name, v).alias("name")))
    rows = rows.withColumn("_b", F.filter(named, lambda s: s["name"].isNotNull())).withColumn("_n", F.size("_lines"))
    each = F.transform(
        F.col("_b"),
        lambda s, i: F.struct(
            s["name"].alias("name"), s["line"].alias("start_line"),
            (F.coalesce(F.get(F.col("_b"), i + 1)["line"], F.col("_n") + 1) - 1).alias("end_line"),
        ),
    )
    whole = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(1).alias("start_line"), F.col("_n").alias("end_line")))
    rows = rows.select("file_path", "_lines", F.explode(F.when(F.size("_b") >= least, each).otherwise(whole)).alias("s"))
    content = F.array_join(F.slice("_lines", F.col("s.start_line"), F.col("s.end_line") - F.col("s.start_line") + 1), "\n")
    return rows.select("file_path", F.col("s.name"), F.col("s.start_line"), F.col("s.end_line"), content.alias("content"))


def _on(expression: Column, value: Column) -> Column:
    """The expression with ``value`` bound to a lambda's variable."""
    return expression(value) if callable(expression) and not isinstance(expression, Column) else expression


def json_keys(files: DataFrame, text_col: str = "text") -> DataFrame:
    return boundary_sections(files, lambda v: F.nullif(F.regexp_extract(v, r'^ {2}"([^"]+)"\s*:', 1), F.lit("")), text_col)


def yaml_keys(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Keys at column 0, and document marks once a key has been seen; blank sections are dropped."""
    found = boundary_sections(files, lambda v: F.coalesce(F.nullif(F.regexp_extract(v, r"^([a-zA-Z_][a-zA-Z0-9_-]*):", 1), F.lit("")), F.when(v.startswith("---"), F.lit("---"))), text_col, least=0)
    key = Window.partitionBy("file_path").orderBy("start_line")
    seen = F.max(F.when(F.col("name") != "---", 1).otherwise(0)).over(key)
    counted = found.withColumn("_seen", seen).where("_seen = 1").withColumn("_n", F.count("*").over(Window.partitionBy("file_path")))
    split = counted.where("_n >= 4 and content rlike '\\\\S'")
    whole = files.join(counted.where("_n >= 4").select("file_path").distinct(), "file_path", "left_anti")
    n = F.size(F.split(text_col, "\n", -1))
    return split.select("file_path", "name", "start_line", "end_line", "content").unionAll(whole.select("file_path", F.lit(None).cast("string"), F.lit(1), n, F.col(text_col)))


def toml_tables(files: DataFrame, text_col: str = "text") -> DataFrame:
    return boundary_sections(files, lambda v: F.nullif(F.trim(F.regexp_extract(v, r"^\[{1,2}([^\]]+)\]{1,2}", 1)), F.lit("")), text_col)


def headings(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(file_path, line, level, heading, breadcrumb) of the headings of levels 1 to 3.

    The breadcrumb is a stack folded over a file's headings in order: before a heading of level n goes on, it is cut to
    n - 1 entries, whatever the levels of these.
    """
    ls = F.transform(F.split(text_col, "\n", -1), lambda v, i: F.struct((i + 1).alias("line"), F.length(F.regexp_extract(v, r"^(#{1,3})\s+(.+)", 1)).alias("level"), F.trim(F.regexp_extract(v, r"^(#{1,3})\s+(.+)", 2)).alias("heading")))
    rows = files.select("file_path", F.filter(ls, lambda s: s["level"] > 0).alias("_h"))
    entry = "array<struct<line:int,level:int,heading:string,breadcrumb:string>>"
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast(entry).alias("out"))

    def step(acc: Column, h: Column) -> Column:
        stack = F.concat(F.slice(acc["stack"], 1, F.least(F.size(acc["stack"]), h["level"] - 1)), F.array(h["heading"]))
        one = F.struct(h["line"].alias("line"), h["level"].alias("level"), h["heading"].alias("heading"), F.array_join(stack, " > ").alias("breadcrumb"))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(one)).alias("out"))

    return rows.select("file_path", F.explode(F.aggregate("_h", start, step, lambda a: a["out"])).alias("h")).select("file_path", "h.*")


def enclosing(inner: DataFrame, outer: DataFrame, types: tuple[str, ...], strict: bool = False) -> DataFrame:
    """``inner`` with ``parent``: the first chunk of these types, by order, whose lines contain it; null without one."""
    i, o = inner.alias("i"), outer.where(F.col("type").isin(*types)).select("file_path", F.col("start_line").alias("_a"), F.col("end_line").alias("_b"), F.col("name").alias("_name"), F.col("ord").alias("_ord"), F.col("id").alias("_id")).alias("o")
    within = "o._a < i.start_line and o._b > i.end_line" if strict else "o._a <= i.start_line and o._b >= i.end_line"
    best = i.join(o, F.expr(f"i.file_path = o.file_path and {within} and o._id <> i.id")).groupBy(F.col("i.id").alias("id")).agg(F.min_by("o._name", "o._ord").alias("parent"))
    return inner.join(best, "id", "left")


def budget_batches(texts: DataFrame, key: str, order: str, text_col: str, max_chars: int, max_items: int) -> DataFrame:
    """(key, order, batch): greedy batches in order, within a budget of characters and items.

    Rows go through in order as a stream of lengths; a task holds one Arrow batch and three numbers, however many rows a key has.
    """
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, batch, items, chars = True, None, 0, 0, 0
        for b in batches:
            out = []
            for name, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if first or name != last:
                    first, last, batch, items, chars = False, name, 0, 0, 0
                if items and chars + n > max_chars or items >= max_items:
                    batch, items, chars = batch + 1, 0, 0
                items, chars = items + 1, chars + n
                out.append(batch)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.int32())], [key, order, "batch"])

    rows = texts.select(key, order, F.length(F.coalesce(text_col, F.lit(""))).alias("_n"))
    return rows.repartition(key).sortWithinPartitions(key, order, "_n").mapInArrow(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, batch int")
