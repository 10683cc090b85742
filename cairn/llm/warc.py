"""WARC files, read in blocks, with record boundaries proved by the chain from each file's start.

Every task takes one block of a file and notes each place where a record could begin (a version
line followed by headers with a length), with the offset its successor must have.  A payload may hold
such places too.  Within its block a task follows each chain to the first offset past the
block, so what goes on is one jump for each candidate.  Pointer jumping from offset 0 then doubles the
jumps, round by round, until the offsets reached no longer grow: in the end each block knows where the true
chain enters it, and a second pass reads the records from there.  The number of rounds is the logarithm
of the number of blocks in the longest file.

Defined results: an empty file gives no rows, an empty folder neither.  A file that doesn't begin with a record gives none either.
A record that goes past the end of its file is returned with ``truncated`` set, its payload as far as it is
there; the chain ends with it, as it does where the successor is no record.  Records of any length are
read, whatever the blocks' size; records that are alike are returned each.  ``write_pages`` writes null urls and texts as empty
ones, a null id as an empty number, repeated rows each, and leaves out other columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

BLOCK = 4 << 20
MAGIC = re.compile(rb"WARC/\d\.\d\r?\n")
LONGEST = 10  # bytes of the longest version line looked for, less one
HEAD = 1 << 16
LENGTH = re.compile(rb"(?im)^content-length[ \t]*:[ \t]*(\d+)[ \t]*\r?$")
END = re.compile(rb"\r?\n\r?\n")
RECORD = "path string, offset long, type string, uri string, date string, record_id string, content_type string, length long, truncated boolean, payload binary"


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _header(file, size: int, at: int, data: bytes, base: int) -> tuple[int, int, bytes] | None:
    """Where the payload begins, its length, and the head, if headers with a length follow at ``at``.

    ``data`` is what was read from ``base`` on; headers that go on past it are read further.
    """
    here, more = data, at - base
    reach = HEAD
    while not (end := END.search(here, more)):
        if base + len(data) >= size and here is data or at + reach >= size and here is not data:
            return None
        reach *= 4
        file.seek(at)
        here, more = file.read(min(reach, size - at)), 0
    head = here[more : end.end()]
    if not (length := LENGTH.search(head)):
        return None
    return at + len(head), int(length[1]), head


def _candidates(file, size: int, start: int, stop: int) -> list[tuple[int, int]]:
    """(offset, successor) of the places in the block where a record could begin."""
    file.seek(start)
    data = file.read(min(size, stop + HEAD) - start)
    out = []
    for m in MAGIC.finditer(data, 0, min(len(data), stop - start + LONGEST)):
        if start + m.start() < stop and (head := _header(file, size, start + m.start(), data, start)):
            out.append((start + m.start(), head[0] + head[1] + 4))
    return out


def _jumps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, size, start, stop in zip(*(b.column(k).to_pylist() for k in ("path", "size", "start", "stop"))):
            with _open(path) as file:
                leave: dict[int, int] = {}
                for at, after in reversed(_candidates(file, size, start, stop)):
                    if after >= stop:
                        leave[at] = after
                    elif after in leave:
                        leave[at] = leave[after]
                    # else the chain breaks inside this block: nothing follows
            yield pa.record_batch([pa.array([path] * len(leave), pa.string()), pa.array(list(leave), pa.int64()), pa.array(list(leave.values()), pa.int64())], ["path", "here", "there"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORD.split(", ")]
    for b in batches:
        for path, size, stop, at in zip(*(b.column(k).to_pylist() for k in ("path", "size", "stop", "here"))):
            rows, held = [], 0
            with _open(path) as file:
                while at < min(stop, size):
                    file.seek(at)
                    data = file.read(HEAD)
                    if not MAGIC.match(data) or not (head := _header(file, size, at, data, at)):
                        break
                    file.seek(head[0])
                    payload = file.read(head[1])
                    fields = {}
                    for line in head[2].decode("utf-8", "replace").splitlines()[1:]:
                        name, colon, value = line.partition(":")
                        if colon:
                            fields.setdefault(name.strip().lower(), value.strip())
                    rows.append((path, at, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-record-id"), fields.get("content-type"), head[1], len(payload) < head[1], payload))
                    at = head[0] + head[1] + 4
                    held += len(payload)
                    if held > 1 << 25:
                        yield _batch(rows, names)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.bool_(), pa.binary()]
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def read_warc(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """The records of the uncompressed WARC files below ``path``: columns as in RECORD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size")).where("size > 0")
    blocks = files.select("path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {block}L)")).alias("start")).withColumn("stop", F.least(F.col("start") + block, "size"))
    blocks = cut(blocks, "warc-blocks")
    # A row is few bytes but a block of work: the number of tasks follows the files' bytes, not what the rows weigh.
    count, total = blocks.agg(F.count("*"), F.sum(F.col("stop") - F.col("start"))).first()
    tasks = max(1, min(count, max(-(-(total or 0) // BLOCK), 2 * spark.sparkContext.defaultParallelism)))
    jumps = cut(blocks.repartition(tasks).mapInArrow(_jumps, "path string, here long, there long"), "warc-jumps")
    reached = files.select("path", F.lit(0).cast("long").alias("here"))
    # Only what some block's chain leads to can be entered; the rest of the candidates end here.
    entries = jumps.select("path", F.col("there").alias("here")).unionAll(reached).distinct()
    steps = cut(jumps.join(entries, ["path", "here"], "left_semi"), "warc-steps")
    reached, known = cut(reached, "warc-reached"), -1
    while known != (now := reached.count()):
        known = now
        ahead = reached.join(steps, ["path", "here"]).select("path", F.col("there").alias("here"))
        reached = cut(reached.unionAll(ahead).distinct(), "warc-reached")
        twice = steps.alias("x").join(steps.alias("y"), F.expr("x.path = y.path and x.there = y.here"), "left")
        steps = cut(twice.select("x.path", "x.here", F.coalesce("y.there", "x.there").alias("there")), "warc-steps")
    entered = reached.withColumn("start", F.expr(f"here - here % {block}"))
    return cut(blocks.join(entered, ["path", "start"]), "warc-entered").repartition(tasks).mapInArrow(_read, RECORD)


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages as WARC files: for each a response record, and a metadata record whose payload quotes that record's own head.

    The text writer's line separator is the two line ends that close a record.
    """
    line = "\r\n"
    body = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}{line}"), F.coalesce("html", F.lit("")))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    uri = F.coalesce("url", F.lit(""))

    def head(kind: str, content: str, payload, mark: str):
        return F.concat(F.lit(f"WARC/1.0{line}WARC-Type: {kind}{line}WARC-Target-URI: "), uri, F.lit(f"{line}WARC-Date: 2024-01-01T00:00:00Z{line}WARC-Record-ID: <urn:page:"), number, F.lit(f":{mark}>{line}Content-Type: {content}{line}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(line + line))

    first = F.concat(head("response", "application/http; msgtype=response", body, "r"), body)
    quote = F.concat(head("response", "application/http; msgtype=response", body, "r"), F.lit("quoted"))
    second = F.concat(head("metadata", "text/plain", quote, "m"), quote)
    pages.select(F.explode(F.array(first, second)).alias("value")).write.option("lineSep", line + line).text(path)
