"""Changes of a folder as a stream, debounced per path and applied to an index.

Spark's own file source never reports what disappears, so ``FolderChanges`` compares listings: a batch is the difference
between two states.  An offset carries a state's number and hash only; the states lie in a folder of their own, beside the
checkpoint, until the batches that need them are committed.  A file is reported once it hasn't changed for ``stable`` milliseconds,
so a burst of writes to it, or one long write, is one event.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

CHANGES = "path string, event string, ts timestamp"


class _Listing(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.initial = options["path"], options.get("ignoreinitial", "true") != "true"
        self.exclude, self.stable = options.get("exclude"), int(options.get("stable", 0))
        self.system, self.states = fs.FileSystem.from_uri(options["states"] if "://" in options["states"] else "file://" + os.path.abspath(options["states"]))
        self.system.create_dir(self.states, recursive=True)

    # -- states, each a small file named by number and hash

    def _save(self, number: int, state: dict) -> dict:
        raw = json.dumps(state, sort_keys=True).encode()
        offset = {"number": number, "hash": hashlib.sha1(raw).hexdigest()}
        with self.system.open_output_stream(self._file(offset)) as f:
            f.write(raw)
        return offset

    def _file(self, offset: dict) -> str:
        return f"{self.states}/{offset['number']:012d}-{offset['hash']}.json"

    def _load(self, offset: dict) -> dict:
        with self.system.open_input_stream(self._file(offset)) as f:
            return json.loads(f.read())

    def _now(self, before: dict | None) -> dict[str, list]:
        """Each file's time and size; of one that changed a moment ago still what it had before."""
        import re

        skip, out = re.compile(self.exclude) if self.exclude else None, {}
        settled = time.time_ns() - self.stable * 1_000_000
        for folder, _, names in os.walk(self.root):
            for n in names:
                path = os.path.relpath(os.path.join(folder, n), self.root).replace(os.sep, "/")
                if skip and skip.search(path):
                    continue
                try:
                    s = os.stat(os.path.join(folder, n))
                except FileNotFoundError:
                    continue
                own = [s.st_mtime_ns, s.st_size]
                if before is None or own == before.get(path) or s.st_mtime_ns <= settled:
                    out[path] = own
                elif path in before:
                    out[path] = before[path]
        return out

    def initialOffset(self) -> dict:
        return self._save(0, {} if self.initial else self._now(None))

    def _between(self, before: dict, after: dict) -> list[tuple]:
        import datetime

        now = datetime.datetime.now()
        rows = [(p, "add" if p not in before else "change", now) for p in after if before.get(p) != after[p]]
        return rows + [(p, "unlink", now) for p in before if p not in after]

    def read(self, start: dict):
        before = self._load(start)
        after = self._now(before)
        if after == before:
            return iter([]), start
        return iter(self._between(before, after)), self._save(start["number"] + 1, after)

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._between(self._load(start), self._load(end)))

    def commit(self, end: dict) -> None:
        """What lies before a committed offset is read no more; the last few stay in any case."""
        for info in self.system.get_file_info(fs.FileSelector(self.states)):
            if info.base_name.endswith(".json") and int(info.base_name.split("-")[0]) < end["number"] - 2:
                self.system.delete_file(info.path)


class FolderChanges(DataSource):
    """``spark.readStream.format("cairn_changes").option("states", folder_for_states).load(folder)``: (path, event, ts) with event add, change or unlink."""

    @classmethod
    def name(cls) -> str:
        return "cairn_changes"

    def schema(self) -> str:
        return CHANGES

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Listing({k.lower(): v for k, v in self.options.items()})


def latest_per_burst(events: DataFrame, key: str, ts: str, gap: str = "500 milliseconds", order: Column | None = None) -> DataFrame:
    """The last event of every burst of a key: bursts are sessions that end after ``gap`` without an event.

    On a stream, give ``events`` a watermark; bursts are then emitted once it has passed their end.
    """
    at = order if order is not None else F.col(ts)
    last = F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(F.col(ts).alias("a"), at.alias("b")))
    return events.groupBy(key, F.session_window(ts, gap).alias("_w")).agg(last.alias("_e"), F.count("*").alias("events")).select(key, "_e.*", "events")


def apply_changes(indexer, batch: DataFrame, on_event: Callable[[dict], None] | None = None) -> None:
    """The last event of each path in a micro-batch: additions and changes are indexed again, deletions removed, in one commit."""
    last = batch.groupBy("path").agg(F.max_by("event", "ts").alias("event")).collect()  # one row for each path that changed
    changed = [r["path"] for r in last if r["event"] != "unlink"]
    removed = [r["path"] for r in last if r["event"] == "unlink"]
    for event in indexer.index_files(changed, removed):
        if on_event and on_event is not indexer.on_event:
            on_event(event)


def watch(spark: SparkSession, indexer, root: str, checkpoint: str, debounce_ms: int = 500, on_event: Callable[[dict], None] | None = None, exclude: str | None = None):
    """A running query that keeps the index of ``root`` up to date; a file counts as changed once it has been left alone for ``debounce_ms``."""
    spark.dataSource.register(FolderChanges)
    reader = spark.readStream.format("cairn_changes").option("states", checkpoint.rstrip("/") + "-states").option("stable", str(debounce_ms))
    if exclude:
        reader = reader.option("exclude", exclude)
    changes = reader.load(root)
    return changes.writeStream.foreachBatch(lambda df, _: apply_changes(indexer, df, on_event)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{debounce_ms} milliseconds").start()
