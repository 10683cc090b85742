"""Plumbing that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Only a session without that setting (a test on one machine) gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = getattr(spark, "_cairn_shared", None)
        if base is None:
            base = spark._cairn_shared = "file://" + tempfile.mkdtemp(prefix="cairn-")
    return f"{base.rstrip('/')}/cairn/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    The result has no lineage: losing an executor afterwards costs no recomputation of
    what came before, and later scans read only the columns they need.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by ``shared_dir`` once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` over whole batches, one in, at most one out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """The column's strings, nulls as empty ones."""
    return [x or "" for x in column.to_pylist()]


def slices(values: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges holding about ``chars`` characters each; every value is in one."""
    start = total = 0
    for i, v in enumerate(values):
        total += len(v)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(values):
        yield start, len(values)
