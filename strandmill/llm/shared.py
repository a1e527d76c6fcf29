"""What several operators of this subpackage need: tables, durable intermediate results, bounded Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step of a Python operator holds at a time (a longer text is a step of its own).
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a folder of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints"


_OPEN: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def temporary() -> Iterator[list[str]]:
    """A list that learns the folders of all tables that durable() writes meanwhile, but for those that have another one."""
    mine: list[str] = []
    _OPEN.append(mine)
    try:
        yield mine
    finally:
        _OPEN.remove(mine)


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """A query that writes a table meanwhile deletes its shuffle files when it ends.

    Else they stay until the driver happens to collect the objects that stand for them: over large tables a query outlives
    many small collections, these objects count as old, and the files of all steps add up.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def durable(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: short lineage that survives lost executors.

    scratch: a list that learns the folder, for discard() when nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandmill-{uuid.uuid4().hex}"
    with _own_shuffles(spark):
        df.write.parquet(path)
    if scratch is None and _OPEN:
        scratch = _OPEN[-1]
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_files(df: DataFrame) -> bool:
    """Whether df is what a reader of files gave, each file once, with nothing done to it."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    files = list(plan.relation().location().inputFiles())
    return len(files) == len(set(files))


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Delete tables of durable() that no result reads."""
    for name in scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    scratch.clear()


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part have about `limit` bytes."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
