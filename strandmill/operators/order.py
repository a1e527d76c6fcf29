"""Order, rank and repeats of rows.

Order and rank over a whole table come from one distributed sort, whose ranges Spark samples.  As rows leave the sort, each
learns its place in its partition and where the run of its equals began, in one pass over Arrow batches; the sorted rows
are written once, and the table of partitions (rows, first and last key) tells what to add.  Ties are cut between tasks by
row_ix, so neither a common prefix nor a hot key makes a large task.  Strings compare by character code, a shorter prefix
first.

The sorted table lies in the folder that driver and executors share.  `kept` is a list that learns its name, for
sources.files.discard() when the result has been used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..errors import ArgumentMismatch
from ..sources.files import scratch_folder
from .tables import group_facts, with_group_facts


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where values differ; nulls are equal to each other."""
    unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return unequal | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _placed(keys: list[str]):
    """Adds to sorted batches the partition, each row's place in it from 0, and the place where its run of equals began."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, began, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = np.zeros(n, dtype=bool)
            fresh[0] = last is None or any(_differs(batch.column(k)[:1], x)[0] for k, x in zip(keys, last))
            for k in keys:
                fresh[1:] |= _differs(batch.column(k)[1:], batch.column(k)[:-1])
            here = np.arange(at, at + n)
            start = np.maximum.accumulate(np.where(fresh, here, began))
            extra = [pa.array(np.full(n, part), pa.int32()), pa.array(here, pa.int64()), pa.array(start, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "_part", "_at", "_start"])
            at, began, last = at + n, int(start[-1]), [batch.column(k)[-1:] for k in keys]

    return run


def _ordered(df: DataFrame, keys: list[Column], rank: bool, name: str, kept: list[str] | None) -> DataFrame:
    """df with each row's place by keys (nulls last) and row_ix, or the least place of the rows with equal keys."""
    ks = [f"_k{i}" for i in range(len(keys))]
    asc = [F.col(k).asc_nulls_last() for k in ks]
    rows = df.withColumns(dict(zip(ks, keys))).orderBy(*asc, "row_ix")
    own = [StructField("_part", IntegerType()), StructField("_at", LongType()), StructField("_start", LongType())]
    folder = scratch_folder(df.sparkSession)
    rows = rows.mapInArrow(_placed(ks), StructType([*rows.schema.fields, *own]))
    rows.write.parquet(folder)
    if kept is not None:
        kept.append(folder)
    rows = df.sparkSession.read.schema(rows.schema).parquet(folder)
    key = F.struct(*ks)
    more = [F.min_by(key, "_at").alias("_first"), F.max_by(key, "_at").alias("_last"), F.max("_start").alias("_run")] if rank else []
    over = Window.orderBy("_part")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"), *more).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    place = F.col("_before") + F.col("_at") + 1
    if rank:
        # Where a partition begins with the key that the one before ends with, the run began earlier.
        parts = parts.withColumn("_goes_on", F.coalesce(F.col("_first") == F.lag("_last").over(over), F.lit(False)))
        began = F.when(~F.col("_goes_on") | (F.col("_run") > 0), F.col("_before") + F.col("_run") + 1)
        parts = parts.withColumn("_began", F.last(began, ignorenulls=True).over(earlier))
        place = F.when(F.col("_goes_on") & (F.col("_start") == 0), F.col("_began")).otherwise(F.col("_before") + F.col("_start") + 1)
    needed = ["_part", "_before"] + ["_goes_on", "_began"] * rank
    return rows.join(F.broadcast(parts.select(*needed)), "_part").select(*df.columns, place.cast("bigint").alias(name))


def read_order(df: DataFrame, column: str = "sread", kept: list[str] | None = None) -> DataFrame:
    """Each row's place when sorted by a string; equal ones keep their order."""
    return _ordered(df, [F.col(column)], False, "place", kept)


def read_rank(df: DataFrame, column: str = "sread", kept: list[str] | None = None) -> DataFrame:
    """Each row's least place among its equals."""
    return _ordered(df, [F.col(column)], True, "rank", kept)


def sorted_reads(df: DataFrame, column: str = "sread") -> DataFrame:
    return df.orderBy(column, "row_ix")


def duplicated(df: DataFrame, keys: tuple[str, ...] = ("sread",)) -> DataFrame:
    """Whether an earlier row has the same keys (null equals null)."""
    facts = group_facts(df, list(keys), F.min("row_ix").alias("_first"))
    return with_group_facts(df, list(keys), facts).select(*df.columns, (F.col("row_ix") > F.col("_first")).alias("duplicated"))


def level(column: str, levels: list[str] | None) -> Column:
    """A string's place in a list of levels, for orders other than that of characters."""
    if levels is None:
        return F.col(column)
    return F.nullif(F.array_position(F.array([F.lit(x) for x in levels]), F.col(column)), F.lit(0))


def _aligned_keys(with_read: bool | None, chromosomes: list[str] | None) -> list[Column]:
    if with_read is None:
        raise ArgumentMismatch("'with_read' must be true or false")
    return [level("chromosome", chromosomes), level("strand", ["+", "-", "*"]), F.col("position")] + [F.col("sread")] * with_read


def aligned_order(df: DataFrame, with_read: bool = True, chromosomes: list[str] | None = None, kept: list[str] | None = None) -> DataFrame:
    """Places by chromosome, strand, position and read; nulls last."""
    return _ordered(df, _aligned_keys(with_read, chromosomes), False, "place", kept)


def aligned_rank(df: DataFrame, with_read: bool | None = True, chromosomes: list[str] | None = None, kept: list[str] | None = None) -> DataFrame:
    return _ordered(df, _aligned_keys(with_read, chromosomes), True, "rank", kept)


def sorted_alignments(df: DataFrame, with_read: bool = True, chromosomes: list[str] | None = None) -> DataFrame:
    keys = _aligned_keys(with_read, chromosomes)
    return df.orderBy(*[k.asc_nulls_last() for k in keys], "row_ix")


def aligned_duplicated(df: DataFrame, with_read: bool = True) -> DataFrame:
    return duplicated(df, ("chromosome", "strand", "position", "sread")[: 3 + with_read])
