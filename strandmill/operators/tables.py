"""Subsets, unions, positional joins and exact samples of tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..errors import ArgumentMismatch, IncompatibleTypes, ValidityError, ValueUnavailable
from ..schema import labels_of

SLOTS = 4096


def append(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of tables with the same columns and labels; row_ix goes on where the last table ends."""
    for df in others:
        if dict(df.dtypes) != dict(first.dtypes):
            raise IncompatibleTypes("tables differ in their columns")
        if labels_of(df) != labels_of(first):
            raise ValidityError("tables differ in their column labels")
    every, behind = [first, *others], [0] * (1 + len(others))
    if "row_ix" in first.columns and others:
        # One job gives the largest number of each table but the last.
        ends = [df.agg(F.coalesce(F.max("row_ix"), F.lit(0)).cast("bigint").alias("end")).withColumn("k", F.lit(k)) for k, df in enumerate(every[:-1])]
        for r in reduce(lambda a, b: a.unionByName(b), ends).collect():
            for k in range(r["k"] + 1, len(every)):
                behind[k] += r["end"]
        every = [df.withColumn("row_ix", F.col("row_ix") + n) if n else df for df, n in zip(every, behind)]
    return reduce(lambda a, b: a.unionByName(b), every)


def zip_rows(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("file", "row_ix")) -> DataFrame:
    """Join tables by place; an error if one has rows that the other lacks."""
    mark = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), list(keys), "full")
    if mark.where("_l is null or _r is null").limit(1).count():
        raise ValidityError("the tables differ in their rows")
    return left.join(right, list(keys))


def _numbers(df: DataFrame, values: list[int]) -> DataFrame:
    """Row numbers as a table, so that a plan does not grow with them; Spark broadcasts it if it is small."""
    return df.sparkSession.createDataFrame(pa.table({"row_ix": pa.array(sorted(set(values)), pa.int64())}))


def rows_at(df: DataFrame, places: list[int]) -> DataFrame:
    """Rows by their row_ix, any number of them; negative numbers leave rows out."""
    if any(p < 0 for p in places):
        if any(p > 0 for p in places):
            raise ArgumentMismatch("places are all positive or all negative")
        return df.join(_numbers(df, [-p for p in places]), "row_ix", "left_anti").select(*df.columns)
    return df.join(_numbers(df, places), "row_ix", "left_semi").select(*df.columns)


def replace_rows(df: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` in place of those with the same row_ix."""
    other = [c for c in df.columns if c != "row_ix"]
    joined = df.alias("a").join(new.withColumn("_new", F.lit(True)).alias("b"), "row_ix", "left")
    return joined.select("row_ix", *[F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in other]).select(*df.columns)


def record_ranges(df: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows whose row_ix lies in one of several rising ranges, with the range's number as `batch`.

    Any number of ranges: they go out once, as two sorted arrays (16 bytes a range), and rows are searched for in them
    where they are; the least and the largest number are pushed down.
    """
    at = np.array(ranges, dtype=np.int64).reshape(-1, 2)
    if (at[1:, 0] <= at[:-1, 1]).any():
        raise ArgumentMismatch("ranges must rise and not overlap")
    if (at[:, 1] < at[:, 0]).any():
        raise ArgumentMismatch("ranges must not be empty")
    if not len(at):
        return df.withColumn("batch", F.lit(None).cast("int")).where("false")
    shared = df.sparkSession.sparkContext.broadcast((at[:, 0].copy(), at[:, 1].copy()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = shared.value
        for batch in batches:
            row = batch.column("row_ix").to_numpy(zero_copy_only=False)
            k = np.searchsorted(first, row, side="right") - 1
            inside = (k >= 0) & (row <= last[np.maximum(k, 0)])
            rows = batch.append_column("batch", pa.array(k + 1, pa.int32())).filter(pa.array(inside))
            if rows.num_rows:
                yield rows

    near = df.where(F.col("row_ix").between(int(at[0, 0]), int(at[-1, 1])))
    return near.mapInArrow(find, StructType([*df.schema.fields, StructField("batch", IntegerType())]))


def batches(df: DataFrame, n: int = 1_000_000) -> DataFrame:
    """Rows with the number of their batch of n records."""
    if n < 1:
        raise ArgumentMismatch("'n' must be positive")
    return df.withColumn("batch", F.floor((F.col("row_ix") - 1) / n).cast("bigint") + 1)


def exact_sample(df: DataFrame, n: int, by: tuple[str, ...] = (), seed: int = 0, key: str = "row_ix") -> DataFrame:
    """Exactly n rows (of each group), or all if there are fewer: those with the least hash of their key.

    Counts of 4096 hash slots tell in which slot the n-th row lies; only that slot's rows are ranked.  The same seed
    gives the same rows.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    hashed = hashed.withColumn("_slot", F.shiftrightunsigned("_h", 52).cast("int"))
    sums = hashed.groupBy(*by, "_slot").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by or [F.lit(1)]).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < n)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_slot")]
    rows = hashed.alias("a").join(sums.alias("b"), same).select("a.*", "_before", "_n")
    whole = rows.where(F.col("_before") + F.col("_n") <= n)
    rank = F.row_number().over(Window.partitionBy(*by, "_slot").orderBy(F.shiftrightunsigned("_h", 1), "_h", key))
    part = rows.where(F.col("_before") + F.col("_n") > n).withColumn("_rank", rank).where(F.col("_rank") <= n - F.col("_before"))
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


#: A group with more than this share of all rows is frequent; there are fewer than 10,000 such groups.
FREQUENT = 1e-4


def group_facts(df: DataFrame, keys: list[str], *aggregates) -> DataFrame:
    """Aggregates of each group, by partial sums, and its number of rows as _size."""
    return df.groupBy(*keys).agg(F.count("*").alias("_size"), *aggregates)


def with_group_facts(df: DataFrame, keys: list[str], facts: DataFrame) -> DataFrame:
    """Rows with the columns of `facts`, a table of group_facts(), for their group; nulls are equal.

    The facts of frequent groups, a bounded number, are broadcast to their rows, which stay where they are; only rows of
    other groups are joined by shuffling, and no such group makes a large task.
    """
    names = [c for c in facts.columns if c not in keys]
    total = facts.agg(F.sum("_size").alias("_total"))
    frequent = facts.join(F.broadcast(total), F.col("_size") > F.col("_total") * FREQUENT).drop("_total")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    left, out = df.alias("a"), [*[F.col(f"a.`{c}`") for c in df.columns], *[F.col(f"b.{c}") for c in names]]
    marked = left.join(F.broadcast(frequent).alias("b"), same, "left").select(*out)
    others = marked.where("_size is null").drop(*names).alias("a").join(facts.alias("b"), same).select(*out)
    return marked.where("_size is not null").unionByName(others)


def keyed_lanes(df: DataFrame, lanes: DataFrame, column: str = "lane") -> DataFrame:
    """Names of lanes replaced by their keys (lane, key)."""
    return df.join(lanes.select(F.col("lane").alias(column), "key"), column, "left").drop(column).withColumnRenamed("key", column)


def intensity_cycles(df: DataFrame, first: int, last: int) -> DataFrame:
    """Intensities and errors of some cycles, counted from 1."""
    cols = [c for c in ("intensity", "error") if c in df.columns]
    return df.withColumns({c: F.slice(c, first, last - first + 1) for c in cols})


def intensity_long(df: DataFrame) -> DataFrame:
    """One row for each read, cycle and base."""
    bases = F.array([F.lit(b) for b in "ACGT"])
    cycles = df.select("row_ix", F.posexplode("intensity").alias("c", "v"))
    return cycles.select("row_ix", (F.col("c") + 1).alias("cycle"), F.posexplode("v").alias("b", "value")).select("row_ix", "cycle", F.element_at(bases, F.col("b") + 1).alias("base"), "value")


def read_info(df: DataFrame) -> DataFrame:
    """Where each read of a table of intensities comes from."""
    return df.select(*[c for c in ("file", "row_ix", "lane", "tile", "x", "y") if c in df.columns])


def measurement_error(df: DataFrame) -> DataFrame:
    """The errors of a table of intensities, which it may lack."""
    if "error" not in df.columns:
        raise ValueUnavailable("these intensities have no measurement errors")
    return df.select("row_ix", F.col("error"))


def intensity_shape(df: DataFrame) -> tuple[int, int, int]:
    """Reads, bases and cycles; all reads have the same number of cycles."""
    row = df.agg(F.count("*").alias("reads"), F.min(F.size("intensity")).alias("least"), F.max(F.size("intensity")).alias("most")).first()
    if row["least"] != row["most"]:
        raise ValidityError(f"reads have from {row['least']} to {row['most']} cycles")
    return row["reads"], 4, row["most"] or 0
