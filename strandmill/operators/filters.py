"""Named row filters that combine with &, | and ~ and report how many rows each part passes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentMismatch, ReadsError, one_of
from ..functions.sequence import dusty_score, edit_distance, most_frequent_letter, other_count
from ..schema import require
from .tables import group_facts, with_group_facts

STATS = "position int, name string, input bigint, passing bigint, op string"


class ReadFilter:
    """A boolean column builder with a name.

    `prepare` may add columns that the test needs; they are dropped again.  Rows whose test is null do not pass.
    """

    def __init__(self, name: str, test: Callable[[DataFrame], Column] | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, op: str | None = None, parts: tuple = ()):
        self.name, self.test, self.prepare, self.op, self.parts = name, test or (lambda df: F.lit(True)), prepare, op, parts

    def column(self, df: DataFrame) -> Column:
        if self.op == "!":
            return ~self.parts[0].column(df)
        if self.op:
            a, b = (p.column(df) for p in self.parts)
            return a & b if self.op == "&" else a | b
        return F.coalesce(self.test(df), F.lit(False))

    def prepared(self, df: DataFrame) -> DataFrame:
        for part in self.parts:
            df = part.prepared(df)
        return self.prepare(df) if self.prepare else df

    def __call__(self, df: DataFrame) -> DataFrame:
        """The rows that pass."""
        ready = self.prepared(df)
        return ready.where(self.column(ready)).select(*df.columns)

    def marked(self, df: DataFrame, name: str = "passes") -> DataFrame:
        """All rows, with a column that tells whether they pass."""
        ready = self.prepared(df)
        return ready.withColumn(name, self.column(ready)).select(*df.columns, name)

    def __and__(self, other: ReadFilter) -> ReadFilter:
        return ReadFilter(f"({self.name} & {other.name})", op="&", parts=(self, other))

    def __or__(self, other: ReadFilter) -> ReadFilter:
        return ReadFilter(f"({self.name} | {other.name})", op="|", parts=(self, other))

    def __invert__(self) -> ReadFilter:
        return ReadFilter(f"!({self.name})", op="!", parts=(self,))

    def nodes(self) -> list[ReadFilter]:
        """Operands first, each before what combines it."""
        return [n for p in self.parts for n in p.nodes()] + [self]

    def stats(self, df: DataFrame) -> DataFrame:
        """A row for each part: position, name, rows in, rows that pass, operator; one pass over the table."""
        ready, nodes = self.prepared(df), self.nodes()
        tests = [F.struct(F.lit(i + 1).alias("position"), F.lit(n.name).alias("name"), n.column(ready).alias("ok"), F.lit(n.op).cast("string").alias("op")) for i, n in enumerate(nodes)]
        sums = ready.select(F.array(*tests).alias("t")).agg(F.count("*").alias("input"), *[F.coalesce(F.sum(F.col("t")[i]["ok"].cast("bigint")), F.lit(0)).alias(f"p{i}") for i in range(len(nodes))])
        rows = [F.struct(F.lit(i + 1).alias("position"), F.lit(n.name).alias("name"), F.col("input"), F.col(f"p{i}").alias("passing"), F.lit(n.op).cast("string").alias("op")) for i, n in enumerate(nodes)]
        return sums.select(F.inline(F.array(*rows)))


def read_filter(test: Callable[[DataFrame], Column] | None = None, name: str = "filter") -> ReadFilter:
    """A filter from a function of the table that gives a boolean column; without one, all rows pass."""
    return ReadFilter(name, test)


def compose(first: ReadFilter, *others: ReadFilter, name: str | None = None) -> ReadFilter:
    """All of several filters at once."""
    every = (first, *others)
    ready = lambda df: reduce(lambda d, f: f.prepared(d), every, df)
    return ReadFilter(name or " o ".join(f.name for f in every), lambda df: reduce(and_, [f.column(df) for f in every]), ready)


def subset_by_rules(df: DataFrame, rules: list[ReadFilter]) -> DataFrame:
    """The rows that pass all rules, in turn."""
    return reduce(lambda d, f: f(d), rules, df)


def _matches(column: str, pattern: str | None, fixed: bool, exclude: bool) -> Callable[[DataFrame], Column]:
    def test(df: DataFrame) -> Column:
        require(df, column)
        if pattern is None:
            return F.lit(True)
        found = F.coalesce(F.col(column).contains(pattern) if fixed else F.col(column).rlike(pattern), F.lit(False))
        return ~found if exclude else found

    return test


def id_filter(pattern: str | None = None, fixed: bool = False, exclude: bool = False, name: str = "IdFilter") -> ReadFilter:
    """Ids that match; without a pattern, all."""
    return ReadFilter(name, _matches("id", pattern, fixed, exclude))


def chromosome_filter(pattern: str | None = None, fixed: bool = False, exclude: bool = False, name: str = "ChromosomeFilter") -> ReadFilter:
    """Chromosomes that match; a null one never does."""
    return ReadFilter(name, _matches("chromosome", pattern, fixed, exclude))


def position_filter(least: int | None = None, most: int | None = None, name: str = "PositionFilter") -> ReadFilter:
    """Positions from least to most, both included; null does not pass."""
    low = F.lit(True) if least is None else F.col("position") >= least
    high = F.lit(True) if most is None else F.col("position") <= most
    return ReadFilter(name, lambda df: F.col("position").isNotNull() & low & high)


def strand_filter(strands: list[str | None], name: str = "StrandFilter") -> ReadFilter:
    """Strands in a list, which may hold None for unknown ones."""
    known = F.coalesce(F.col("strand").isin([s for s in strands if s is not None]), F.lit(False))
    return ReadFilter(name, lambda df: known | F.col("strand").isNull() if None in strands else known)


def n_filter(threshold: int = 0, name: str = "CleanNFilter") -> ReadFilter:
    """At most so many letters besides A, C, G and T."""
    return ReadFilter(name, lambda df: other_count("sread") <= threshold)


def polyn_filter(threshold: int = 0, among: str = "ACTG", other: bool = True, name: str = "PolyNFilter") -> ReadFilter:
    """No letter of those named occurs more often."""
    return ReadFilter(name, lambda df: most_frequent_letter("sread", among, other) <= threshold)


def distance_filter(subjects: list[str], threshold: int = 0, name: str = "DistanceFilter") -> ReadFilter:
    """At least so far, in edits, from every subject."""
    if not subjects:
        return ReadFilter(name)
    return ReadFilter(name, lambda df: reduce(and_, [edit_distance(F.col("sread"), s) >= threshold for s in subjects]))


def dusty_filter(threshold: float = float("inf"), name: str = "DustyFilter") -> ReadFilter:
    return ReadFilter(name, lambda df: dusty_score("sread") <= threshold)


def align_quality_filter(threshold: float = 0, name: str = "AlignQualityFilter") -> ReadFilter:
    return ReadFilter(name, lambda df: F.col("align_quality") >= threshold)


def align_data_filter(expression: str, name: str = "AlignDataFilter") -> ReadFilter:
    """An SQL expression over the table's columns."""
    return ReadFilter(name, lambda df: F.expr(expression))


def width_filter(least: int, name: str = "WidthFilter") -> ReadFilter:
    return ReadFilter(name, lambda df: F.length("sread") >= least)


def clean(df: DataFrame) -> DataFrame:
    """Reads of A, C, G and T only."""
    return df.where(other_count("sread") == 0)


#: What rows of one group agree in: the read alone, position and read, position alone.
KEYS = {None: ["sread"], True: ["chromosome", "strand", "position", "sread"], False: ["chromosome", "strand", "position"]}


def occurrence_filter(least: int = 1, most: int = 1, with_read: bool | None = None, duplicates: str | Callable = "head", seed: int = 0, name: str | None = None) -> ReadFilter:
    """Rows of groups with least to most members; of larger ones the first, last or random `most`, or none.

    duplicates may be a function from a group's table (pandas, with row_ix) and `most` to the row_ix values that stay.
    Groups are counted with partial sums, ranks stop early at `most`, and rows of frequent groups are not shuffled.
    """
    if most < least:
        raise ArgumentMismatch("'least' must not exceed 'most'")
    if isinstance(duplicates, str):
        one_of(duplicates, ("head", "tail", "sample", "none"), "duplicates")
    key = KEYS[with_read]

    def prepare(df: DataFrame) -> DataFrame:
        require(df, "row_ix", *key)
        facts = group_facts(df, key)
        if callable(duplicates):
            large = with_group_facts(df, key, facts.where(F.col("_size") > most)).drop("_size")
            kept = large.groupBy(*key).applyInPandas(lambda g: g[g["row_ix"].isin(duplicates(g, most))][["row_ix"]], "row_ix bigint")
            out = with_group_facts(df, key, facts).join(kept.withColumn("_kept", F.lit(True)), "row_ix", "left")
            return out.select(*df.columns, (F.col("_size").between(least, most) | F.col("_kept").isNotNull()).alias("_occurs"))
        keep = F.col("_size").between(least, most)
        if duplicates != "none":
            # The last row that stays of each large group tells for all its rows whether they do.
            first = {"head": F.col("row_ix"), "tail": -F.col("row_ix"), "sample": F.xxhash64("row_ix", F.lit(seed))}[duplicates]
            order = F.struct(first.alias("first"), "row_ix")
            rank = F.row_number().over(Window.partitionBy(*key).orderBy("_order"))
            ranked = df.select(*key, order.alias("_order")).withColumn("_rank", rank).where(F.col("_rank") <= most)
            last = ranked.where(F.col("_rank") == most).select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(key)], F.col("_order").alias("_last"))
            facts = facts.join(last, [F.col(k).eqNullSafe(F.col(f"_l{i}")) for i, k in enumerate(key)], "left").drop(*[f"_l{i}" for i in range(len(key))])
            keep = keep | (F.col("_size") > most) & (order <= F.col("_last"))
        return with_group_facts(df, key, facts).select(*df.columns, F.coalesce(keep, F.lit(False)).alias("_occurs"))

    label = duplicates if isinstance(duplicates, str) else "custom"
    return ReadFilter(name or f"OccurrenceFilter min={least} max={most} withRead={with_read} duplicates={label}", lambda df: F.col("_occurs"), prepare)


def unique_filter(with_read: bool = True) -> ReadFilter:
    raise ReadsError("this filter is no more; use occurrence_filter(with_read=...)", "ArgumentMismatch")
