"""Columns computed from quality strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import one_of
from .sequence import letters

#: The character of score 0 in each encoding, and the scores that each can hold.
OFFSETS = {"phred33": 33, "phred64": 64}
SCORES = {"phred33": (0, 93), "phred64": (-5, 41)}
#: Reads that encoding inference looks at.
INFERRED_FROM = 10_000


def offset(encoding: str) -> int:
    return OFFSETS[one_of(encoding, OFFSETS, "encoding")]


def scores(c, encoding: str = "phred33") -> Column:
    """The scores of a quality string, one for each cycle."""
    return F.transform(letters(c), lambda x: F.ascii(x) - offset(encoding))


def quality_sum(c, encoding: str = "phred33") -> Column:
    """The sum of a read's scores."""
    return F.aggregate(scores(c, encoding), F.lit(0.0), lambda a, x: a + x)


def table_score(c, table: dict[str, float]) -> Column:
    """The sum of a table's values of a read's characters; characters that it lacks count 0."""
    values = F.create_map(*[F.lit(x) for kv in table.items() for x in (kv[0], float(kv[1]))])
    return F.aggregate(F.transform(letters(c), lambda x: F.coalesce(F.try_element_at(values, x), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)


def mean_quality(c, encoding: str = "phred33") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > 0, quality_sum(c, encoding) / F.length(c))


def encoding_table(encoding: str = "phred33") -> dict[str, int]:
    """Characters that can stand in a quality string, with their scores."""
    low, high = SCORES[one_of(encoding, SCORES, "encoding")]
    return {chr(s + OFFSETS[encoding]): s for s in range(low, high + 1)}


def infer_encoding(reads: DataFrame) -> str:
    """phred64 if, in the first reads, every character lies above ':' and one above 'J'."""
    some = reads.orderBy("row_ix").limit(INFERRED_FROM).where(F.length("qual") > 0)
    low, high = some.agg(F.min(F.array_min(letters("qual"))), F.max(F.array_max(letters("qual")))).first()
    return "phred64" if low is not None and low > ":" and high > "J" else "phred33"


def recoded(c, source: str, target: str) -> Column:
    """A quality string in another encoding; scores that the target cannot hold are drawn to its ends."""
    low, high = SCORES[one_of(target, SCORES, "target")]
    return F.array_join(F.transform(scores(c, source), lambda s: F.char(F.greatest(F.least(s, F.lit(high)), F.lit(low)) + offset(target))), "")


def wide_scores(reads: DataFrame, cycles: int, encoding: str = "phred33") -> DataFrame:
    """row_ix and a column for each cycle; null beyond a read's width."""
    s = scores("qual", encoding)
    return reads.select("row_ix", s.alias("s")).select("row_ix", *[F.get("s", F.lit(k)).alias(f"cycle_{k + 1}") for k in range(cycles)])
