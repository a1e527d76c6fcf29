"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by a hash and laid end to end, up to `repeats` times over.  A copy's virtual finish
time is the source's words up to its end, divided by the source's target, so every source reaches its target at time 1.
All copies are ordered by that time and the order is cut where the words reach the total of all targets.

Running sums are taken in two levels, so no source and no stretch of time lands in one task: first the totals of 4096
hash slots of each source (or slots of time), then the rows of a slot.  The slot in which the budget runs
out is cut into 4096 slots again, of which the last is ordered row by row.

Defined results: a null text has size 0; documents without words take nothing; null is a source like others and comes
last; repeated rows are mixed one by one; documents that agree in id and size share their order; an empty table gives
an empty table; columns other than those that are named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Slots of hashes in a source, and of the time from 0 to 1.
SLOTS = 4096
_END = Window.unboundedPreceding, Window.currentRow


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """source, source_size and target: shares of all words by weight, none above `repeats` times its source's words.

    With sources by rising ratio of limit to weight, those that stop at their limit come first.  If all before a source
    stop, the others share what is left at one rate; the first source that this rate does not fill ends the search.
    """
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array([F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(repeats))
    rated = stats.withColumn("weight", weight).withColumn("most", limit).withColumn("fill", F.col("most") / F.col("weight"))
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    among = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rates = rated.withColumn("rate", left / among)
    chosen = F.min(F.when(F.col("rate") <= F.col("fill"), F.struct("fill", "rate"))).over(every)["rate"]
    return rates.select("source", "source_size", F.least(F.col("weight") * chosen, F.col("most")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns of `keep`, size (words), source_size, target (of its source) and taken (words the mix takes, repeats counted)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = durable(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), *keep))
    targets = durable(source_targets(sized, weights, repeats))
    slot = F.conv(F.substring("key", 1, 3), 16, 10).cast("int")
    laid = sized.withColumn("slot", slot)
    sums = laid.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    by_slot = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "slot", F.coalesce(F.sum("words").over(by_slot), F.lit(0)).alias("before"))
    laid, sums, targets = laid.alias("d"), sums.alias("s"), targets.alias("t")
    same = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.slot") == F.col("s.slot"))
    rows = laid.join(sums, same).join(targets, F.col("d.source").eqNullSafe(F.col("t.source")))
    rows = rows.select("d.*", "s.before", "t.source_size", "t.target")
    inner = Window.partitionBy("source", "slot").orderBy("key", "id", "size")
    upto = F.col("before") + F.sum("size").over(inner.rowsBetween(*_END))
    laid = durable(rows.withColumn("nth", F.row_number().over(inner)).withColumn("upto", upto).drop("before"))

    ends = F.transform(F.array([F.lit(k) for k in range(repeats)]), lambda k: (k * F.col("source_size") + F.col("upto")) / F.col("target"))
    ends = F.when((F.col("size") > 0) & (F.col("target") > 0), ends).otherwise(F.array().cast("array<double>"))
    timed = laid.withColumn("ends", ends)
    #: Time from 2 on shares one slot: the budget runs out by then unless single documents exceed whole targets.
    when = lambda f: F.when(f < 2, F.floor(f * SLOTS)).otherwise(2 * SLOTS).cast("int")
    load = timed.select("size", F.explode("ends").alias("end")).groupBy(when(F.col("end")).alias("at")).agg(F.sum("size").alias("words"))
    load = load.withColumn("upto", F.sum("words").over(Window.orderBy("at").rowsBetween(*_END)))
    budget = laid.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cut = load.where(F.col("upto") > budget).orderBy("at").select("at", F.col("upto") - F.col("words")).first()
    last, left = (cut[0], budget - cut[1]) if cut else (2 * SLOTS + 1, 0)

    whole = F.size(F.filter("ends", lambda f: when(f) < last))
    edge = timed.select("id", "source", "size", "key", "slot", "nth", F.posexplode("ends").alias("turn", "end")).where(when(F.col("end")) == last)
    # The slot of time in which the budget runs out is cut into slots again; only the last of these is ordered row by row.
    edge = edge.withColumn("part", F.when(F.col("end") < 2, F.floor((F.col("end") * SLOTS - last) * SLOTS)).otherwise(0).cast("int"))
    parts = edge.groupBy("part").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(Window.orderBy("part").rowsBetween(*_END)))
    cut = parts.where(F.col("upto") > left).orderBy("part").select("part", F.col("upto") - F.col("words")).first() if cut else None
    final, left = (cut[0], left - cut[1]) if cut else (SLOTS, 0)
    order = Window.orderBy("end", F.col("source").asc_nulls_last(), "key", "id", "size", "turn").rowsBetween(*_END)
    named = ["source", "slot", "nth"]
    ranked = edge.where(F.col("part") == final).withColumn("run", F.sum("size").over(order)).where(F.col("run") <= left)
    edge = edge.where(F.col("part") < final).select(*named).unionByName(ranked.select(*named))
    edge = edge.groupBy("source", "slot", "nth").agg(F.count("*").alias("more")).alias("e")
    rows = timed.withColumn("whole", whole).alias("d")
    same = F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.slot") == F.col("e.slot")) & (F.col("d.nth") == F.col("e.nth"))
    taken = F.col("d.size") * (F.col("d.whole") + F.coalesce("e.more", F.lit(0)))
    return rows.join(edge, same, "left").select(F.col("d.id").alias(id_col), *(f"d.{c}" for c in keep), "d.size", "d.source_size", "d.target", taken.cast("bigint").alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM d GROUP BY source),
f AS (SELECT *, CAST(source_size AS DOUBLE) * 3.0::DOUBLE AS most, CAST(source_size AS DOUBLE) * 3.0::DOUBLE / weight AS fill FROM s),
r AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate FROM f WINDOW o AS (ORDER BY fill, source ASC NULLS LAST)),
t AS (SELECT source, source_size, least(weight * (SELECT rate FROM r WHERE rate <= fill ORDER BY fill, rate LIMIT 1), most) AS target FROM r),
l AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(turn * source_size + upto AS DOUBLE) / target AS finish FROM l, (VALUES (0), (1), (2)) AS x(turn) WHERE size > 0 AND target > 0),
q AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source ASC NULLS LAST, key, doc_id, size, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM q WHERE run <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM l LEFT JOIN k USING (doc_id)
"""
