"""Coverage of chromosomes by reads, and overlap of reads with ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentMismatch, one_of

#: Positions in one bin, for two-level sums and for the overlap join.
BIN = 1 << 20
OVERLAP_BIN = 1 << 12


def covered(coords: str = "leftmost", extend: int | Column = 0) -> tuple[Column, Column]:
    """First and last base that a read covers, longer by `extend` at its 3' end."""
    one_of(coords, ("leftmost", "fiveprime"), "coords")
    extend = F.lit(extend) if isinstance(extend, int) else extend
    plus, width = F.col("strand") == "+", F.length("sread")
    plus = F.coalesce(plus, F.lit(False))
    if coords == "leftmost":
        return F.col("position") - F.when(plus, 0).otherwise(extend), F.col("position") + width - 1 + F.when(plus, extend).otherwise(0)
    reach = width + extend - 1
    return F.col("position") - F.when(plus, 0).otherwise(reach), F.col("position") + F.when(plus, reach).otherwise(0)


def _lookup(values: dict[str, int] | None, chromosomes: DataFrame, name: str, default: Column) -> Column:
    if values is None:
        return default
    known = [r[0] for r in chromosomes.collect()]
    missing = [c for c in known if c not in values]
    if missing:
        raise ArgumentMismatch(f"'{name}' has no value for {', '.join(missing)}")
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.try_element_at(table, F.col("chromosome")).cast("bigint")


def coverage(alignments: DataFrame, shift: dict[str, int] | None = None, width: dict[str, int] | None = None, coords: str = "leftmost", extend: int | Column = 0) -> DataFrame:
    """Runs (chromosome, start, end, depth) of equal depth from base 1 to the last covered one, or to the chromosome's width.

    Each read adds 1 at its start and takes it away behind its end.  Running sums go by bins of positions first, then
    by positions within a bin, so a chromosome is many tasks.
    """
    named = alignments.where("chromosome is not null")
    chromosomes = named.select("chromosome").distinct()
    if (shift is not None or width is not None) and alignments.where("chromosome is not null").limit(1).count() == 0 and alignments.limit(1).count():
        raise ArgumentMismatch("no row has a chromosome")
    start, end = covered(coords, extend)
    move = _lookup(shift, chromosomes, "shift", F.lit(0))
    limit = _lookup(width, chromosomes, "width", F.lit(None).cast("bigint"))
    spans = named.where("position is not null").select("chromosome", (start + move).alias("s"), (end + move).alias("e"), limit.alias("w"))
    spans = spans.select("chromosome", F.greatest("s", F.lit(1)).alias("s"), F.when(F.col("w").isNull(), F.col("e")).otherwise(F.least("e", "w")).alias("e"), "w").where("e >= s")
    steps = spans.select("chromosome", F.inline(F.array(F.struct(F.col("s").cast("bigint").alias("at"), F.lit(1).alias("d")), F.struct((F.col("e") + 1).cast("bigint").alias("at"), F.lit(-1).alias("d")))))
    # Base 1 and the place behind the last base begin runs even where nothing changes.
    edges = chromosomes.select("chromosome", F.lit(1).cast("bigint").alias("at"), F.lit(0).alias("d"))
    if width is not None:
        edges = edges.unionByName(chromosomes.select("chromosome", (limit + 1).alias("at"), F.lit(0).alias("d")))
    steps = steps.unionByName(edges).groupBy("chromosome", "at").agg(F.sum("d").cast("bigint").alias("d"))
    last = steps.groupBy("chromosome").agg(F.max("at").alias("stop")).alias("l")
    steps = steps.alias("s").join(last, F.col("s.chromosome") == F.col("l.chromosome")).where("d <> 0 or at = 1 or at = stop").select("s.*").withColumn("bin", F.floor(F.col("at") / BIN))
    return _runs(steps, ["chromosome"])


def _runs(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, start, end, depth) between steps (keys, at, d, bin) of the depth; sums go by bins first."""
    bins = steps.groupBy(*keys, "bin").agg(F.sum("d").alias("total"), F.min("at").alias("first"))
    over = Window.partitionBy(*keys).orderBy("bin")
    bins = bins.select(*keys, "bin", F.coalesce(F.sum("total").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lead("first").over(over).alias("next"))
    inner = Window.partitionBy(*keys, "bin").orderBy("at")
    depth = F.col("base") + F.sum("d").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    until = F.coalesce(F.lead("at").over(inner), F.col("next"))
    runs = steps.join(bins, [*keys, "bin"]).select(*keys, F.col("at").alias("start"), (until - 1).alias("end"), depth.alias("depth"))
    return runs.where("end >= start")


def depth_histogram(alignments: DataFrame, by: str | None = None) -> DataFrame:
    """Bases (`count`) at each depth above zero, and their cumulative share; of reads at one place and strand the first counts."""
    placed = alignments.where("position is not null and chromosome is not null")
    keys = ["chromosome"] if by is None else [by, "chromosome"]
    # Of each place and strand the first read, by partial minima.
    once = placed.groupBy(*keys, "position", "strand").agg(F.min_by(F.length("sread"), "row_ix").alias("width"))
    start, end = F.greatest(F.col("position"), F.lit(1)).cast("bigint"), (F.col("position") + F.col("width")).cast("bigint")
    change = F.inline(F.array(F.struct(start.alias("at"), F.lit(1).alias("d")), F.struct(end.alias("at"), F.lit(-1).alias("d"))))
    steps = once.where(end > start).select(*keys, change).groupBy(*keys, "at").agg(F.sum("d").cast("bigint").alias("d")).where("d <> 0")
    runs = _runs(steps.withColumn("bin", F.floor(F.col("at") / BIN)), keys).where("depth > 0")
    counts = runs.groupBy(*keys[:-1], F.col("depth").alias("coverage")).agg(F.sum(F.col("end") - F.col("start") + 1).cast("bigint").alias("count"))
    over = Window.partitionBy(*keys[:-1] or [F.lit(1)])
    upto = over.orderBy("coverage").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("cumulative", F.sum("count").over(upto) / F.sum("count").over(over))


def _binned(df: DataFrame, start: Column, end: Column, size: int) -> DataFrame:
    return df.withColumns({"_s": start.cast("bigint"), "_e": end.cast("bigint")}).where("_e >= _s").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / size), F.floor(F.col("_e") / size))))


def overlaps_any(alignments: DataFrame, ranges: DataFrame, bin_size: int = OVERLAP_BIN) -> DataFrame:
    """All rows, with `overlaps`: whether any range (chromosome, start, end) of their chromosome meets them.

    Both sides are dealt by bins of positions and meet in an equi-join; ranges that lie in each other's reach within a
    bin are first merged, so a bin's rows never multiply.
    """
    dealt = _binned(alignments.select("row_ix", "chromosome", "position", "sread"), F.col("position"), F.col("position") + F.length("sread") - 1, bin_size)
    mine = _binned(ranges.select("chromosome", "start", "end"), F.col("start"), F.col("end"), bin_size)
    low, high = F.col("_bin") * bin_size, (F.col("_bin") + 1) * bin_size - 1
    mine = mine.select("chromosome", "_bin", F.greatest("_s", low).alias("a"), F.least("_e", high).alias("b"))
    # Merged ranges of a bin are at most half as many as its positions.
    spot = Window.partitionBy("chromosome", "_bin").orderBy("a", "b")
    fresh = (F.col("a") > F.coalesce(F.max("b").over(spot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) + 1).cast("int")
    merged = mine.distinct().withColumn("f", fresh).withColumn("g", F.sum("f").over(spot.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = merged.groupBy("chromosome", "_bin", "g").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    near = merged.groupBy("chromosome", "_bin").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    met = dealt.join(near, ["chromosome", "_bin"]).where(F.exists("spans", lambda r: (r["a"] <= F.col("_e")) & (r["b"] >= F.col("_s")))).select("row_ix").distinct()
    return alignments.join(met.withColumn("overlaps", F.lit(True)), "row_ix", "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))


def count_overlaps(alignments: DataFrame, ranges: DataFrame, keys: tuple[str, ...], bin_size: int = OVERLAP_BIN) -> DataFrame:
    """For each range (keys, chromosome, start, end) the number of alignments that meet it; a pair counts in the first bin that both are in."""
    # Alignments at one place are one row with a count, so a bin has few rows however many reads pile up in it.
    places = alignments.select("chromosome", F.col("position").alias("_p"), (F.col("position") + F.length("sread") - 1).alias("_q")).groupBy("chromosome", "_p", "_q").agg(F.count("*").alias("_times"))
    a = _binned(places, F.col("_p"), F.col("_q"), bin_size).select("chromosome", "_bin", "_s", "_e", "_times")
    b = _binned(ranges, F.col("start"), F.col("end"), bin_size).select(*keys, "chromosome", "_bin", F.col("_s").alias("rs"), F.col("_e").alias("re"))
    first = F.col("_bin") == F.greatest(F.floor(F.col("_s") / bin_size), F.floor(F.col("rs") / bin_size))
    met = a.join(b, ["chromosome", "_bin"]).where((F.col("_s") <= F.col("re")) & (F.col("_e") >= F.col("rs")) & first)
    counts = met.groupBy(*keys).agg(F.sum("_times").alias("n"))
    return ranges.join(counts, list(keys), "left").fillna(0, ["n"])


def coverage_window(alignments: DataFrame, chromosome: str, start: int, end: int, most_bases: int = 10_000, bins: int = 4999) -> DataFrame:
    """Depth in a range by strand: of each base if it is short, else read starts in equal bins."""
    near = alignments.where((F.col("chromosome") == chromosome) & (F.col("position") <= end) & (F.col("position") + F.length("sread") > start))
    if end - start + 1 <= most_bases:
        first, last = F.greatest("position", F.lit(start)), F.least(F.col("position") + F.length("sread") - 1, F.lit(end))
        return near.select("strand", F.explode(F.sequence(first, last)).alias("at")).groupBy("strand", "at").agg(F.count("*").alias("depth"))
    place = F.width_bucket(F.col("position").cast("double"), F.lit(float(start)), F.lit(float(end + 1)), F.lit(bins))
    return near.where(F.col("position").between(start, end)).groupBy("strand", place.alias("bin")).agg(F.count("*").alias("depth"))


def coverage_frames(windows: dict[str, DataFrame], groups: dict[str, str] | None = None, ignore_strand: bool = False) -> DataFrame:
    """Mean depth over files (of each group) at each place; minus strands count below zero, or strands are summed."""
    at = "at" if "at" in next(iter(windows.values())).columns else "bin"
    rows = reduce(lambda a, b: a.unionByName(b), [w.withColumn("group", F.lit((groups or {}).get(f, "all"))) for f, w in windows.items()])
    sizes = F.create_map(*[F.lit(x) for g in set((groups or {f: "all" for f in windows}).values()) for x in (g, sum((groups or {}).get(f, "all") == g for f in windows))])
    signed = F.when((F.col("strand") == "-") & ~F.lit(ignore_strand), -F.col("depth")).otherwise(F.col("depth"))
    side = F.lit("*") if ignore_strand else F.col("strand")
    return rows.groupBy("group", side.alias("strand"), at).agg(F.sum(signed).alias("total")).select("group", "strand", at, (F.col("total") / F.element_at(sizes, F.col("group"))).alias("depth"))


def as_ranges(alignments: DataFrame) -> DataFrame:
    """Alignments as ranges with a CIGAR of matches only; rows without a place are dropped."""
    end = (F.col("position") + F.length("sread") - 1).alias("end")
    return alignments.where("chromosome is not null and position is not null and strand is not null").select("chromosome", F.col("position").alias("start"), end, "strand", F.concat(F.length("sread").cast("string"), F.lit("M")).alias("cigar"), "id", "sread", "qual")


def as_spans(alignments: DataFrame) -> DataFrame:
    """Where alignments lie, whatever their strand: chromosome, start and width; rows without a place are dropped."""
    placed = alignments.where("chromosome is not null and position is not null and sread is not null")
    return placed.select("chromosome", F.col("position").alias("start"), F.length("sread").alias("width"))


def as_gapped(alignments: DataFrame) -> DataFrame:
    """All alignments with a CIGAR of matches only, as they are named in alignment maps."""
    return alignments.select(F.col("chromosome").alias("seqname"), "strand", F.concat(F.length("sread").cast("string"), F.lit("M")).alias("cigar"), F.col("position").alias("pos"), F.col("id").alias("name"), F.col("sread").alias("qseq"))
