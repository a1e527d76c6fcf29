"""Quality assessment of reads and alignments: tables by lane or file, flags, and reports.

assess() gives the tables of a run at once; collate() runs an ordered list of summaries that share a filter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ArgumentMismatch, IncompatibleTypes, one_of
from ..functions.trim import adapter_bounds
from ..operators import intervals as I
from ..operators import summaries as A
from ..operators.tables import exact_sample
from ..sources.files import file_names, scratch_folder
from .queries import adapter_sql
from .surrogate import CYCLES, READS, reads

Tables = dict[str, DataFrame]


def adapter_contamination(df: DataFrame, left: str = "", right: str = "", left_allowed=0.1, right_allowed=0.2, least: int = 9, by: str = "lane") -> DataFrame:
    """Share of each lane's reads from which trimming adapters takes more than `least` letters; null without adapters."""
    if not left and not right:
        return df.select(by).distinct().withColumn("contamination", F.lit(None).cast("double"))
    start, end = adapter_bounds("sread", left, right, left_allowed, right_allowed)
    cut = df.select(by, F.length("sread").alias("w"), start.alias("s"), end.alias("e"))
    return cut.groupBy(by).agg(F.avg((F.greatest(F.col("e") - F.col("s") + 1, F.lit(0)) < F.col("w") - least).cast("double")).alias("contamination"))


_FACT = "struct<tag string, mask int, i int, s string, t string, x double>"


def gather(df: DataFrame, by: str, kept: Column | None = None, aligned: Column | None = None, encoding: str = "phred33", left: str = "", right: str = "", left_allowed=0.1, right_allowed=0.2, least: int = 9, folders: list[str] | None = None) -> DataFrame:
    """Counts that all tables but the depth are made of, in one pass over the reads: (tag, by, mask, i, s, t, x, n).

    Each read gives its facts: a base and quality at each cycle, its sequence, mean score, tile and so on, with a mask of
    whether it was kept (1) and aligned (2).  Equal facts are counted by partial sums and written once to the shared folder,
    a folder for each tag.  folders: a list that learns its name.
    """
    flag = lambda c, bit: F.lit(0) if c is None else F.coalesce(c, F.lit(False)).cast("int") * bit
    mask = flag(kept, 1) + flag(aligned, 2)
    null = lambda kind: F.lit(None).cast(kind)
    fact = lambda tag, i=None, s=None, t=None, x=None, m=None: F.struct(
        F.lit(tag).alias("tag"), (F.lit(0) if m is None else m).alias("mask"), (null("int") if i is None else i.cast("int")).alias("i"), (null("string") if s is None else s).alias("s"), (null("string") if t is None else t).alias("t"), (null("double") if x is None else x.cast("double")).alias("x")
    )
    mean = A.mean_quality("qual", encoding)
    mean = F.when(F.length("qual") > 1000, F.round(mean, 4)).otherwise(mean)
    both = F.arrays_zip(A.letters("sread").alias("base"), A.letters("qual").alias("quality"))
    one = [fact("sequence", s=F.col("sread"), m=F.col("_mask")), fact("mean", x=F.col("_mean"), m=F.col("_mask"))]
    if left or right:
        start, end = adapter_bounds("sread", left, right, left_allowed, right_allowed)
        one.append(fact("adapter", i=F.greatest(end - start + 1, F.lit(0)) < F.length("sread") - least))
    one += [fact("align_quality", x=F.col("align_quality"))] * ("align_quality" in df.columns)
    one += [fact("n_match", i=F.col("n_match"))] * ("n_match" in df.columns)
    one += [fact("tile", i=F.col("tile"), x=F.col("_mean"), m=F.col("_mask"))] * ("tile" in df.columns)
    cycles = F.coalesce(F.transform(both, lambda x, k: fact("cycle", i=k + 1, s=x["base"], t=x["quality"])), F.array().cast(f"array<{_FACT}>"))
    facts = df.withColumns({"_mask": mask, "_mean": mean}).select(by, F.explode(F.concat(F.array(*one), cycles)).alias("f")).select("f.tag", by, "f.mask", "f.i", "f.s", "f.t", "f.x")
    folder = scratch_folder(df.sparkSession)
    facts.groupBy("tag", by, "mask", "i", "s", "t", "x").agg(F.count("*").alias("n")).write.partitionBy("tag").parquet(folder)
    if folders is not None:
        folders.append(folder)
    return df.sparkSession.read.schema(f"`{by}` {dict(df.dtypes)[by]}, mask int, i int, s string, t string, x double, n bigint, tag string").parquet(folder)


def tables_of(facts: DataFrame, by: str, types: list[tuple[str, int]], top: int = 50, has: tuple[str, ...] = ()) -> Tables:
    """The tables of assess() from gather()'s counts.  types: names and bits of the row types; has: optional columns."""
    of = lambda tag: facts.where(F.col("tag") == tag)
    typed = lambda df: df.withColumn("type", F.explode(F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(bit) == bit, name) for name, bit in types]))))
    some = lambda bit: F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(bit) == bit, F.col("n"))), F.lit(0))
    bits, group = {name: bit for name, bit in types}, (by, "type")
    cycle = of("cycle").where("s is not null")
    letters = cycle.groupBy(by).agg(*[F.coalesce(F.sum(F.when(F.col("s") == b, F.col("n"))), F.lit(0)).alias(b) for b in "ACGT"], F.coalesce(F.sum(F.when(~F.col("s").isin(*"ACGT"), F.col("n"))), F.lit(0)).alias("N"))
    lanes = of("sequence").groupBy(by).agg(F.sum("n").alias("read"), *[(some(bits[c]) if c in bits else F.lit(None).cast("bigint")).alias(c) for c in ("filtered", "aligned")])
    sequences = typed(of("sequence")).groupBy(*group, F.col("s").alias("sread")).agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "sread"))
    qualities = of("cycle").where("t is not null")
    out = {
        "read_counts": lanes,
        "base_calls": lanes.select(by).join(letters, by, "left").fillna(0, [*"ACGT", "N"]),
        "read_quality": A.density_of(typed(of("mean").where("x is not null")).groupBy(*group, F.col("x").alias("m")).agg(F.sum("n").alias("n")), group),
        "base_quality": qualities.groupBy(by, F.col("t").alias("quality")).agg(F.sum("n").alias("n")),
        "frequent_sequences": sequences.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank"),
        "sequence_distribution": sequences.groupBy(*group, F.col("n").alias("n_occurrences")).agg(F.count("*").alias("n_reads")),
        "cycle_base_calls": cycle.groupBy(by, F.col("i").alias("cycle"), F.col("s").alias("base")).agg(F.sum("n").alias("n")),
        "cycle_quality": qualities.groupBy(by, F.col("i").alias("cycle"), F.col("t").alias("quality")).agg(F.sum("n").alias("n")),
    }
    share = F.sum(F.col("i") * F.col("n")) / F.sum("n")
    out["adapter_contamination"] = of("adapter").groupBy(by).agg(share.alias("contamination")) if "adapter" in has else lanes.select(by, F.lit(None).cast("double").alias("contamination"))
    if "align_quality" in has:
        out["align_quality"] = of("align_quality").groupBy(by, F.col("x").alias("align_quality")).agg(F.sum("n").alias("n"))
    if "n_match" in has:
        out["multiple_alignment"] = of("n_match").groupBy(by, F.col("i").alias("n_match")).agg(F.sum("n").alias("n"))
    if "tile" in has:
        mid = lambda bit: F.percentile(F.when(F.col("mask").bitwiseAND(bit) == bit, F.col("x")), F.lit(0.5), F.col("n"))
        counts = [(some(bits[t]) if t in bits else F.lit(0).cast("bigint")).alias(f"n_{t}") for t in ("read", "filtered", "aligned")]
        medians = [(mid(bits[t]) if t in bits else F.lit(None).cast("double")).alias(f"median_{t}") for t in ("read", "filtered", "aligned")]
        out["tiles"] = of("tile").groupBy(by, F.col("i").alias("tile")).agg(*counts, *medians)
    return out


def assess_once(df: DataFrame, by: str = "lane", kept: Column | None = None, aligned: Column | None = None, encoding: str = "phred33", sample: int | None = 1_000_000, top: int = 50, folders: list[str] | None = None, **adapters) -> Tables:
    """The tables of assess(), all counted in one pass over the sample when it is called; the depth is a plan of its own."""
    some = exact_sample(df, sample, (by,)) if sample else df
    types = [("read", 0)] + [(name, bit) for name, bit, c in (("filtered", 1, kept), ("aligned", 2, aligned)) if c is not None]
    has = tuple(c for c in ("align_quality", "n_match", "tile") if c in df.columns) + (("adapter",) if adapters.get("left") or adapters.get("right") else ())
    out = tables_of(gather(some, by, kept, aligned, encoding, folders=folders, **adapters), by, types, top, has)
    out["cycle_quality"] = out["cycle_quality"].withColumn("score", F.ascii("quality") - A.offset(encoding))
    if sample:
        total = lambda c: F.lit(None).cast("bigint") if c is None else F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
        out["read_counts"] = df.groupBy(by).agg(F.count("*").alias("read"), total(kept).alias("filtered"), total(aligned).alias("aligned"))
    if {"chromosome", "position", "strand"} <= set(df.columns):
        out["depth"] = I.depth_histogram(some, by)
    return out


def assess(df: DataFrame, by: str = "lane", kept: Column | None = None, aligned: Column | None = None, encoding: str = "phred33", sample: int | None = 1_000_000, top: int = 50, once: bool = False, **adapters) -> Tables:
    """The tables of a run by lane.  Reads are first sampled to exactly `sample` of each lane; counts are of all reads.

    kept and aligned tell which reads passed the instrument's filter and which were aligned; tables that depend on it
    have a row type: read, filtered or aligned.  once: count all tables now, in one pass, rather than each where it is used.
    """
    if once:
        return assess_once(df, by, kept, aligned, encoding, sample, top, **adapters)
    no = F.lit(None).cast("bigint")
    total = lambda c: no if c is None else F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    counts = df.groupBy(by).agg(F.count("*").alias("read"), total(kept).alias("filtered"), total(aligned).alias("aligned"))
    some = exact_sample(df, sample, (by,)) if sample else df
    types = [F.lit("read")] + [F.when(F.coalesce(c, F.lit(False)), n) for n, c in (("filtered", kept), ("aligned", aligned)) if c is not None]
    typed = some.withColumn("type", F.explode(F.array_compact(F.array(*types))))
    group = (by, "type")
    pairs = A.pairs_by_cycle(some, (by,))
    # A sequence's reads of all types are counted together, so no read is taken apart by type.
    found = some.groupBy(by, "sread").agg(F.count("*").alias("read"), *[F.sum(F.coalesce(c, F.lit(False)).cast("bigint")).alias(n) for n, c in (("filtered", kept), ("aligned", aligned)) if c is not None])
    kinds = [c for c in found.columns if c not in (by, "sread")]
    sequences = found.select(by, "sread", F.inline(F.array(*[F.struct(F.lit(c).alias("type"), F.col(c).alias("n")) for c in kinds]))).where("n > 0")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "sread"))
    out = {
        "read_counts": counts,
        "base_calls": A.letter_totals(some, by=(by,)).withColumnRenamed("other", "N"),
        "read_quality": A.quality_density(typed, encoding, group),
        "base_quality": A.quality_use(some, (by,)),
        "frequent_sequences": sequences.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank"),
        "sequence_distribution": sequences.groupBy(*group, F.col("n").alias("n_occurrences")).agg(F.count("*").alias("n_reads")),
        "cycle_base_calls": A.base_calls(pairs, (by,)),
        "cycle_quality": A.cycle_qualities(pairs, encoding, (by,)),
        "adapter_contamination": adapter_contamination(some, by=by, **adapters),
    }
    if "align_quality" in df.columns:
        out["align_quality"] = A.value_counts(some, "align_quality", (by,))
    if "n_match" in df.columns:
        out["multiple_alignment"] = A.value_counts(some, "n_match", (by,))
    if "tile" in df.columns:
        out["tiles"] = A.tile_counts(some, kept, aligned, (by,))
    if {"chromosome", "position", "strand"} <= set(df.columns):
        out["depth"] = I.depth_histogram(some, by)
    return out


def assess_export(df: DataFrame, by: str = "lane", **options) -> Tables:
    """Alignments with an instrument's filter: reads, those that passed it, and of them those with a position."""
    passed = F.col("filtering") == "Y"
    return assess(df, by, passed, passed & F.col("position").isNotNull(), "phred64", **options)


def assess_realign(df: DataFrame, by: str = "lane", **options) -> Tables:
    return assess(df, by, None, F.col("n_match") == 1, "phred64", **options)


def assess_bowtie(df: DataFrame, by: str = "lane", encoding: str = "phred33", **options) -> Tables:
    return assess(df, by, None, F.col("position").isNotNull(), encoding, **options)


def assess_map(df: DataFrame, by: str = "lane", **options) -> Tables:
    """Alignments whose minus-strand reads are first turned back."""
    from ..functions.sequence import reverse_complement

    minus = F.col("strand") == "-"
    turned = df.withColumns({"sread": F.when(minus, reverse_complement("sread")).otherwise(F.col("sread")), "qual": F.when(minus, F.reverse("qual")).otherwise(F.col("qual"))})
    return assess(turned, by, None, F.col("position").isNotNull(), **options)


def assess_files(spark: SparkSession, path: str | list[str], pattern: str | None = None, kind: str = "fastq", reading: dict | None = None, **options) -> Tables:
    """The tables of files of reads or of alignments, by the files' names; `reading` has options of the reader."""
    from ..sources.alignments import FORMATS, read_aligned
    from ..sources.fastq import read_fastq

    one_of(kind, ("fastq", *FORMATS), "kind")
    if kind == "fastq":
        df, run = read_fastq(spark, path, pattern, **(reading or {})), assess
    else:
        df = read_aligned(spark, path, pattern, kind, **(reading or {}))
        run = {"export": assess_export, "realign": assess_realign, "bowtie": assess_bowtie, "maq": assess_map, "maq_short": assess_map}.get(kind, assess_bowtie)
    return run(df.withColumn("source", F.element_at(F.split("file", "/"), -1)), "source", **{"once": True, **options})


def file_details(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """Files with their lengths and the times of their last change; contents are not read."""
    found = spark.read.format("binaryFile").load(file_names(path, pattern))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("source"), F.col("path").alias("file"), "length", F.col("modificationTime").alias("changed"))


def bind(*runs: Tables) -> Tables:
    """The tables of several runs, one below the other; they must be of one kind."""
    if any(set(r) != set(runs[0]) for r in runs):
        raise IncompatibleTypes("runs differ in their tables")
    out = dict(runs[0])
    for run in runs[1:]:
        out = {k: v.unionByName(run[k]) for k, v in out.items()}
    return out


# --- summaries in turn ------------------------------------------------------------------------------------------------


@dataclass
class Summary:
    """A named table of a source's reads.

    use_filter: only reads that earlier summaries left in; add_filter: a test of reads that later ones leave out.
    """

    name: str
    table: Callable[[DataFrame], DataFrame]
    flag: Callable[[DataFrame], DataFrame] | None = None
    use_filter: bool = True
    add_filter: Callable[[DataFrame], Column] | None = None


def nucleotide_use() -> Summary:
    return Summary("nucleotide_use", lambda df: A.letter_totals(df, by=("source",)))


def quality_use() -> Summary:
    return Summary("quality_use", lambda df: A.quality_cumulative(A.quality_use(df, ("source",)), ("source",)))


def sequence_use() -> Summary:
    return Summary("sequence_use", lambda df: A.occurrence_distribution(df, ("source",)))


def frequent_sequence(n: int = 50, flag_share: float = 0.8) -> Summary:
    """The commonest sequences; flagged where one makes up more than a share of its source's reads."""

    def table(df: DataFrame) -> DataFrame:
        sizes = df.groupBy("source").agg(F.count("*").alias("records"))
        return A.top_sequences(df, n, ("source",)).join(sizes, "source")

    return Summary("frequent_sequence", table, lambda t: t.withColumn("flagged", F.col("n") / F.col("records") > flag_share))


def read_quality(flag_share: float = 0.2, flag_at: float = 30, above: bool = False) -> Summary:
    """Densities of mean scores; flagged where the share of reads below a score (with `above`: at or above it) is less than
    flag_share or unknown.

    The share below it is the sum of the density's trapezoids up to the score, interpolated between their middles; it is
    unknown where the density does not reach the score.
    """

    def flag(t: DataFrame) -> DataFrame:
        w = Window.partitionBy("source").orderBy("quality")
        step = t.withColumns({"dx": F.lead("quality").over(w) - F.col("quality"), "dy": F.lead("density").over(w) - F.col("density")}).where("dx is not null")
        mids = step.select("source", (F.col("quality") + F.col("dx") / 2).alias("x"), ((F.col("density") + F.col("dy") / 2) * F.col("dx")).alias("area"))
        w = Window.partitionBy("source").orderBy("x")
        mids = mids.withColumn("share", F.sum("area").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        mids = mids.withColumns({"x2": F.lead("x").over(w), "share2": F.lead("share").over(w)}).where(F.col("x").cast("double") <= flag_at)
        at = mids.groupBy("source").agg(F.max(F.struct("x", "share", "x2", "share2")).alias("m"))
        share = F.col("m.share") + (F.col("m.share2") - F.col("m.share")) * (flag_at - F.col("m.x")) / (F.col("m.x2") - F.col("m.x"))
        flags = at.select("source", share.alias("at"))
        return t.select("source").distinct().join(flags, "source", "left").withColumn("flagged", F.col("at").isNull() | ((1 - F.col("at") if above else F.col("at")) < flag_share))

    return Summary("read_quality", lambda df: A.quality_density(df, by=("source",)), flag)


def adapters(left: str = "", right: str = "", least: int = 9) -> Summary:
    return Summary("adapter_contamination", lambda df: adapter_contamination(df, left, right, least=least, by="source"))


def nucleotide_by_cycle() -> Summary:
    return Summary("nucleotide_by_cycle", lambda df: A.letters_by_cycle(df, by=("source",)))


def quality_by_cycle() -> Summary:
    return Summary("quality_by_cycle", lambda df: A.cycle_quality_stats(df, by=("source",)))


def _median(x: np.ndarray) -> float:
    return float(np.median(x)) if len(x) else float("nan")


def fences(counts: list[float]) -> tuple[int, int]:
    """Hinges (medians of the lower and the upper half, the middle in both) less and plus 1.5 times their distance."""
    x = np.sort(np.array([c for c in counts if c is not None], dtype=float))
    half = (len(x) + 1) // 2
    low, high = _median(x[:half]), _median(x[len(x) - half :])
    return int(np.floor(low - 1.5 * (high - low))), int(np.ceil(high + 1.5 * (high - low)))


def flag_sources(df: DataFrame, by: str = "source", within: tuple[int, int] | None = None) -> DataFrame:
    """Records of each source, flagged outside of a range, by default that of fences()."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    # One number for each file: the table of sources, not of reads.
    low, high = within or fences([r.n for r in counts.collect()])
    return counts.withColumn("flagged", ~F.col("n").between(low, high))


@dataclass
class Collated:
    """Tables of all summaries with their flags, and the sources."""

    sources: DataFrame
    tables: Tables
    flagged: Tables = field(default_factory=dict)


def collate(df: DataFrame, summaries: list[Summary], sample: int | None = 1_000_000, by: str = "file") -> Collated:
    """Summaries of each source's sample, in turn.  Rows that a summary's add_filter names are left out of later ones."""
    if not summaries:
        raise ArgumentMismatch("no summaries are given")
    every = df.withColumnRenamed(by, "source")
    some = (exact_sample(every, sample, ("source",)) if sample else every).withColumn("filtered", F.lit(False))
    tables, flags = {}, {}
    for s in summaries:
        rows = some.where("not filtered") if s.use_filter else some
        tables[s.name] = s.table(rows)
        if s.flag:
            flags[s.name] = s.flag(tables[s.name])
        if s.add_filter:
            some = some.withColumn("filtered", F.col("filtered") | F.coalesce(s.add_filter(some), F.lit(False)))
    sources = flag_sources(every).withColumn("sampled", F.least("n", F.lit(sample)) if sample else F.col("n"))
    return Collated(sources, tables, flags)


# --- queries ----------------------------------------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(reads(spark, sf_dir))
    if sql:
        ORACLES[name] = f"WITH {READS} {sql}"


def _run(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda r: assess(r, kept=F.col("align_quality") >= 10, aligned=F.col("position").isNotNull(), sample=None)[name]


_query("qa_read_counts", _run("read_counts"), 'SELECT lane, count(*) AS "read", count(*) FILTER (align_quality >= 10) AS filtered, count(position) AS aligned FROM reads GROUP BY 1')
_TYPED = ", typed AS (SELECT *, 'read' AS type FROM reads UNION ALL SELECT *, 'filtered' FROM reads WHERE align_quality >= 10 UNION ALL SELECT *, 'aligned' FROM reads WHERE position IS NOT NULL)"
_query("qa_frequent_sequences", _run("frequent_sequences"), _TYPED + " SELECT lane, type, sread, n FROM (SELECT *, row_number() OVER (PARTITION BY lane, type ORDER BY n DESC, sread) AS k FROM (SELECT lane, type, sread, count(*) AS n FROM typed GROUP BY 1, 2, 3)) WHERE k <= 50")
_query("qa_sequence_distribution", _run("sequence_distribution"), _TYPED + " SELECT lane, type, n AS n_occurrences, count(*) AS n_reads FROM (SELECT lane, type, sread, count(*) AS n FROM typed GROUP BY 1, 2, 3) GROUP BY 1, 2, 3")
_query("qa_align_quality", _run("align_quality"), "SELECT lane, align_quality, count(*) AS n FROM reads GROUP BY 1, 2")
_DENSE = """, typed AS (SELECT lane, 'read' AS type, qual FROM reads UNION ALL SELECT lane, 'filtered', qual FROM reads WHERE align_quality >= 10 UNION ALL SELECT lane, 'aligned', qual FROM reads WHERE position IS NOT NULL),
 q AS (SELECT lane, type, CAST(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS double) / length(qual) AS m FROM typed),
 g AS (SELECT lane, type, count(*) AS n, stddev_samp(m) AS sd, (quantile_disc(m, 0.75) - quantile_disc(m, 0.25)) / 1.34 AS iqr, min(m) AS lo, max(m) AS hi FROM q GROUP BY 1, 2),
 w AS (SELECT *, 0.9 * least(sd, iqr) * pow(n, -0.2) AS h FROM g), v AS (SELECT lane, type, m, count(*) AS k FROM q GROUP BY 1, 2, 3),
 p AS (SELECT *, lo - 3 * h + i * (hi - lo + 6 * h) / 511 AS x FROM w, (SELECT unnest(range(0, 512)) AS i))
 SELECT p.lane, p.type, i, round(any_value(x), 6) AS quality, round(sum(k * exp(-0.5 * pow((x - m) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 6) AS density FROM p JOIN v ON v.lane = p.lane AND v.type = p.type GROUP BY 1, 2, 3"""


def _densities(r: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lane", "type").orderBy("quality")) - 1
    return _run("read_quality")(r).select("lane", "type", place.cast("bigint").alias("i"), F.round("quality", 6).alias("quality"), F.round("density", 6).alias("density"))


_query("qa_read_quality", _densities, _DENSE)
_DEPTH = """, once AS (SELECT lane, chromosome, position AS s, position + length(sread) - 1 AS e FROM (SELECT *, row_number() OVER (PARTITION BY lane, chromosome, strand, position ORDER BY row_ix) AS k FROM reads WHERE chromosome IS NOT NULL AND position IS NOT NULL) WHERE k = 1),
 spots AS (SELECT lane, chromosome, p, count(*) AS coverage FROM once, (SELECT unnest(range(1, 540)) AS p) WHERE p BETWEEN s AND e GROUP BY 1, 2, 3), dp AS (SELECT lane, coverage, count(*) AS count FROM spots GROUP BY 1, 2)
 SELECT lane, coverage, count, CAST(sum(count) OVER (PARTITION BY lane ORDER BY coverage) AS double) / CAST(sum(count) OVER (PARTITION BY lane) AS double) AS cumulative FROM dp"""
_query("qa_depth", _run("depth"), _DEPTH)
_query("adapter_contamination", lambda r: adapter_contamination(r, "ACGTACGTACGT", "TTGGCCAATTGG", 0.3, 0.3, least=2), ", " + adapter_sql("ACGTACGTACGT", "TTGGCCAATTGG", 0.3, 0.3) + " SELECT lane, avg(CAST(greatest(e - s + 1, 0) < length(sread) - 2 AS int)) AS contamination FROM ends GROUP BY 1")
_query("adapter_none", lambda r: adapter_contamination(r), "SELECT DISTINCT lane, CAST(NULL AS double) AS contamination FROM reads")
_query(
    "flag_sources",
    lambda r: flag_sources(r.withColumnRenamed("lane", "source")),
    """, c AS (SELECT lane AS source, count(*) AS n FROM reads GROUP BY 1), s AS (SELECT list_sort(list(n)) AS x FROM c), h AS (SELECT (x[1] + x[2]) / 2.0 AS lo, (x[3] + x[4]) / 2.0 AS hi FROM s)
 SELECT source, n, n < floor(lo - 1.5 * (hi - lo)) OR n > ceil(hi + 1.5 * (hi - lo)) AS flagged FROM c, h""",
)
_query(
    "flag_frequent_sequence",
    lambda r: (lambda s: s.flag(s.table(r.withColumnRenamed("lane", "source"))))(frequent_sequence(5, 0.01)),
    " SELECT lane AS source, sread, n, records, CAST(n AS double) / records > 0.01 AS flagged FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY n DESC, sread) AS k FROM (SELECT lane, sread, count(*) AS n FROM reads GROUP BY 1, 2)) JOIN (SELECT lane, count(*) AS records FROM reads GROUP BY 1) USING (lane) WHERE k <= 5",
)
#: The density of mean scores at 512 places, its trapezoids up to a score, and their sum between the middles about 30.
_FLAGGED = """, q AS (SELECT lane AS source, CAST(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS double) / length(qual) AS m FROM reads),
 g AS (SELECT source, count(*) AS n, stddev_samp(m) AS sd, (quantile_disc(m, 0.75) - quantile_disc(m, 0.25)) / 1.34 AS iqr, min(m) AS lo, max(m) AS hi FROM q GROUP BY 1),
 w AS (SELECT *, 0.9 * least(sd, iqr) * pow(n, -0.2) AS h FROM g), v AS (SELECT source, m, count(*) AS k FROM q GROUP BY 1, 2),
 d AS (SELECT source, i, x, (SELECT sum(k * exp(-0.5 * pow((x - m) / h, 2))) FROM v WHERE v.source = p.source) / (n * h * sqrt(2 * pi())) AS y FROM (SELECT source, n, h, i, lo - 3 * h + i * (hi - lo + 6 * h) / 511 AS x FROM w, (SELECT unnest(range(0, 512)) AS i)) p),
 t AS (SELECT source, (x + x2) / 2 AS x, sum((x2 - x) * (y + y2) / 2) OVER (PARTITION BY source ORDER BY x) AS share FROM (SELECT *, lead(x) OVER s AS x2, lead(y) OVER s AS y2 FROM d WINDOW s AS (PARTITION BY source ORDER BY x)) WHERE x2 IS NOT NULL),
 a AS (SELECT source, share + (lead(share) OVER s - share) * (30 - x) / (lead(x) OVER s - x) AS share, x, lead(x) OVER s AS x2 FROM t WINDOW s AS (PARTITION BY source ORDER BY x))
 SELECT g.source, coalesce(max(a.share) < 0.2, true) AS flagged FROM g LEFT JOIN a ON a.source = g.source AND a.x <= 30 AND a.x2 > 30 GROUP BY 1"""
_query("flag_read_quality", lambda r: (lambda s: s.flag(s.table(r.withColumnRenamed("lane", "source"))))(read_quality()).select("source", "flagged"), _FLAGGED)


def _summary(s: Summary) -> Callable[[DataFrame], DataFrame]:
    """A summary's table of every source's reads."""
    return lambda r: collate(r.withColumnRenamed("lane", "file"), [s], sample=None).tables[s.name]


_CYCLE = CYCLES.removeprefix(READS)
_query("summary_nucleotide_use", _summary(nucleotide_use()), _CYCLE + " SELECT lane AS source, " + ", ".join(f"count(*) FILTER (base = '{b}') AS \"{b}\"" for b in "ACGT") + ", count(*) FILTER (base NOT IN ('A', 'C', 'G', 'T')) AS other FROM cycles GROUP BY 1")
_query("summary_quality_use", _summary(quality_use()), _CYCLE + " SELECT source, quality, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY quality) AS double) / CAST(sum(n) OVER (PARTITION BY source) AS double) AS share FROM (SELECT lane AS source, quality, count(*) AS n FROM cycles GROUP BY 1, 2)")
_query("summary_sequence_use", _summary(sequence_use()), " SELECT source, n AS n_occurrences, count(*) AS n_reads FROM (SELECT lane AS source, sread, count(*) AS n FROM reads GROUP BY 1, 2) GROUP BY 1, 2")
_query("summary_frequent_sequence", _summary(frequent_sequence(7)), " SELECT lane AS source, sread, n, records FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY n DESC, sread) AS k FROM (SELECT lane, sread, count(*) AS n FROM reads GROUP BY 1, 2)) JOIN (SELECT lane, count(*) AS records FROM reads GROUP BY 1) USING (lane) WHERE k <= 7")
_query("summary_nucleotide_by_cycle", _summary(nucleotide_by_cycle()), _CYCLE + " SELECT lane AS source, cycle, base AS letter, count(*) AS n FROM cycles GROUP BY 1, 2, 3")
_query("summary_quality_by_cycle", _summary(quality_by_cycle()), _CYCLE + " SELECT lane AS source, cycle, CAST(sum(ascii(quality) - 33) AS double) / count(*) AS mean, " + ", ".join(f"CAST(quantile_cont(ascii(quality) - 33, {q}) AS double) AS q{int(100 * q)}" for q in (0.25, 0.5, 0.75)) + " FROM cycles GROUP BY 1, 2")
_query("summary_adapters", _summary(adapters("ACGTACGTACGT", "TTGGCCAATTGG", 0)), ", " + adapter_sql("ACGTACGTACGT", "TTGGCCAATTGG", 0.1, 0.2) + " SELECT lane AS source, avg(CAST(greatest(e - s + 1, 0) < length(sread) AS int)) AS contamination FROM ends GROUP BY 1")


def _once(name: str) -> Callable[[DataFrame], DataFrame]:
    """A table of the assessment that counts all of them in one pass."""
    return lambda r: assess_once(r, kept=F.col("align_quality") >= 10, aligned=F.col("position").isNotNull(), sample=None, left="ACGTACGTACGT", right="TTGGCCAATTGG", left_allowed=0.3, right_allowed=0.3, least=2)[name]


for _name in ("read_counts", "frequent_sequences", "sequence_distribution", "align_quality"):
    _query(f"once_{_name}", _once(_name), ORACLES[f"qa_{_name}"].removeprefix(f"WITH {READS}"))
_query("once_adapter_contamination", _once("adapter_contamination"), ORACLES["adapter_contamination"].removeprefix(f"WITH {READS}"))
_query("once_base_calls", _once("base_calls"), _CYCLE + " SELECT lane, " + ", ".join(f"count(*) FILTER (base = '{b}') AS \"{b}\"" for b in "ACGT") + ", count(*) FILTER (base NOT IN ('A', 'C', 'G', 'T')) AS \"N\" FROM cycles GROUP BY 1")
_query("once_cycle_quality", _once("cycle_quality"), _CYCLE + " SELECT lane, cycle, quality, ascii(quality) - 33 AS score, count(*) AS n FROM cycles GROUP BY 1, 2, 3")
_query("once_cycle_base_calls", _once("cycle_base_calls"), _CYCLE + " SELECT lane, cycle, base, count(*) AS n FROM cycles GROUP BY 1, 2, 3")
_query(
    "once_tiles",
    _once("tiles"),
    """, q AS (SELECT lane, tile, align_quality >= 10 AS kept, position IS NOT NULL AS placed, CAST(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS double) / length(qual) AS m FROM reads)
 SELECT lane, tile, count(*) AS n_read, count(*) FILTER (kept) AS n_filtered, count(*) FILTER (placed) AS n_aligned, quantile_cont(m, 0.5) AS median_read, quantile_cont(m, 0.5) FILTER (kept) AS median_filtered, quantile_cont(m, 0.5) FILTER (placed) AS median_aligned FROM q GROUP BY 1, 2""",
)
