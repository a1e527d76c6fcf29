"""Registered queries on reads, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import sequence as S
from ..functions import trim as T
from ..functions.align import alignments
from ..operators import filters as D
from ..operators import intervals as I
from ..operators import order as O
from ..operators import summaries as A
from ..operators import tables as X
from .surrogate import CYCLES, RANGES, READS, ranges, reads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, cte: str = READS):
    """Register a function of the reads table (and the session)."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(reads(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"WITH {cte} {sql}"
        return f

    return register


@query("flagship", """, kept AS (SELECT sread, regexp_extract(qual, '^[^#-/]*(?:[#-/][^#-/]*)?', 0) AS q FROM reads WHERE length(regexp_replace(sread, '[ACGT]', '', 'g')) <= 1),
 cut AS (SELECT substring(sread, 1, length(q)) AS s FROM kept WHERE length(q) >= 2)
 SELECT CAST(i AS int) AS cycle, substring(s, i, 1) AS letter, count(*) AS n FROM cut, (SELECT unnest(range(1, 33)) AS i) WHERE i <= length(s) GROUP BY 1, 2""")
def flagship(r: DataFrame) -> DataFrame:
    """Clean reads, cut before the second poor base, at least two bases wide: letters by cycle."""
    cut = T.trim_tails(D.n_filter(1)(r), k=2, a="/")
    return A.letters_by_cycle(D.width_filter(2)(cut))


query("narrow", "SELECT row_ix, substring(sread, 3, 10) AS sread, substring(qual, 3, 10) AS qual FROM reads")(lambda r: r.select("row_ix", S.narrow("sread", 3, 12).alias("sread"), S.narrow("qual", 3, width=10).alias("qual")))
query("revcomp", "SELECT row_ix, reverse(translate(sread, 'ACGTN', 'TGCAN')) AS sread, reverse(qual) AS qual FROM reads")(lambda r: r.select("row_ix", S.reverse_complement("sread").alias("sread"), F.reverse("qual").alias("qual")))
query("alphabet_score", "SELECT row_ix, CAST(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS double) AS score FROM reads")(lambda r: A.quality_sums(r))
query("score_matrix", "SELECT row_ix, " + ", ".join(f"CAST(CASE WHEN length(qual) >= {k} THEN ascii(substring(qual, {k}, 1)) - 33 END AS double) AS cycle_{k}" for k in range(1, 33)) + " FROM reads")(lambda r: Q.wide_scores(r, 32).select("row_ix", *[F.col(f"cycle_{k}").cast("double").alias(f"cycle_{k}") for k in range(1, 33)]))
query("recode_quality", "SELECT row_ix, array_to_string(list_transform(string_split(qual, ''), lambda c: chr(ascii(c) + 31)), '') AS qual FROM reads")(lambda r: r.select("row_ix", Q.recoded("qual", "phred33", "phred64").alias("qual")))
query("alphabet_frequency", "SELECT row_ix, " + ", ".join(f"length(sread) - length(replace(sread, '{b}', '')) AS \"{b}\"" for b in "ACGT") + ", length(regexp_replace(sread, '[ACGT]', '', 'g')) AS other FROM reads")(lambda r: r.select("row_ix", *S.letter_frequency("sread")))
_DUST = """, tri AS (SELECT row_ix, substring(sread, i, 3) AS t, count(*) AS n FROM reads, (SELECT CAST(unnest(range(1, 31)) AS int) AS i) WHERE i <= length(sread) - 2 GROUP BY 1, 2),
 dust AS (SELECT r.row_ix, coalesce((SELECT sum((n - 1) * (n - 1)) FROM tri WHERE tri.row_ix = r.row_ix AND t NOT LIKE '%N%'), 0) AS score FROM reads r)"""
query("dusty", _DUST + " SELECT row_ix, CAST(score AS bigint) AS score FROM dust")(lambda r: r.select("row_ix", S.dusty_score("sread").alias("score")))
query("dusty_filter", _DUST + " SELECT row_ix FROM dust WHERE score <= 4")(lambda r: D.dusty_filter(4)(r).select("row_ix"))
_SUBJECTS = ["ACGTACGTACGTACGTACGTACGT", "TTTTTTTTTTTTTTTTTTTTTT"]
query("srdistance", "SELECT row_ix, " + ", ".join(f"CAST(levenshtein(sread, '{s}') AS double) AS d{i}" for i, s in enumerate(_SUBJECTS)) + " FROM reads WHERE sread NOT LIKE '%N%'")(lambda r: D.clean(r).select("row_ix", *[S.edit_distance(F.col("sread"), s).alias(f"d{i}") for i, s in enumerate(_SUBJECTS)]))
query("srdistance_filter", "SELECT row_ix FROM reads WHERE sread NOT LIKE '%N%' AND " + " AND ".join(f"levenshtein(sread, '{s}') >= 15" for s in _SUBJECTS))(lambda r: D.distance_filter(_SUBJECTS, 15)(D.clean(r)).select("row_ix"))
query("srdistance_ambiguous")(lambda r: r.select("row_ix", S.edit_distance(F.col("sread"), "ACGTNNRYACGTACGTACGT").alias("d")))
query("align_reads", f"SELECT row_ix, -CAST(levenshtein(sread, '{_SUBJECTS[0]}') AS double) AS score, CAST(levenshtein(sread, '{_SUBJECTS[0]}') AS int) AS edits, sread, '{_SUBJECTS[0]}' AS subject FROM reads")(
    lambda r: alignments(r.select("row_ix", "sread"), _SUBJECTS[0], opening=0, extension=1, match=0, mismatch=-1).select(
        "row_ix", "score", (F.col("mismatches") + F.col("insertions") + F.col("deletions")).alias("edits"), F.replace("aligned_read", F.lit("-"), F.lit("")).alias("sread"), F.replace("aligned_subject", F.lit("-"), F.lit("")).alias("subject")
    )
)
query("n_filter", "SELECT row_ix FROM reads WHERE length(regexp_replace(sread, '[ACGT]', '', 'g')) <= 1")(lambda r: D.n_filter(1)(r).select("row_ix"))
query("polyn_filter", "SELECT row_ix FROM reads WHERE greatest(" + ", ".join(f"length(sread) - length(replace(sread, '{b}', ''))" for b in "ACGT") + ", length(regexp_replace(sread, '[ACGT]', '', 'g'))) <= 10")(lambda r: D.polyn_filter(10)(r).select("row_ix"))
query("position_filter", "SELECT row_ix FROM reads WHERE position BETWEEN 100 AND 200")(lambda r: D.position_filter(100, 200)(r).select("row_ix"))
query("strand_filter", "SELECT row_ix FROM reads WHERE strand = '+'")(lambda r: D.strand_filter(["+", None])(r).select("row_ix"))
query("chromosome_filter", "SELECT row_ix FROM reads WHERE NOT coalesce(regexp_matches(chromosome, '^[12]'), false)")(lambda r: D.chromosome_filter("^[12]", exclude=True)(r).select("row_ix"))
query("id_filter", "SELECT row_ix FROM reads WHERE regexp_matches(id, '7$')")(lambda r: D.id_filter("7$")(r).select("row_ix"))
query("align_quality_filter", "SELECT row_ix FROM reads WHERE align_quality >= 30")(lambda r: D.align_quality_filter(30)(r).select("row_ix"))
query("align_data_filter", "SELECT row_ix FROM reads WHERE tile > 3 AND align_quality < 20")(lambda r: D.align_data_filter("tile > 3 and align_quality < 20")(r).select("row_ix"))
query("clean", "SELECT row_ix FROM reads WHERE sread NOT LIKE '%N%'")(lambda r: D.clean(r).select("row_ix"))
query("compose_filter", "SELECT row_ix FROM reads WHERE sread NOT LIKE '%N%' AND position BETWEEN 50 AND 450 AND strand = '-'")(lambda r: D.compose(D.n_filter(), D.position_filter(50, 450), D.strand_filter(["-"]))(r).select("row_ix"))
_TOTAL = "(SELECT count(*) FROM reads)"
query(
    "compose_stats",
    f""", t AS (SELECT count(*) FILTER (sread NOT LIKE '%N%') AS a, count(*) FILTER (coalesce(position <= 250, false)) AS b, count(*) FILTER (sread NOT LIKE '%N%' AND coalesce(position <= 250, false)) AS c FROM reads)
 SELECT CAST(1 AS int) AS position, 'CleanNFilter' AS name, {_TOTAL} AS input, a AS passing, CAST(NULL AS varchar) AS op FROM t UNION ALL SELECT 2, 'PositionFilter', {_TOTAL}, b, NULL FROM t
 UNION ALL SELECT 3, '(CleanNFilter & PositionFilter)', {_TOTAL}, c, '&' FROM t UNION ALL SELECT 4, '!((CleanNFilter & PositionFilter))', {_TOTAL}, {_TOTAL} - c, '!' FROM t""",
)(lambda r: (~(D.n_filter() & D.position_filter(most=250))).stats(r))

_KEYS = {None: "sread", True: "chromosome, strand, position, sread", False: "chromosome, strand, position"}


def _occurrence(name: str, duplicates: str, with_read: bool | None, least: int, most: int) -> None:
    order = {"head": "row_ix", "tail": "row_ix DESC", "none": "row_ix"}[duplicates]
    more = "" if duplicates == "none" else f" OR n > {most} AND k <= {most}"
    sql = f"SELECT row_ix FROM (SELECT row_ix, count(*) OVER (PARTITION BY {_KEYS[with_read]}) AS n, row_number() OVER (PARTITION BY {_KEYS[with_read]} ORDER BY {order}) AS k FROM reads) WHERE n BETWEEN {least} AND {most}{more}"
    query(name, sql)(lambda r: D.occurrence_filter(least, most, with_read, duplicates)(r).select("row_ix"))


_occurrence("occurrence_head", "head", None, 2, 30)
_occurrence("occurrence_tail", "tail", False, 1, 2)
_occurrence("occurrence_none", "none", True, 1, 1)
query("occurrence_sample", "SELECT sread, least(count(*), 3) AS n FROM reads GROUP BY 1")(lambda r: D.occurrence_filter(1, 3, None, "sample")(r).groupBy("sread").agg(F.count("*").alias("n")))

query("trim_tails", "SELECT row_ix, substring(sread, 1, length(q)) AS sread, q AS qual FROM (SELECT row_ix, sread, regexp_extract(qual, '^(?:[^#-/]*[#-/]){0,2}[^#-/]*', 0) AS q FROM reads) WHERE length(q) > 0")(lambda r: T.trim_tails(r, 3, "/").select("row_ix", "sread", "qual"))
query("trim_tails_successive", "SELECT row_ix, substring(sread, 1, length(q)) AS sread, q AS qual FROM (SELECT row_ix, sread, regexp_replace(qual, '[#-/]{2}.*$', '') AS q FROM reads) WHERE length(q) > 0")(lambda r: T.trim_tails(r, 2, "/", successive=True).select("row_ix", "sread", "qual"))
query(
    "trim_tailw",
    """, m AS (SELECT row_ix, sread, qual, length(qual) AS w, list_transform(string_split(qual, ''), lambda c: CASE WHEN ascii(c) <= 47 THEN 1 ELSE 0 END) AS b FROM reads),
 p AS (SELECT row_ix, j, b[least(w - 1, 2) + 1] + b[greatest(j - 1, 0) + 1] + b[j + 1] + b[least(j + 1, w - 1) + 1] + b[least(j + 2, w - 1) + 1] AS n FROM m, (SELECT CAST(unnest(range(0, 32)) AS int) AS j) WHERE j < w),
 e AS (SELECT row_ix, min(j) AS cut FROM p WHERE n >= 3 GROUP BY row_ix)
 SELECT row_ix, substring(sread, 1, coalesce(cut, w)) AS sread, substring(qual, 1, coalesce(cut, w)) AS qual FROM m LEFT JOIN e USING (row_ix) WHERE coalesce(cut, w) > 0""",
)(lambda r: T.trim_window(r, 3, "/", 2).select("row_ix", "sread", "qual"))
query(
    "trim_ends",
    """, b AS (SELECT row_ix, sread, qual, length(qual) AS w, 1 + length(qual) - length(regexp_replace(qual, '^[#-/]+', '')) AS s, length(regexp_replace(qual, '[#-/]+$', '')) AS e FROM reads)
 SELECT row_ix, CASE WHEN s > w OR e = 0 THEN '' ELSE substring(sread, s, e - s + 1) END AS sread, CASE WHEN s > w OR e = 0 THEN '' ELSE substring(qual, s, e - s + 1) END AS qual FROM b""",
)(lambda r: T.trim_ends(r, "/").select("row_ix", "sread", "qual"))
query(
    "trim_ends_letters",
    """SELECT row_ix, CASE WHEN regexp_matches(sread, '[CGT]') THEN CAST(1 + length(sread) - length(regexp_replace(sread, '^[AN]+', '')) AS int) ELSE 1 END AS start,
 CAST(length(regexp_replace(sread, '[AN]+$', '')) AS int) AS "end" FROM reads""",
)(lambda r: T.trim_ends(r, "AN", relation="==", by="sread", as_ranges=True).drop("width"))


def adapter_sql(left: str, right: str, left_rate: float, right_rate: float) -> str:
    """Table `ends` (row_ix, lane, sread, qual, s, e): where reads begin and end without their adapters."""

    def longest(pattern: str, rate: float, at_start: bool) -> str:
        n = len(pattern)
        tests = []
        for j in range(n, 0, -1):
            place = (lambda k: f"{k}") if at_start else (lambda k, j=j: f"length(sread) - {j} + {k}")
            own = pattern[n - j :] if at_start else pattern[:j]
            misses = " + ".join(f"CAST(substring(sread, {place(k)}, 1) <> '{own[k - 1]}' AS int)" for k in range(1, j + 1))
            tests.append(f"WHEN length(sread) >= {j} AND {misses} <= {int(rate * j)} THEN {j}")
        return "CASE " + " ".join(tests) + " ELSE 0 END"

    return f"ends AS (SELECT row_ix, lane, sread, qual, 1 + {longest(left, left_rate, True)} AS s, length(sread) - {longest(right, right_rate, False)} AS e FROM reads)"


query("trim_adapters", ", " + adapter_sql("ACGTAC", "GGTTAA", 0.2, 0.2) + " SELECT row_ix, CASE WHEN e < s THEN '' ELSE substring(sread, s, e - s + 1) END AS sread, CASE WHEN e < s THEN '' ELSE substring(qual, s, e - s + 1) END AS qual FROM ends")(lambda r: T.trim_adapters(r, "ACGTAC", "GGTTAA", 0.2, 0.2).select("row_ix", "sread", "qual"))

query("abc_base", "SELECT cycle, base AS letter, count(*) AS n FROM cycles GROUP BY 1, 2", CYCLES)(lambda r: A.letters_by_cycle(r))
query("abc_qual", "SELECT cycle, quality AS letter, count(*) AS n FROM cycles GROUP BY 1, 2", CYCLES)(lambda r: A.letters_by_cycle(r, "qual"))
query("abc_dense", "SELECT c.i AS cycle, l AS letter, count(row_ix) AS n FROM (SELECT CAST(unnest(range(1, 33)) AS int) AS i) c, (VALUES ('A'), ('C'), ('G'), ('T'), ('N'), ('-')) v(l) LEFT JOIN cycles ON cycle = c.i AND base = l GROUP BY 1, 2", CYCLES)(lambda r: A.letters_by_cycle(r, alphabet="ACGTN-", dense=True))
query("abc_pair", "SELECT cycle, base, quality, count(*) AS n FROM cycles GROUP BY 1, 2, 3", CYCLES)(lambda r: A.pairs_by_cycle(r))
query("cycle_base_calls", "SELECT lane, cycle, base, count(*) AS n FROM cycles GROUP BY 1, 2, 3", CYCLES)(lambda r: A.base_calls(A.pairs_by_cycle(r, ("lane",)), ("lane",)))
query("cycle_quality", "SELECT lane, cycle, quality, count(*) AS n, ascii(quality) - 33 AS score FROM cycles GROUP BY 1, 2, 3", CYCLES)(lambda r: A.cycle_qualities(A.pairs_by_cycle(r, ("lane",)), by=("lane",)))
query("cycle_quality_stats", "SELECT cycle, CAST(sum(ascii(quality) - 33) AS double) / count(*) AS mean, CAST(quantile_cont(ascii(quality) - 33, 0.25) AS double) AS q25, CAST(quantile_cont(ascii(quality) - 33, 0.5) AS double) AS q50, CAST(quantile_cont(ascii(quality) - 33, 0.75) AS double) AS q75 FROM cycles GROUP BY 1", CYCLES)(lambda r: A.cycle_quality_stats(r))
query("base_totals", "SELECT lane, " + ", ".join(f"count(*) FILTER (base = '{b}') AS \"{b}\"" for b in "ACGT") + ", count(*) FILTER (base NOT IN ('A', 'C', 'G', 'T')) AS other FROM cycles GROUP BY 1", CYCLES)(lambda r: A.letter_totals(r, by=("lane",)))
query("quality_use", "SELECT lane, quality, count(*) AS n FROM cycles GROUP BY 1, 2", CYCLES)(lambda r: A.quality_use(r, ("lane",)))
query("quality_cumulative", "SELECT lane, quality, n, CAST(sum(n) OVER (PARTITION BY lane ORDER BY quality) AS double) / CAST(sum(n) OVER (PARTITION BY lane) AS double) AS share FROM (SELECT lane, quality, count(*) AS n FROM cycles GROUP BY 1, 2)", CYCLES)(lambda r: A.quality_cumulative(A.quality_use(r, ("lane",)), ("lane",)))
query("tables_top", "SELECT sread, count(*) AS n FROM reads GROUP BY 1 ORDER BY n DESC, sread LIMIT 50")(lambda r: A.top_sequences(r, 50))
query("tables_distribution", "SELECT n AS n_occurrences, count(*) AS n_reads FROM (SELECT sread, count(*) AS n FROM reads GROUP BY 1) GROUP BY 1")(lambda r: A.occurrence_distribution(r))
query("frequent_by_lane", "SELECT lane, sread, n FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY n DESC, sread) AS k FROM (SELECT lane, sread, count(*) AS n FROM reads GROUP BY 1, 2)) WHERE k <= 20")(lambda r: A.top_sequences(r, 20, ("lane",)))
query("occurrence_curve", """, d AS (SELECT lane, n AS n_occurrences, count(*) AS n_reads FROM (SELECT lane, sread, count(*) AS n FROM reads GROUP BY 1, 2) GROUP BY 1, 2), c AS (SELECT lane, n_occurrences, sum(n_occurrences * n_reads) OVER (PARTITION BY lane ORDER BY n_occurrences) AS run FROM d)
 SELECT lane, n_occurrences, CAST(run - min(run) OVER (PARTITION BY lane) + 1 AS double) / CAST(max(run) OVER (PARTITION BY lane) - min(run) OVER (PARTITION BY lane) + 1 AS double) AS share FROM c""")(lambda r: A.occurrence_curve(A.occurrence_distribution(r, ("lane",)), ("lane",)))
_MEAN = ", q AS (SELECT *, CAST(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS double) / length(qual) AS m FROM reads)"
query("per_tile", _MEAN + " SELECT lane, tile, count(*) AS n_read, count(*) FILTER (align_quality >= 10) AS n_filtered, count(*) FILTER (position IS NOT NULL) AS n_aligned, quantile_cont(m, 0.5) AS median_read, quantile_cont(m, 0.5) FILTER (align_quality >= 10) AS median_filtered, quantile_cont(m, 0.5) FILTER (position IS NOT NULL) AS median_aligned FROM q GROUP BY 1, 2")(lambda r: A.tile_counts(r, F.col("align_quality") >= 10, F.col("position").isNotNull(), ("lane",)))
query("align_quality_counts", "SELECT lane, CAST(position % 5 AS double) AS p, count(*) AS n FROM reads GROUP BY 1, 2")(lambda r: A.value_counts(r.withColumn("p", (F.col("position") % 5).cast("double")), "p", ("lane",)))
query("read_proportions", "SELECT lane, \"read\", CAST(round(aligned / \"read\", 3) AS double) AS aligned FROM (SELECT lane, count(*) AS \"read\", CAST(count(position) AS double) AS aligned FROM reads GROUP BY 1)")(lambda r: A.proportions(r.groupBy("lane").agg(F.count("*").alias("read"), F.count("position").cast("double").alias("aligned")), "read", "aligned"))
query("count_reads", "SELECT lane, count(*) AS records, CAST(sum(length(sread)) AS bigint) AS nucleotides, CAST(sum(length(qual)) AS bigint) AS scores FROM reads GROUP BY 1")(lambda r: A.count_reads(r, "lane"))
query(
    "quality_density",
    """, q AS (SELECT lane, CAST(list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS double) / length(qual) AS m FROM reads),
 g AS (SELECT lane, count(*) AS n, stddev_samp(m) AS sd, (quantile_disc(m, 0.75) - quantile_disc(m, 0.25)) / 1.34 AS iqr, min(m) AS lo, max(m) AS hi FROM q GROUP BY 1),
 w AS (SELECT *, 0.9 * least(sd, iqr) * pow(n, -0.2) AS h FROM g), v AS (SELECT lane, m, count(*) AS k FROM q GROUP BY 1, 2),
 p AS (SELECT *, lo - 3 * h + i * (hi - lo + 6 * h) / 511 AS x FROM w, (SELECT unnest(range(0, 512)) AS i))
 SELECT p.lane, round(any_value(x), 6) AS quality, round(sum(k * exp(-0.5 * pow((x - m) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 6) AS density FROM p JOIN v ON v.lane = p.lane GROUP BY p.lane, i""",
)(lambda r: A.quality_density(r, by=("lane",)).select("lane", F.round("quality", 6).alias("quality"), F.round("density", 6).alias("density")))

query(
    "dense_tiles",
    """, c AS (SELECT lane, tile, count(*) AS n_read, count(position) AS n_aligned FROM reads WHERE tile <> 3 GROUP BY 1, 2), g AS (SELECT lane, t AS tile FROM (SELECT DISTINCT lane FROM c), (SELECT CAST(unnest(range(1, 9)) AS int) AS t))
 SELECT lane, tile, coalesce(n_read, 0) AS n_read, coalesce(n_aligned, 0) AS n_aligned FROM g LEFT JOIN c USING (lane, tile)""",
)(lambda r: A.dense_tiles(A.tile_counts(r.where("tile <> 3"), aligned=F.col("position").isNotNull(), by=("lane",)), ("lane",)).select("lane", "tile", "n_read", "n_aligned"))
query(
    "tile_stats",
    """, n AS (SELECT CAST(right(lane, 1) AS int) + 1 AS lane, CAST(tile * 37 AS int) AS tile, sread FROM reads)
 SELECT lane, tile, CAST((lane - 1) * 3 + floor((tile - 1) / 100) + 1 AS int) AS slane, CAST(1 + least((tile - 1) % 200, (400 - tile) % 200) AS int) AS stile, count(*) AS n_reads, count(*) FILTER (sread NOT LIKE '%N%') AS n_clean FROM n GROUP BY 1, 2""",
)(lambda r: A.tile_stats(r.select((F.substring("lane", -1, 1).cast("int") + 1).alias("lane"), (F.col("tile") * 37).alias("tile"), "sread")))
query("tile_geometry", "SELECT row_ix, CAST((tile - 1) % 50 + 1 AS int) AS \"row\", CAST(floor((tile - 1) / 50) + 1 AS int) AS \"column\" FROM reads")(lambda r: r.select("row_ix", *[c.alias(n) for c, n in zip(A.tile_geometry(F.col("tile"), 100), ("row", "column"))]))

query("srorder", "SELECT row_ix, row_number() OVER (ORDER BY sread, row_ix) AS place FROM reads")(lambda r: O.read_order(r).select("row_ix", "place"))
query("srsort", "SELECT row_ix, sread FROM reads")(lambda r: O.sorted_reads(r).select("row_ix", "sread"))
query("srrank", "SELECT row_ix, rank() OVER (ORDER BY sread) AS rank FROM reads")(lambda r: O.read_rank(r).select("row_ix", "rank"))
query("srduplicated", "SELECT row_ix, row_number() OVER (PARTITION BY sread ORDER BY row_ix) > 1 AS duplicated FROM reads")(lambda r: O.duplicated(r).select("row_ix", "duplicated"))
_BY = "chromosome NULLS LAST, strand, position NULLS LAST, sread"
query("aligned_order", f"SELECT row_ix, row_number() OVER (ORDER BY {_BY}, row_ix) AS place FROM reads")(lambda r: O.aligned_order(r).select("row_ix", "place"))
query("aligned_rank", f"SELECT row_ix, rank() OVER (ORDER BY {_BY}) AS rank FROM reads")(lambda r: O.aligned_rank(r).select("row_ix", "rank"))
query("aligned_duplicated", "SELECT row_ix, row_number() OVER (PARTITION BY chromosome, strand, position ORDER BY row_ix) > 1 AS duplicated FROM reads")(lambda r: O.aligned_duplicated(r, with_read=False).select("row_ix", "duplicated"))

_HIT = 'r.chromosome = s.chromosome AND position <= s."end" AND position + length(sread) - 1 >= s.start'
query("overlaps_any", f"SELECT row_ix, EXISTS (SELECT 1 FROM spans s WHERE {_HIT}) AS overlaps FROM reads r", READS + ", " + RANGES)(lambda r: I.overlaps_any(r, ranges(r.sparkSession)).select("row_ix", "overlaps"))
query("count_overlaps", f'SELECT s.chromosome, s.n AS k, s.start, s."end", count(row_ix) AS n FROM spans s LEFT JOIN reads r ON {_HIT} GROUP BY ALL', READS + ", " + RANGES)(lambda r: I.count_overlaps(r, ranges(r.sparkSession).withColumnRenamed("n", "k"), ("chromosome", "k"), 64))


def _coverage(start: str, end: str) -> str:
    return f""", iv AS (SELECT chromosome, greatest(1, {start}) AS s, {end} AS e FROM reads WHERE chromosome IS NOT NULL AND position IS NOT NULL),
 ev AS (SELECT chromosome, p, sum(d) AS d FROM (SELECT chromosome, s AS p, 1 AS d FROM iv WHERE e >= s UNION ALL SELECT chromosome, e + 1, -1 FROM iv WHERE e >= s UNION ALL SELECT DISTINCT chromosome, 1, 0 FROM iv) GROUP BY 1, 2),
 st AS (SELECT * FROM ev WHERE d <> 0 OR p = 1),
 cv AS (SELECT chromosome, CAST(p AS bigint) AS start, CAST(lead(p) OVER w - 1 AS bigint) AS "end", CAST(sum(d) OVER w AS bigint) AS depth FROM st WINDOW w AS (PARTITION BY chromosome ORDER BY p))"""


_LEFT = _coverage("position - CASE WHEN strand = '+' THEN 0 ELSE 7 END", "position + length(sread) - 1 + CASE WHEN strand = '+' THEN 7 ELSE 0 END")
query("coverage_leftmost", _LEFT + ' SELECT * FROM cv WHERE "end" IS NOT NULL')(lambda r: I.coverage(r, extend=7))
_FIVE = _coverage("position - CASE WHEN strand = '+' THEN 0 ELSE length(sread) + 4 END", "position + CASE WHEN strand = '+' THEN length(sread) + 4 ELSE 0 END")
query("coverage_fiveprime", _FIVE + ' SELECT * FROM cv WHERE "end" IS NOT NULL')(lambda r: I.coverage(r, coords="fiveprime", extend=5))
_ONCE = READS.replace("reads AS (", "every AS (") + ", reads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chromosome, strand, position ORDER BY row_ix) AS k FROM every WHERE chromosome IS NOT NULL AND position IS NOT NULL) WHERE k = 1)"
query("depth_of_coverage", _coverage("position", "position + length(sread) - 1") + """, dp AS (SELECT depth AS coverage, CAST(sum("end" - start + 1) AS bigint) AS count FROM cv WHERE depth > 0 GROUP BY 1)
 SELECT coverage, count, CAST(sum(count) OVER (ORDER BY coverage) AS double) / CAST(sum(count) OVER () AS double) AS cumulative FROM dp""", _ONCE)(lambda r: I.depth_histogram(r))
query("coverage_window", "SELECT strand, CAST(p AS int) AS \"at\", count(*) AS depth FROM reads, (SELECT unnest(range(100, 151)) AS p) WHERE chromosome = '2-HIGH' AND position <= p AND position + length(sread) - 1 >= p GROUP BY 1, 2")(lambda r: I.coverage_window(r, "2-HIGH", 100, 150))
query("as_spans", "SELECT chromosome, position AS start, CAST(length(sread) AS int) AS width FROM reads WHERE chromosome IS NOT NULL AND position IS NOT NULL")(lambda r: I.as_spans(r))
query("as_gapped", "SELECT chromosome AS seqname, strand, concat(CAST(length(sread) AS varchar), 'M') AS cigar, position AS pos, id AS name, sread AS qseq FROM reads")(lambda r: I.as_gapped(r))
query("as_ranges", "SELECT chromosome, position AS start, position + length(sread) - 1 AS \"end\", strand, concat(CAST(length(sread) AS varchar), 'M') AS cigar, id, sread, qual FROM reads WHERE chromosome IS NOT NULL AND position IS NOT NULL")(lambda r: I.as_ranges(r))

query("append", "SELECT row_ix, id FROM reads UNION ALL SELECT row_ix + (SELECT max(row_ix) FROM reads), id FROM reads WHERE tile = 1")(lambda r: X.append(r, r.where("tile = 1")).select("row_ix", "id"))
query("batch_ranges", "SELECT row_ix, CAST(CASE WHEN row_ix <= 500 THEN 1 ELSE 2 END AS int) AS batch FROM reads WHERE row_ix BETWEEN 11 AND 500 OR row_ix BETWEEN 900 AND 1200")(lambda r: X.record_ranges(r, [(11, 500), (900, 1200)]).select("row_ix", "batch"))
query("stream_batches", "SELECT CAST(floor((row_ix - 1) / 1000.0) AS bigint) + 1 AS batch, count(*) AS n FROM reads GROUP BY 1")(lambda r: X.batches(r, 1000).groupBy("batch").agg(F.count("*").alias("n")))
query("exact_sample", "SELECT lane, least(count(*), 500) AS n FROM reads GROUP BY 1")(lambda r: X.exact_sample(r, 500, ("lane",)).groupBy("lane").agg(F.count("*").alias("n")))
query("replace_rows", "SELECT row_ix, CASE WHEN tile = 2 THEN reverse(sread) ELSE sread END AS sread FROM reads")(lambda r: X.replace_rows(r.select("row_ix", "sread"), r.where("tile = 2").select("row_ix", F.reverse("sread").alias("sread"))))
query("zip_rows", "SELECT row_ix, sread, qual FROM reads")(lambda r: X.zip_rows(r.select("row_ix", "sread"), r.select("row_ix", "qual"), ("row_ix",)))


def queries() -> dict[str, Query]:
    from . import assessment, round_trips

    return {**QUERIES, **assessment.QUERIES, **round_trips.QUERIES}


def oracle_sql() -> dict[str, str]:
    from . import assessment, round_trips

    return {**ORACLES, **assessment.ORACLES, **round_trips.ORACLES}
