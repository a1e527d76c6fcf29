"""Registered queries on sources and sinks: the surrogate's reads are written in a format and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..operators import filters as D
from ..operators import intervals as I
from ..operators import order as O
from ..operators import tables as X
from ..sources import alignments, bam, blocked, delimited, fasta, fastq, files, sinks
from ..sources.files import scratch_folder
from ..streaming import splits
from .surrogate import RANGES, READS, ranges, reads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def written(r: DataFrame, line: Column, compress: bool = False) -> str:
    """A folder of text files of the reads' lines."""
    folder = scratch_folder(r.sparkSession)
    sinks.write_records(r, folder, line, compress)
    return folder


def _query(name: str, sql: str):
    def register(f: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(reads(spark, sf_dir))
        ORACLES[name] = f"WITH {READS} {sql}"
        return f

    return register


_tabs = lambda *cols: F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


@_query("source_fastq", "SELECT id, sread, qual FROM reads")
def source_fastq(r: DataFrame) -> DataFrame:
    return fastq.read_fastq(r.sparkSession, written(r, sinks.fastq_record(True))).select("id", "sread", "qual")


@_query("source_fastq_gzip", "SELECT id, sread, qual FROM reads")
def source_fastq_gzip(r: DataFrame) -> DataFrame:
    return fastq.read_fastq(r.sparkSession, written(r, sinks.fastq_record(), True), "gz$").select("id", "sread", "qual")


@_query("source_fasta", "SELECT id, sread FROM reads")
def source_fasta(r: DataFrame) -> DataFrame:
    return fasta.read_fasta(r.sparkSession, written(r, sinks.fasta_record())).select("id", "sread")


@_query("source_quality", "SELECT id, qual FROM reads")
def source_quality(r: DataFrame) -> DataFrame:
    numbers = F.array_join(F.transform(F.split("qual", ""), lambda x: (F.ascii(x) - 33).cast("string")), " ")
    return fasta.read_quality(r.sparkSession, written(r, F.concat(F.lit(">"), "id", F.lit("\n"), numbers))).select("id", "qual")


@_query("source_qseq", "SELECT concat('M:1:', CAST(tile AS varchar), ':', CAST(tile AS varchar), ':', CAST(row_ix AS varchar), ':7') AS id, sread, qual FROM reads WHERE tile > 3")
def source_qseq(r: DataFrame) -> DataFrame:
    passed = (F.col("tile") > 3).cast("int")
    line = _tabs(F.lit("M"), F.lit(1), F.col("tile"), F.col("tile"), F.col("row_ix"), F.lit(7), F.lit("0"), F.lit(1), F.col("sread"), F.col("qual"), passed)
    return delimited.read_qseq(r.sparkSession, written(r, line), filtered=True).select("id", "sread", "qual")


@_query("source_columns", "SELECT id, sread, chromosome, position, align_quality FROM reads")
def source_columns(r: DataFrame) -> DataFrame:
    line = _tabs(F.col("id"), F.col("sread"), F.lit("skipped"), F.col("chromosome"), F.col("position"), F.col("align_quality"))
    columns = {"id": "string", "sread": "dna", "none": None, "chromosome": "string", "position": "int", "align_quality": "double"}
    out = delimited.read_columns(r.sparkSession, written(r, line), columns)
    return out.select("id", "sread", F.nullif(F.col("chromosome"), F.lit("")).alias("chromosome"), "position", "align_quality")


@_query("source_prb", "SELECT qual, count(*) AS n FROM reads GROUP BY 1")
def source_prb(r: DataFrame) -> DataFrame:
    scores = F.transform(F.split("qual", ""), lambda x: F.concat_ws(" ", (33 - F.ascii(x)).cast("string"), (F.ascii(x) - 33).cast("string"), F.lit("-40"), F.lit("-40")))
    return delimited.read_prb(r.sparkSession, written(r, F.array_join(scores, "\t")), kind="phred33").groupBy("qual").agg(F.count("*").alias("n"))


@_query("source_bowtie", "SELECT id, sread, qual, chromosome, position, strand FROM reads WHERE chromosome IS NOT NULL AND position IS NOT NULL")
def source_bowtie(r: DataFrame) -> DataFrame:
    """Minus-strand reads stand in the file as the reference has them, and come back as they were sequenced."""
    minus, hits = F.col("strand") == "-", r.where("chromosome is not null and position is not null")
    seq = F.when(minus, reverse_complement("sread")).otherwise(F.col("sread"))
    qual = F.when(minus, F.reverse("qual")).otherwise(F.col("qual"))
    folder = written(hits, _tabs(F.col("id"), F.col("strand"), F.col("chromosome"), F.col("position") - 1, seq, qual, F.lit(0), F.lit("")))
    return alignments.read_aligned(r.sparkSession, folder, kind="bowtie").select("id", "sread", "qual", "chromosome", "position", "strand")


@_query("source_soap", "SELECT id, sread, qual, chromosome, position, strand FROM reads WHERE chromosome IS NOT NULL AND position IS NOT NULL")
def source_soap(r: DataFrame) -> DataFrame:
    minus, hits = F.col("strand") == "-", r.where("chromosome is not null and position is not null")
    seq = F.when(minus, reverse_complement("sread")).otherwise(F.col("sread"))
    qual = F.when(minus, F.reverse("qual")).otherwise(F.col("qual"))
    line = _tabs(F.col("id"), seq, qual, F.lit(1), F.lit("a"), F.length("sread"), F.col("strand"), F.col("chromosome"), F.col("position"), F.lit(0), F.lit(""))
    return alignments.read_aligned(r.sparkSession, written(hits, line), kind="soap").select("id", "sread", "qual", "chromosome", "position", "strand")


@_query("count_files", "SELECT CAST(count(*) AS bigint) AS records, CAST(sum(length(sread)) AS bigint) AS nucleotides, CAST(sum(length(qual)) AS bigint) AS scores, CAST(4 * count(*) AS bigint) AS lines FROM reads")
def count_files(r: DataFrame) -> DataFrame:
    folder = written(r, sinks.fastq_record())
    counts = fastq.count_fastq(r.sparkSession, folder).agg(*[F.sum(c).alias(c) for c in ("records", "nucleotides", "scores")])
    lines = files.count_lines(r.sparkSession, folder).agg(F.sum("lines").alias("lines"))
    return counts.crossJoin(F.broadcast(lines))


@_query("filter_files", "SELECT count(*) AS \"reads\", count(*) FILTER (sread NOT LIKE '%N%') AS kept_reads, CAST(sum(length(sread)) AS bigint) AS nucleotides, CAST(sum(length(sread)) FILTER (sread NOT LIKE '%N%') AS bigint) AS kept_nucleotides FROM reads")
def filter_files(r: DataFrame) -> DataFrame:
    folder = written(r, sinks.fastq_record())
    return sinks.filter_folder(r.sparkSession, folder, scratch_folder(r.sparkSession), D.n_filter(0)).select("reads", "kept_reads", "nucleotides", "kept_nucleotides")


@_query("filtered_files", "SELECT id, sread, qual FROM reads WHERE sread NOT LIKE '%N%'")
def filtered_files(r: DataFrame) -> DataFrame:
    spark, to = r.sparkSession, scratch_folder(r.sparkSession)
    sinks.filter_folder(spark, written(r, sinks.fastq_record()), to, D.n_filter(0))
    return fastq.read_fastq(spark, to).select("id", "sread", "qual")


@_query("assessed_files", "SELECT CAST(count(*) AS bigint) AS \"read\", CAST(sum(length(sread) - length(replace(sread, 'A', ''))) AS bigint) AS \"A\" FROM reads")
def assessed_files(r: DataFrame) -> DataFrame:
    """The assessment of written files, summed over them."""
    from .assessment import assess_files

    out = assess_files(r.sparkSession, written(r, sinks.fastq_record()), sample=None)
    reads_, bases = out["read_counts"].agg(F.sum("read").alias("read")), out["base_calls"].agg(F.sum("A").cast("bigint").alias("A"))
    return reads_.crossJoin(F.broadcast(bases))


#: Reads in three folders, numbered on from folder to folder.
_MANY = ", many AS (SELECT *, row_number() OVER (ORDER BY row_ix % 3, row_ix) AS place FROM reads)"


def folders(r: DataFrame, line: Column, compress: bool = False) -> list[str]:
    """Three folders, each with a third of the reads in several files."""
    return [written(r.where(F.col("row_ix") % 3 == k), line, compress) for k in range(3)]


def many_files(r: DataFrame) -> DataFrame:
    """The reads of three folders, the second of which is compressed."""
    paths = [written(r.where(F.col("row_ix") % 3 == k), sinks.fastq_record(), k == 1) for k in range(3)]
    return fastq.read_fastq(r.sparkSession, [f for p in paths for f in files.file_names(p, "^part-")])


def many_alignments(r: DataFrame) -> DataFrame:
    line = _tabs(F.col("id"), F.coalesce("strand", F.lit("+")), F.coalesce("chromosome", F.lit("none")), F.coalesce(F.col("position"), F.lit(0)) - 1, F.col("sread"), F.col("qual"), F.lit(0), F.lit(""))
    paths = folders(r, line)
    return alignments.read_aligned(r.sparkSession, [f for p in paths for f in files.file_names(p, "^part-")], kind="bowtie")


@_query("multi_numbers", f"{_MANY} SELECT place AS row_ix, id, sread FROM many")
def multi_numbers(r: DataFrame) -> DataFrame:
    return many_files(r).select("row_ix", "id", "sread")


@_query("multi_occurrence", f"{_MANY}, n AS (SELECT *, row_number() OVER (PARTITION BY sread ORDER BY place) AS k FROM many) SELECT place AS row_ix, id FROM n WHERE k <= 2")
def multi_occurrence(r: DataFrame) -> DataFrame:
    return D.occurrence_filter(1, 2, None)(many_files(r)).select("row_ix", "id")


@_query("multi_occurrence_tail", f"{_MANY}, n AS (SELECT *, row_number() OVER (PARTITION BY sread ORDER BY place DESC) AS k FROM many) SELECT place AS row_ix, id FROM n WHERE k <= 2")
def multi_occurrence_tail(r: DataFrame) -> DataFrame:
    return D.occurrence_filter(1, 2, None, "tail")(many_files(r)).select("row_ix", "id")


@_query("multi_duplicated", f"{_MANY} SELECT place AS row_ix, id, place > min(place) OVER (PARTITION BY sread) AS duplicated FROM many")
def multi_duplicated(r: DataFrame) -> DataFrame:
    return O.duplicated(many_files(r)).select("row_ix", "id", "duplicated")


@_query("multi_order", f"{_MANY} SELECT id, row_number() OVER (ORDER BY encode(sread), place) AS place, rank() OVER (ORDER BY encode(sread)) AS \"rank\" FROM many")
def multi_order(r: DataFrame) -> DataFrame:
    rows = many_files(r)
    return O.read_order(rows).select("id", "place").join(O.read_rank(rows).select("id", "rank"), "id")


@_query("multi_overlaps", f"""{_MANY}, {RANGES} SELECT place AS row_ix, id, EXISTS (SELECT 1 FROM spans AS s WHERE s.chromosome = many.chromosome
    AND s.start <= coalesce(position, 0) + length(sread) - 1 AND s."end" >= coalesce(position, 0)) AS overlaps FROM many""")
def multi_overlaps(r: DataFrame) -> DataFrame:
    return I.overlaps_any(many_alignments(r), ranges(r.sparkSession)).select("row_ix", "id", "overlaps")


@_query("multi_ranges", f"{_MANY} SELECT id, CAST((place - 1) // 10 AS int) + 1 AS batch FROM many WHERE (place - 1) % 10 < 7")
def multi_ranges(r: DataFrame) -> DataFrame:
    """Seven of each ten records, as so many ranges."""
    n = r.count()
    return X.record_ranges(many_files(r), [(k, k + 6) for k in range(1, n + 1, 10)]).select("id", "batch")


@_query("multi_sample", f"{_MANY} SELECT least(count(*), 1000) AS n, least(count(*), 1000) AS numbers, least(count(*), 1000) AS ids FROM many")
def multi_sample(r: DataFrame) -> DataFrame:
    return X.exact_sample(many_files(r), 1000).agg(F.count("*").alias("n"), F.countDistinct("row_ix").alias("numbers"), F.countDistinct("id").alias("ids"))


@_query("multi_fasta", f"{_MANY} SELECT place AS row_ix, id, sread FROM many")
def multi_fasta(r: DataFrame) -> DataFrame:
    paths = folders(r, sinks.fasta_record())
    return fasta.read_fasta(r.sparkSession, [f for p in paths for f in files.file_names(p, "^part-")]).select("row_ix", "id", "sread")


def maps(r: DataFrame) -> str:
    """Alignment maps of the reads, a few files in the order of places, each with its index."""
    folder = scratch_folder(r.sparkSession)
    placed = F.col("chromosome").isNotNull() & F.col("position").isNotNull()
    rows = r.withColumns({"chromosome": F.when(placed, F.col("chromosome")), "position": F.when(placed, F.col("position"))})
    order = ["chromosome", "position", "row_ix"]
    bam.write_bam(rows.repartitionByRange(3, *[F.col(c).asc_nulls_last() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order]), folder, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return folder


@_query("source_bam", """SELECT id, sread, qual, CASE WHEN position IS NOT NULL THEN chromosome END AS chromosome, CASE WHEN chromosome IS NOT NULL THEN position END AS position,
    CASE WHEN chromosome IS NOT NULL AND position IS NOT NULL THEN strand END AS strand, align_quality,
    row_number() OVER (ORDER BY CASE WHEN position IS NOT NULL THEN chromosome END ASC NULLS LAST, CASE WHEN chromosome IS NOT NULL THEN position END ASC NULLS LAST, row_ix) AS row_ix FROM reads""")
def source_bam(r: DataFrame) -> DataFrame:
    """All records, in ranges of 20,000 bytes."""
    return bam.read_bam(r.sparkSession, maps(r), split=20_000).select("id", "sread", "qual", "chromosome", "position", "strand", "align_quality", "row_ix")


@_query("bam_range", "SELECT id, sread, position, strand FROM reads WHERE chromosome = '3-MEDIUM' AND position <= 180 AND position + length(sread) - 1 >= 120")
def bam_range(r: DataFrame) -> DataFrame:
    """Records that meet positions 120 to 180, by index."""
    return bam.read_bam(r.sparkSession, maps(r), "3-MEDIUM", 120, 180).select("id", "sread", "position", "strand")


@_query("stream_folder", "SELECT id, sread, qual FROM reads")
def stream_folder(r: DataFrame) -> DataFrame:
    """A folder of files, plain and compressed, as a stream that runs until it has read them, in bounded steps."""
    spark, source, to = r.sparkSession, scratch_folder(r.sparkSession), scratch_folder(r.sparkSession)
    for k, part in enumerate(("a", "b")):
        sinks.write_records(r.where(F.col("row_ix") % 2 == k), f"{source}-{part}", sinks.fastq_record(), k == 1)
    rows = None
    for part in ("a", "b"):
        log = f"{to}-{part}.log"
        query = splits.stream_folder(spark, f"{source}-{part}", step=1_000_000, split=200_000, checkpoint=log).writeStream.format("parquet").option("path", f"{to}-{part}").option("checkpointLocation", log).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        found = spark.read.parquet(f"{to}-{part}").select("id", "sread", "qual")
        rows = found if rows is None else rows.unionByName(found)
    return rows


@_query("sampler_draw", "SELECT least(count(*), 700) AS n, least(count(*), 700) AS numbers, count(*) AS added FROM reads")
def sampler_draw(r: DataFrame) -> DataFrame:
    """Rows of a draw, their different numbers, and the rows that one pass saw."""
    from ..streaming.fastq import Sampler

    sampler = Sampler(r.select("row_ix", "id"), 700)
    out = sampler.draw()
    return out.agg(F.count("*").alias("n"), F.countDistinct("row_ix").alias("numbers")).withColumn("added", F.lit(sampler.status()["added"]).cast("bigint"))


@_query("fastq_aside", "SELECT id, CASE WHEN row_ix % 7 = 0 THEN 'sequence and quality differ in width' WHEN row_ix % 11 = 0 THEN 'letter of no nucleotide' END AS reason FROM reads")
def fastq_aside(r: DataFrame) -> DataFrame:
    """Records with a letter too many, or one that is no base, beside the good ones."""
    seven, eleven = F.col("row_ix") % 7 == 0, F.col("row_ix") % 11 == 0
    spoilt = r.withColumns({"sread": F.when(seven, F.concat("sread", F.lit("A"))).when(eleven, F.concat(F.lit("X"), F.substring("sread", 2, 99))).otherwise(F.col("sread"))})
    good, bad = fastq.read_fastq_aside(r.sparkSession, written(spoilt, sinks.fastq_record()))
    bad = bad.select(F.substring(F.substring_index("lines", "\n", 1), 2, 99).alias("id"), "reason")
    return good.select("id", F.lit(None).cast("string").alias("reason")).unionByName(bad)


def _sign(plus: str, minus: str) -> Column:
    return F.when(F.col("strand") == "+", plus).otherwise(minus)


@_query("source_export", "SELECT concat('M_1:', CAST(tile AS varchar), ':', CAST(tile AS varchar), ':', CAST(row_ix AS varchar), ':7') AS id, sread, qual, chromosome, position, strand, align_quality, tile, CAST(row_ix AS int) AS x, CASE WHEN tile > 3 THEN 'Y' ELSE 'N' END AS filtering FROM reads")
def source_export(r: DataFrame) -> DataFrame:
    """All reads, also those without a place."""
    line = _tabs(F.lit("M"), F.lit(1), F.col("tile"), F.col("tile"), F.col("row_ix"), F.lit(7), F.lit("AC"), F.lit(1), F.col("sread"), F.col("qual"), F.col("chromosome"), F.lit(""), F.col("position"), _sign("F", "R"), F.lit("d"), F.col("align_quality").cast("int"), *[F.lit("")] * 5, F.when(F.col("tile") > 3, "Y").otherwise("N"))
    out = alignments.read_aligned(r.sparkSession, written(r, line), kind="export", with_id=True)
    return out.select("id", "sread", "qual", "chromosome", "position", "strand", "align_quality", "tile", "x", "filtering")


@_query("source_realign", """SELECT sread, CASE WHEN position IS NOT NULL THEN replace(chromosome, ' ', '_') END AS chromosome, CASE WHEN chromosome IS NOT NULL THEN position END AS position,
    CASE WHEN chromosome IS NOT NULL AND position IS NOT NULL THEN strand END AS strand, align_quality, CASE WHEN chromosome IS NOT NULL AND position IS NOT NULL THEN 1 ELSE 0 END AS n_match, CASE WHEN chromosome IS NOT NULL AND position IS NOT NULL THEN 3 END AS next_best_align_quality FROM reads""")
def source_realign(r: DataFrame) -> DataFrame:
    """Lines of seven fields for reads with a place, of three for others."""
    score, place = F.col("align_quality").cast("int").cast("string"), F.concat_ws(":", F.replace("chromosome", F.lit(" "), F.lit("_")), F.col("position").cast("string"))
    hit = F.concat_ws(" ", "sread", score, F.lit("1"), place, _sign("F", "R"), "sread", F.lit("3"))
    line = F.when(F.col("chromosome").isNotNull() & F.col("position").isNotNull(), hit).otherwise(F.concat_ws(" ", "sread", score, F.lit("0")))
    return alignments.read_aligned(r.sparkSession, written(r, line), kind="realign").select("sread", "chromosome", "position", "strand", "align_quality", "n_match", "next_best_align_quality")


@_query("source_result", "SELECT sread, chromosome, position, strand, 'U1' AS match_code, tile AS n_one_mismatch, CASE WHEN tile > 4 THEN '3A' ELSE '' END AS mismatch_one FROM reads")
def source_result(r: DataFrame) -> DataFrame:
    line = _tabs(F.col("id"), F.col("sread"), F.lit("U1"), F.lit(0), F.col("tile"), F.lit(0), F.col("chromosome"), F.col("position"), _sign("F", "R"), F.lit("."), F.when(F.col("tile") > 4, "3A").otherwise(""), F.lit(""))
    return alignments.read_aligned(r.sparkSession, written(r, line), kind="result").select("sread", "chromosome", "position", "strand", "match_code", "n_one_mismatch", "mismatch_one")


@_query("source_mapview", "SELECT id, sread, qual, coalesce(chromosome, '*') AS chromosome, position, strand, align_quality, tile AS n_mismatch_best FROM reads")
def source_mapview(r: DataFrame) -> DataFrame:
    line = _tabs(F.col("id"), F.coalesce("chromosome", F.lit("*")), F.col("position"), F.col("strand"), *[F.lit(0)] * 2, F.col("align_quality").cast("int"), *[F.lit(0)] * 2, F.col("tile"), *[F.lit(0)] * 3, F.length("sread"), F.col("sread"), F.col("qual"))
    return alignments.read_aligned(r.sparkSession, written(r, line), kind="mapview").select("id", "sread", "qual", "chromosome", "position", "strand", "align_quality", "n_mismatch_best")


@_query("source_intensities", "SELECT row_ix AS place, CAST(tile + 1 AS double) AS first, CAST(3 * tile + 4 AS double) AS last, CAST(24 * tile + 30 AS double) AS total FROM reads")
def source_intensities(r: DataFrame) -> DataFrame:
    """Three cycles of four values in a text file; x tells the row."""
    cycles = [F.concat_ws(" ", *[(F.col("tile") * c + b).cast("string") for b in range(1, 5)]) for c in range(1, 4)]
    line = _tabs(F.lit(1), F.col("tile"), F.col("row_ix"), F.lit(7), *cycles)
    rows = delimited.read_intensity_text(r.sparkSession, written(r, line))
    total = F.aggregate(F.flatten("intensity"), F.lit(0.0), lambda a, x: a + x)
    return rows.select(F.col("x").cast("bigint").alias("place"), F.col("intensity")[0][0].alias("first"), F.col("intensity")[2][3].alias("last"), total.alias("total"))


@_query("source_fastq_blocked", "SELECT row_number() OVER (ORDER BY row_ix) AS row_ix, id, sread, qual FROM reads")
def source_fastq_blocked(r: DataFrame) -> DataFrame:
    """Block-gzipped files, read in ranges of 30,000 bytes."""
    folder = scratch_folder(r.sparkSession)
    blocked.write_fastq_blocked(r, folder)
    return blocked.read_fastq_blocked(r.sparkSession, folder, split=30_000).select("row_ix", "id", "sread", "qual")


@_query("multi_counts", "SELECT CAST(row_ix % 3 AS int) AS folder, count(*) AS records, CAST(sum(length(sread)) AS bigint) AS nucleotides, CAST(sum(length(qual)) AS bigint) AS scores FROM reads GROUP BY 1")
def multi_counts(r: DataFrame) -> DataFrame:
    """Counts of the files of three folders, a folder of which has sequences and qualities that span lines."""
    rows = None
    halves = lambda c: F.concat_ws("\n", F.substring(c, 1, 9), F.substring(c, 10, 99))
    for k in range(3):
        line = F.concat(F.lit("@"), "id", F.lit("\n"), halves("sread"), F.lit("\n+\n"), halves("qual")) if k == 2 else sinks.fastq_record()
        counts = fastq.count_fastq(r.sparkSession, written(r.where(F.col("row_ix") % 3 == k), line), spanning=k == 2)
        one = counts.agg(*[F.sum(c).alias(c) for c in ("records", "nucleotides", "scores")]).withColumn("folder", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    return rows
