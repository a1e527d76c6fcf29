"""One order of records over all files: numbers, groups, overlaps, samples and ranges of several files, and sinks."""

import gzip
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandmill.errors import ArgumentMismatch
from strandmill.operators import filters as D
from strandmill.operators import intervals as I
from strandmill.operators import order as O
from strandmill.operators import tables as X
from strandmill.sources import delimited, fasta, fastq, files, sinks

READS = {"b.fastq": ["AAAA", "AAAA", "CC"], "a.fastq.gz": ["CC", "AAAA", "GGG"], "c d.fastq": ["T"]}


def write(path, text):
    path.write_bytes(gzip.compress(text.encode()) if path.name.endswith(".gz") else text.encode())
    return str(path)


@pytest.fixture
def three(tmp_path):
    return [write(tmp_path / name, "".join(f"@{name[0]}{k}\n{s}\n+\n{'I' * len(s)}\n" for k, s in enumerate(seqs))) for name, seqs in READS.items()]


def test_numbers_follow_the_paths_given(spark, tmp_path, three):
    for given in (three, [f"file://{p}" for p in three], three[::-1]):
        names = [os.path.basename(p) for p in given]
        want = [(k, s) for k, s in enumerate((s for n in names for s in READS[n]), 1)]
        assert sorted(map(tuple, fastq.read_fastq(spark, given).select("row_ix", "sread").collect())) == want
    by_name = [s for n in sorted(READS) for s in READS[n]]
    assert [r.sread for r in fastq.read_fastq(spark, str(tmp_path), "fastq").orderBy("row_ix").collect()] == by_name
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        assert [r.sread for r in fastq.read_fastq(spark, str(tmp_path), "fastq").orderBy("row_ix").collect()] == by_name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_groups_over_files(spark, three):
    reads = fastq.read_fastq(spark, three)
    places = lambda df: sorted(r.row_ix for r in df.collect())
    assert places(D.occurrence_filter(1, 1)(reads)) == [1, 3, 6, 7]
    assert places(D.occurrence_filter(1, 1, None, "tail")(reads)) == [4, 5, 6, 7]
    assert len(places(D.occurrence_filter(1, 1, None, "sample")(reads))) == 4
    assert places(D.occurrence_filter(1, 1, None, lambda g, n: sorted(g["row_ix"])[-n:])(reads)) == [4, 5, 6, 7]
    assert places(O.duplicated(reads).where("duplicated")) == [2, 4, 5]
    assert [r.row_ix for r in O.read_order(reads).orderBy("place").collect()] == [1, 2, 5, 3, 4, 6, 7]
    rows = reads.withColumns({"chromosome": F.lit("c"), "position": (F.col("row_ix") * 10).cast("int"), "strand": F.lit("+")})
    ranges = spark.createDataFrame([("c", 10, 12), ("c", 43, 43), ("c", 71, 80)], "chromosome string, start int, end int")
    assert places(I.overlaps_any(rows, ranges).where("overlaps")) == [1]
    assert places(X.rows_at(reads, [2, 5])) == [2, 5] and places(X.rows_at(reads, [-2, -5])) == [1, 3, 4, 6, 7]


def test_samples_are_uniform_over_files(spark, tmp_path):
    paths = [write(tmp_path / f"{k}.fastq", "".join(f"@{k}.{i}\nA\n+\nI\n" for i in range(100))) for k in range(3)]
    reads = fastq.read_fastq(spark, paths)
    taken = Counter()
    for seed in range(30):
        ids = [r.id for r in X.exact_sample(reads, 60, seed=seed).collect()]
        assert len(set(ids)) == 60
        taken.update(i.split(".")[0] for i in ids)
    # 1,800 draws over three files: chi-square with two degrees of freedom below its 99.9th percentile.
    assert sum((taken[k] - 600) ** 2 / 600 for k in "012") < 13.8


def test_many_ranges(spark):
    df = spark.range(1, 300_001).withColumnRenamed("id", "row_ix").withColumn("x", F.col("row_ix") * 2)
    got = X.record_ranges(df, [(k, k + 1) for k in range(2, 300_000, 3)])
    row = got.agg(F.count("*"), F.max("batch"), F.sum((F.floor((F.col("row_ix") - 2) / 3) + 1 != F.col("batch")).cast("int")), F.sum("x")).first()
    want = [r for k in range(2, 300_000, 3) for r in (k, k + 1) if r <= 300_000]
    assert tuple(row) == (len(want), 100_000, 0, 2 * sum(want))
    assert X.record_ranges(df, []).count() == 0 and X.record_ranges(df, []).columns == got.columns
    for bad in ([(3, 2)], [(1, 5), (5, 6)]):
        with pytest.raises(ArgumentMismatch):
            X.record_ranges(df, bad)
    assert X.rows_at(df, list(range(1, 20_001))).count() == 20_000


def test_rank_is_written_once_and_can_be_deleted(spark):
    df = spark.createDataFrame([(i, "AC"[i % 2] * (i % 5)) for i in range(500)], "row_ix bigint, sread string").repartition(7)
    kept = []
    got = {r.row_ix: r["rank"] for r in O.read_rank(df, kept=kept).collect()}
    reads = sorted("AC"[i % 2] * (i % 5) for i in range(500))
    assert got == {i: reads.index("AC"[i % 2] * (i % 5)) + 1 for i in range(500)}
    assert len(kept) == 1 and os.path.isdir(kept[0]) and spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    files.discard(spark, kept)
    assert kept == []
    nulls = spark.createDataFrame([(1, None), (2, "B"), (3, None), (4, "A")], "row_ix bigint, sread string")
    assert {r.row_ix: r["rank"] for r in O.read_rank(nulls).collect()} == {4: 1, 2: 2, 1: 3, 3: 3}
    assert O.read_rank(nulls.where("false")).count() == 0


def test_fasta_over_files(spark, tmp_path):
    a = write(tmp_path / "b.fa", ">x 1\nA\n>x 2\nCC\n>y\nG\n")
    b = write(tmp_path / "a.fa", ">z\nT\nT\n>x 3\nN\n")
    got = [(r.row_ix, r.id, r.sread) for r in fasta.read_fasta(spark, [a, b]).orderBy("row_ix").collect()]
    assert got == [(1, "x 1", "A"), (2, "x 2", "CC"), (3, "y", "G"), (4, "z", "TT"), (5, "x 3", "N")]
    got = [(r.row_ix, r.id) for r in fasta.read_fasta(spark, [a, b], skip=1, limit=1).orderBy("row_ix").collect()]
    assert got == [(1, "x 2"), (2, "x 3")]
    q = write(tmp_path / "q", ">x a\n1\n>x b\n2 3\n>y\n4\n")
    both = [(r.row_ix, r.sread, r.qual) for r in fasta.read_fasta_quality(spark, a, q).orderBy("row_ix").collect()]
    assert both == [(1, "A", '"'), (2, "CC", "#$"), (3, "G", "%")]


def test_lines_over_files(spark, tmp_path):
    paths = [write(tmp_path / f"t{k}", f"#c\nname\n{k}a\n\n{k}b\n") for k in (2, 1)]
    got = delimited.read_columns(spark, paths, {"x": "string"}, header=True, skip=1).orderBy("row_ix").collect()
    assert [(r.row_ix, r.x) for r in got] == [(3, "2a"), (5, "2b"), (8, "1a"), (10, "1b")]
    cells = [write(tmp_path / f"{kind}{k}", f"1\t1\t5\t6\t{k} 0 0 {n}\n" * 2) for n, kind in ((1, "i"), (2, "e")) for k in (1, 2)]
    both = delimited.read_intensity_text(spark, cells[:2], cells[2:]).orderBy("row_ix").collect()
    assert [(r.row_ix, r.intensity[0], r.error[0]) for r in both] == [(i, [k, 0, 0, 1], [k, 0, 0, 2]) for i, k in ((1, 1), (2, 1), (3, 2), (4, 2))]


def test_widths_must_agree(spark, tmp_path):
    with pytest.raises(Exception, match="differ in width"):
        fastq.read_fastq(spark, write(tmp_path / "w.fastq", "@a\nACGT\n+\nII\n")).collect()


def test_one_file_of_shared_parts(spark, tmp_path, three):
    reads = fastq.read_fastq(spark, three)
    for name, compress in (("one.fastq", False), ("one.fastq.gz", True)):
        out = str(tmp_path / "out" / name)
        os.makedirs(os.path.dirname(out), exist_ok=True)
        assert sinks.write_fastq(reads, out, compress=compress) == 7
        assert [r.sread for r in fastq.read_fastq(spark, out).orderBy("row_ix").collect()] == [s for n in READS for s in READS[n]]
        assert sorted(os.listdir(os.path.dirname(out)))[-1] == name
