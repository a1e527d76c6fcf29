"""Malformed records beside the good ones, and errors of tasks in the library's classes."""

import pytest

from strandmill.errors import InputError, ReadsError, typed_errors
from strandmill.sources import alignments, bam, fastq


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fastq_aside(spark, tmp_path):
    a = write(tmp_path / "a", "@1\nACGT\n+\nIIII\n@2\nACGT\n+\nII\n  \nA\n+\nI\n@4\nAXG\n+\nIII\n@5\nac.\n+\nIII\nx6\nA\n+\nI\n@7\nA\nno\nI\n@8\nACG\n")
    b = write(tmp_path / "b", "@9\nG\n+\nI\n@10\nT\n")
    good, bad = fastq.read_fastq_aside(spark, [a, b])
    assert [(r.row_ix, r.id, r.sread) for r in good.orderBy("row_ix").collect()] == [(1, "1", "ACGT"), (5, "5", "AC-"), (9, "9", "G")]
    got = [(r.file.rsplit("/")[-1], r.record, r.row_ix, r.reason) for r in bad.orderBy("row_ix").collect()]
    assert got == [
        ("a", 2, 2, "sequence and quality differ in width"), ("a", 3, 3, "empty id line"), ("a", 4, 4, "letter of no nucleotide"), ("a", 6, 6, "id line does not begin with @"),
        ("a", 7, 7, "third line does not begin with +"), ("a", 8, 8, "record is not whole"), ("b", 2, 10, "record is not whole"),
    ]
    assert bad.where("row_ix = 8").first().lines == "@8\nACG"
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9")
    try:
        good, bad = fastq.read_fastq_aside(spark, [a, b])
        assert good.count() == 3 and bad.count() == 7
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_alignments_aside(spark, tmp_path):
    path = write(tmp_path / "a", "r1\t+\tc\t4\tAC\tII\t0\t\nr2\t?\tc\t4\tAC\tII\t0\t\nr3\t+\tc\tx\tAC\tII\t0\t\nr4\t+\tc\nr5\t-\tc\t0\tAC\tI#\t0\t\n")
    good, bad = alignments.read_aligned_aside(spark, path, kind="bowtie")
    assert [(r.row_ix, r.id, r.sread, r.position) for r in good.orderBy("row_ix").collect()] == [(1, "r1", "AC", 5), (5, "r5", "GT", 1)]
    assert [(r.line, r.reason) for r in bad.orderBy("line").collect()] == [(2, "unknown strand"), (3, "position is no number"), (4, "wrong number of fields")]
    assert bad.where("line = 4").first().value == "r4\t+\tc"
    export = write(tmp_path / "e", "M\trun\t2\t1\t45\t94\tAA\t1\tAC.\tYQM\tchr1\t\t8\tF\t35\t70" + "\t" * 5 + "\tY\nshort\tline\n")
    good, bad = alignments.read_aligned_aside(spark, export, kind="export", with_id=True)
    assert [r.id for r in good.collect()] == ["M_run:2:1:45:94"] and [r.reason for r in bad.collect()] == ["wrong number of fields"]


def test_errors_of_tasks(spark, tmp_path):
    wide = fastq.read_fastq(spark, write(tmp_path / "w", "@a\nACGT\n+\nII\n"))
    with pytest.raises(InputError, match="^sequence and quality differ in width in file .*, record 1$"), typed_errors():
        wide.collect()
    with pytest.raises(InputError, match="unknown strand: [?]"), typed_errors():
        alignments.read_aligned(spark, write(tmp_path / "s", "r2\t?\tc\t4\tAC\tII\t0\t\n"), kind="bowtie").collect()
    # An error that a Python worker raises.
    with pytest.raises(InputError, match="is no binary alignment map"), typed_errors():
        bam.read_bam(spark, write(tmp_path / "b", "nothing")).collect()
    with pytest.raises(Exception) as other, typed_errors():
        spark.sql("SELECT raise_error('something else')").collect()
    assert not isinstance(other.value, ReadsError)


def test_spanning_records(spark, tmp_path):
    import gzip

    a = write(tmp_path / "b", "@a x\nAC\nG\n+\nI@I\n@b\n.\n+b\nI\n@c\nACGTACGT\n+\n@@\n@@@@\n@@")
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"@d\nA\n+\nI\n"))
    got = fastq.read_fastq_spanning(spark, [a, str(tmp_path / "a.gz")], block=7).orderBy("row_ix").collect()
    assert [(r.row_ix, r.id, r.sread, r.qual) for r in got] == [(1, "a x", "ACG", "I@I"), (2, "b", "-", "I"), (3, "c", "ACGTACGT", "@" * 8), (4, "d", "A", "I")]
    counts = {r.file.rsplit("/")[-1]: (r.records, r.nucleotides) for r in fastq.count_fastq(spark, [a, str(tmp_path / "a.gz")], spanning=True).collect()}
    assert counts == {"b": (3, 12), "a.gz": (1, 1)}
    with pytest.raises(InputError, match="within a record"), typed_errors():
        fastq.read_fastq_spanning(spark, write(tmp_path / "cut", "@a\nACG\n+\nII")).collect()
