"""Formats, with files written here."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.errors import ArgumentMismatch, InputError, ValidityError
from strandmill.functions.trim import trim_tails
from strandmill.operators.filters import width_filter
from strandmill.sources import alignments, binary, catalog, delimited, fasta, fastq, files, sinks


def write(path, text):
    path.write_bytes(gzip.compress(text.encode()) if path.name.endswith(".gz") else text.encode())
    return str(path)


def records(n, width=7):
    return [(f"read{i} x", ("ACGT." * 9)[i % 5 : i % 5 + width], chr(64 + i % 30) * width) for i in range(n)]


def as_text(rs):
    return "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in rs)


def test_fastq(spark, tmp_path):
    rs = records(300)
    a = write(tmp_path / "a.fastq", as_text(rs))
    b = write(tmp_path / "b.fastq.gz", as_text(rs[:5]))
    want = [(k, i, s.replace(".", "-"), q) for k, (i, s, q) in enumerate(rs, 1)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        out = fastq.read_fastq(spark, a)
        assert out.rdd.getNumPartitions() > 3
        assert [tuple(r)[1:] for r in out.orderBy("row_ix").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    both = fastq.read_fastq(spark, str(tmp_path), r"\.fastq")
    assert both.count() == 305
    counts = {r.file.rsplit("/", 1)[1]: tuple(r)[1:] for r in fastq.count_fastq(spark, [a, b]).collect()}
    assert counts == {"a.fastq": (300, 2100, 2100), "b.fastq.gz": (5, 35, 35)}
    assert {r.file: r.lines for r in files.count_lines(spark, [a, b]).collect()} == {"a.fastq": 1200, "b.fastq.gz": 20}
    ends = [write(tmp_path / f"l{i}", t) for i, t in enumerate(["a\nbb", "a\nbb\n", "é\n\nx", "\n"])]
    assert {r.file: r.lines for r in files.count_lines(spark, ends).collect()} == {"l0": 1, "l1": 2, "l2": 2, "l3": 1}
    assert fastq.read_fastq(spark, a, keep=width_filter(8)).count() == 0
    assert fastq.read_with_encoding(spark, b)[1] == "phred33"
    assert fastq.FastqFile(a).count(spark).first().records == 300 and fastq.FastqFileList(a, b).read(spark).count() == 305
    with pytest.raises(InputError):
        fastq.read_fastq(spark, write(tmp_path / "c", as_text(rs) + "@x\n"))
    with pytest.raises(InputError):
        files.file_names(str(tmp_path), "nothing")
    empty = fastq.read_fastq(spark, write(tmp_path / "z", "@ \n\n+\n\n"), with_ids=False).collect()
    assert [(r.sread, r.qual) for r in empty] == [("", "")]


def test_other_splits(spark, tmp_path):
    """Settings that change between plan and action give the same reads or an error, never other reads."""
    path = str(tmp_path / "many.fastq")
    with open(path, "w") as f:
        f.writelines(f"@r{i}\nACGT{'ACGT'[i % 4] * (i % 7)}\n+\nIIII{'@' * (i % 7)}\n" for i in range(1, 4001))
    want = [(i, f"r{i}", "ACGT" + "ACGT"[i % 4] * (i % 7)) for i in range(1, 4001)]
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    try:
        for at_plan, at_action in ((old, old), ("10000", "10000"), ("10000", "7000"), (old, "7000"), ("7000", old)):
            spark.conf.set(key, at_plan)
            reads = fastq.read_fastq(spark, f"file://{path}")
            spark.conf.set(key, at_action)
            if at_plan == at_action:
                assert sorted(tuple(r) for r in reads.select("row_ix", "id", "sread").collect()) == want
            else:
                with pytest.raises(Exception, match="read it again"):
                    reads.collect()
        spark.conf.set(key, "7000")
        assert files.file_names(f"file://{tmp_path}", "^many") and fastq.read_fastq(spark, f"file://{tmp_path}", "fastq$").count() == 4000
        reads = fastq.read_fastq(spark, path)
        with open(path, "a") as f:
            f.write("@more\nA\n+\nI\n")
        with pytest.raises(Exception, match="read it again"):
            spark.catalog.refreshByPath(path)
            reads.collect()
        with pytest.raises(InputError):
            files.file_names("file:///nowhere/at/all")
    finally:
        spark.conf.set(key, old)


def test_round_trip(spark, tmp_path):
    rs = records(20)
    path = write(tmp_path / "a.fastq", as_text(rs))
    reads = fastq.read_fastq(spark, path)
    out = str(tmp_path / "out.fastq.gz")
    assert sinks.write_fastq(reads, out, full=True) == 20
    again = fastq.read_fastq(spark, out)
    cols = ["row_ix", "id", "sread", "qual"]
    assert sorted(map(tuple, again.select(*cols).collect())) == sorted(map(tuple, reads.select(*cols).collect()))
    with pytest.raises(InputError):
        sinks.write_fastq(reads, out)
    sinks.write_fastq(reads, out, mode="a")
    assert fastq.read_fastq(spark, out).count() == 40
    assert sinks.write_fastq(reads.where("false"), str(tmp_path / "none"), compress=False) == 0 and (tmp_path / "none").read_bytes() == b""
    sinks.write_records(reads, str(tmp_path / "many"), sinks.fastq_record())
    assert fastq.read_fastq(spark, files.file_names(str(tmp_path / "many"), "^part")).count() == 20
    stats = sinks.filter_fastq(spark, [path], [str(tmp_path / "kept")], lambda d: d.where("row_ix % 2 = 1"), compress=False).first()
    assert (stats.reads, stats.kept_reads, stats.nucleotides, stats.kept_nucleotides) == (20, 10, 140, 70)
    sinks.trim_files(spark, [path], [str(tmp_path / "cut")], trim_tails, compress=False, k=1, a="A")
    assert fastq.read_fastq(spark, str(tmp_path / "cut")).count() == 18
    with pytest.raises(InputError):
        sinks.filter_fastq(spark, [path], [str(tmp_path / "kept")], width_filter(1))


def test_fasta(spark, tmp_path):
    f = write(tmp_path / "a.fna", ">one x\nACG\nTac\n>two\n>three\nGG\n")
    q = write(tmp_path / "a.qual", ">one\n1 2 3\n40 5  6\n>three y\n7 8\n;note\n>two\n")
    assert [tuple(r)[1:] for r in fasta.read_fasta(spark, f).orderBy("row_ix").collect()] == [(1, "one x", "ACGTAC"), (2, "two", ""), (3, "three", "GG")]
    assert [r.id for r in fasta.read_fasta(spark, f, skip=1, limit=1).collect()] == ["two"]
    both = catalog.RunPath(str(tmp_path)).read_fasta_quality(spark).orderBy("row_ix").collect()
    assert [(r.sread, r.qual) for r in both] == [("ACGTAC", "\"#$I&'"), ("", ""), ("GG", "()")]
    with pytest.raises(ValidityError):
        fasta.read_fasta_quality(spark, f, write(tmp_path / "b.qual", ">one\n1\n"))
    reads = fasta.read_fasta(spark, f)
    assert sinks.write_fasta(reads, str(tmp_path / "o.fa")) == 3


def test_delimited(spark, tmp_path):
    path = write(tmp_path / "x.txt", "#c\na\t1\tac.g\nb\t\tN\n")
    out = delimited.read_columns(spark, path, {"name": "string", "n": "int", "s": "dna"}).orderBy("row_ix").collect()
    assert [tuple(r)[2:] for r in out] == [("a", 1, "AC-G"), ("b", None, "N")]
    assert delimited.read_columns(spark, path, {"name": "string", "n": None, "s": None}, limit=1).columns == ["file", "row_ix", "name"]
    qseq = write(tmp_path / "s_qseq.txt", "M\t1\t2\t3\t4\t5\t0\t1\tAC.\thhh\t1\nM\t1\t2\t3\t4\t6\t0\t1\tACG\thhB\t0\n")
    assert [r.id for r in delimited.read_qseq(spark, qseq, filtered=True).collect()] == ["M:1:2:3:4:5"]
    assert [r.filter for r in delimited.read_qseq(spark, qseq, as_reads=False).orderBy("row_ix").collect()] == ["Y", "N"]
    prb = write(tmp_path / "s_1_prb.txt", " 40 -40 -40 -40\t-5 3 1 2\n")
    write(tmp_path / "s_1_seq.txt", "1\t2\t3\t4\tA.\n")
    assert delimited.read_prb(spark, prb).first().qual == "hC" and delimited.read_prb(spark, prb, kind="integer").first().scores == [40, 3]
    assert delimited.read_prb(spark, prb, kind="array").first().scores[1] == [-5, 3, 1, 2]
    assert [(r.sread, r.qual) for r in delimited.read_base_quality(spark, str(tmp_path)).collect()] == [("A-", "hC")]
    a, b = write(tmp_path / "int.txt", "1\t2\t3\t4\t1.5 2 3 4\t5 6 7 8\n"), write(tmp_path / "nse.txt", "1\t2\t3\t4\t0 0 0 1\t1 1 1 1\n")
    row = delimited.read_intensity_text(spark, a, b).first()
    assert row.intensity == [[1.5, 2, 3, 4], [5, 6, 7, 8]] and row.error[0] == [0, 0, 0, 1]
    with pytest.raises(ValidityError):
        delimited.read_intensity_text(spark, a, write(tmp_path / "n2.txt", "1\t2\t3\t4\t0 0 0 1\n"))


def test_alignments(spark, tmp_path):
    read = lambda text, **o: alignments.read_aligned(spark, write(tmp_path / "f", text), **o).orderBy("row_ix").collect()
    row = read("r1\t+\tchr\t9\tACG\tIJK\t0\t1:A>C\nr2\t-\tchr\t9\tAAC\tIJK\t2\t\n", kind="bowtie")
    assert [(r.id, r.position, r.sread, r.qual, r.mismatch) for r in row] == [("r1", 10, "ACG", "IJK", "1:A>C"), ("r2", 10, "GTT", "KJI", "")]
    scored = alignments.mismatch_scores(alignments.read_aligned(spark, str(tmp_path / "f"), kind="bowtie")).orderBy("row_ix").collect()
    assert [(r.n_mismatch, r.mismatch_score) for r in scored] == [(1, 41), (0, None)]
    row = read("s1\tAC\thB\t1\ta\t2\t-\tref\t7\t2\tC->1A\tG->0T\n", kind="soap")[0]
    assert (row.sread, row.qual, row.position, row.hit_detail, row.paired_end) == ("GT", "Bh", 7, "C->1A\tG->0T", "a")
    row = read("#c\nACGT 1000 1 chr:5:6 R ACGT 99\nACG 0 0\n", kind="realign")
    assert [(r.chromosome, r.position, r.strand, r.align_quality, r.n_match, r.qual) for r in row] == [("chr", None, "-", 1000.0, 1, "    "), (None, None, None, 0.0, 0, "   ")]
    export = "M\trun\t2\t1\t45\t94\tAA\t1\tAC.\tYQM\tchr1\t\t8\tF\t35\t70" + "\t" * 5 + "\tY\n"
    row = read(export, kind="export", with_all=True)[0]
    assert (row.id, row.sread, row.position, row.strand, row.align_quality, row.filtering, row.multiplex_index) == ("M_run:2:1:45:94#AA/1", "AC-", 8, "+", 70.0, "Y", "AA")
    with pytest.raises(Exception, match="wrong number of fields"):
        read("a\tb\n", kind="export")
    row = read("id\tAC\tU0\t1\t0\t0\tchr\t4\tR\t.\t\t\n", kind="result")[0]
    assert (row.strand, row.position, row.match_code, row.align_quality) == ("-", 4, "U0", None)
    row = read("n\tc\t3\t-\t0\t0\t60\t0\t0\t1\t20\t1\t0\t2\tAC\tII\n", kind="mapview")[0]
    assert (row.position, row.strand, row.align_quality, row.mismatch_quality) == (3, "-", 60.0, 20)
    with pytest.raises(ArgumentMismatch):
        read("", kind="bam")


def test_maps(spark, tmp_path):
    for short, width in ((False, 128), (True, 64)):
        seq = bytes([1 << 6 | 30, 2 << 6 | 20, 0, 3 << 6 | 10])
        one = struct.pack(f"<{width}s8BIIi36s", seq, 4, 60, 2 << 4 | 1, 33, 5, 6, 0, 0, 1, 9 << 1 | 1, 0, b"name")
        head = struct.pack("<ii", -1, 2) + b"".join(struct.pack("<i", len(n)) + n for n in (b"a\0", b"chrB\0")) + struct.pack("<Q", 1)
        path = tmp_path / f"m{width}.map"
        path.write_bytes(gzip.compress(head + one))
        row = alignments.read_aligned(spark, str(path), kind="maq_short" if short else "maq").first()
        assert (row.id, row.sread, row.qual, row.chromosome, row.position, row.strand, row.align_quality) == ("name", "CGNT", "?5!+", "chrB", 10, "-", 60.0)
        assert (row.n_mismatch_best, row.n_mismatch_best_24, row.mismatch_quality, row.n_exact_match_24, row.n_one_mismatch_24) == (1, 2, 33, 5, 6)
        assert alignments.read_aligned(spark, str(path), kind="maq_short" if short else "maq", limit=0).count() == 0
    path = tmp_path / "x.bfa"
    path.write_bytes(b"".join(struct.pack("<i", len(n)) + n + struct.pack("<ii", size, (size >> 5) + 1) + bytes(16 * ((size >> 5) + 1)) for n, size in ((b"one\0", 40), (b"two\0", 7))))
    assert sorted(map(tuple, binary.read_bfa_lengths(spark, str(path)).collect())) == [("one", 40), ("two", 7)]


def test_intensities(spark, tmp_path):
    write(tmp_path / "s_1_0001_int.txt.p.gz", "#A\n 1 2 3 4\n 5 6 7 8\n#END CYCLE 1\n 9 9 9 9\n -1.5 0 0 0\n#END CYCLE 2\n")
    write(tmp_path / "s_1_0001_nse.txt.p.gz", "#A\n 1 1 1 1\n 1 1 1 1\n#END CYCLE 1\n 2 2 2 2\n 2 2 2 2\n#END CYCLE 2\n")
    write(tmp_path / "s_1_0001_pos.txt", "1.0 2.0\n3.0 4.5\n")
    rows = binary.read_ipar(spark, str(tmp_path)).orderBy("row_ix").collect()
    assert rows[1].intensity == [[5, 6, 7, 8], [-1.5, 0, 0, 0]] and rows[1].y == 4.5 and (rows[0].lane, rows[0].tile) == (1, 1)
    for c in (1, 2):
        d = tmp_path / "L001" / f"C{c}.1"
        d.mkdir(parents=True)
        for ext in ("cif", "cnf"):
            (d / f"s_1_1.{ext}").write_bytes(b"CIF" + struct.pack("<BBHHI", 1, 2, c, 1, 2) + (np.arange(8) * c).astype("<i2").tobytes())
    rows = binary.read_cif(spark, str(tmp_path), 1, [1, 2], [1]).orderBy("row_ix").collect()
    assert rows[0].intensity == [[0, 2, 4, 6], [0, 4, 8, 12]] and rows[1].error[0] == [1, 3, 5, 7] and rows[1].x == 3.0


def test_catalog(spark, tmp_path):
    gerald = tmp_path / "Data" / "C1-36" / "Bustard1" / "GERALD1"
    gerald.mkdir(parents=True)
    write(gerald / "s_1_sequence.txt", as_text(records(3)))
    path = catalog.InstrumentPath(str(tmp_path))
    assert path.read_fastq(spark).count() == 3
    assert len(catalog.LaneSet(path, [{"lane": i} for i in range(8)]).names) == 8
    with pytest.raises(ValidityError):
        catalog.LaneSet(path, [])
    with pytest.raises(ArgumentMismatch):
        catalog.InstrumentPath(str(tmp_path / "none"))
    assert F is not None


def test_bam(spark, tmp_path):
    def record(name, ref, pos, flag, seq, cigar):
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 30, 0, len(cigar), flag, len(seq), -1, -1, 0) + name + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | binary.BAM_CIGAR.index(op)) for n, op in cigar)
        code = [binary.BAM_BASES.index(x) for x in seq] + [0] * (len(seq) % 2)
        body += bytes(a << 4 | b for a, b in zip(code[::2], code[1::2])) + bytes(range(10, 10 + len(seq)))
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    path = tmp_path / "a.bam"
    path.write_bytes(gzip.compress(head) + gzip.compress(record(b"r1", 0, 9, 0, "ACGTN", [(5, "M")]) + record(b"r2", 0, 99, 16, "GGT", [(2, "M"), (1, "S")])) + gzip.compress(record(b"r3", -1, -1, 4, "A", [])) + gzip.compress(b""))
    rows = binary.read_bam(spark, str(path)).orderBy("row_ix").collect()
    assert [(r.id, r.sread, r.qual, r.chromosome, r.position, r.strand, r.cigar) for r in rows] == [("r1", "ACGTN", "+,-./", "chr1", 10, "+", "5M"), ("r2", "GGT", "+,-", "chr1", 100, "-", "2M1S"), ("r3", "A", "+", None, None, None, "")]
    assert [r.id for r in binary.read_bam(spark, str(path), "chr1", 101, 200).collect()] == ["r2"]
