"""Quality assessment, flags and reports."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.errors import IncompatibleTypes, InputError
from strandmill.plans import assessment as Q
from strandmill.plans.report import write_report
from strandmill.plans.surrogate import reads


def test_assess_and_report(spark, sf_dir, tmp_path):
    r = reads(spark, sf_dir)
    out = Q.assess(r, kept=F.col("tile") > 2, aligned=F.col("position").isNotNull(), sample=50)
    assert out["read_counts"].agg(F.sum("read")).first()[0] == r.count()
    assert out["base_calls"].count() == 4 and out["sequence_distribution"].select("type").distinct().count() == 3
    some = {k: out[k] for k in ("read_counts", "tiles")}
    page = write_report(some, str(tmp_path / "report"))
    text = open(page).read()
    assert "Read counts" in text and "lane0" in text and text.count("<svg") == 2
    whole = open(write_report({k: out[k] for k in ("base_quality", "sequence_distribution", "cycle_quality", "cycle_base_calls", "depth")}, str(tmp_path / "whole"))).read()
    assert whole.count("<svg") == 6 and "Not available" not in whole
    with pytest.raises(InputError):
        write_report(some, str(tmp_path / "report"))
    assert Q.bind(some, some)["read_counts"].count() == 8
    with pytest.raises(IncompatibleTypes):
        Q.bind(some, {})


def test_kinds(spark, sf_dir):
    r = reads(spark, sf_dir).limit(200)
    export = Q.assess_export(r.withColumn("filtering", F.when(F.col("tile") > 2, "Y").otherwise("N")))["read_counts"]
    assert all(x.aligned <= x.filtered <= x.read for x in export.collect())
    assert "multiple_alignment" in Q.assess_realign(r.withColumn("n_match", F.col("tile")))
    assert Q.assess_bowtie(r)["align_quality"].count() > 1 and Q.assess_map(r)["base_calls"].count() == 4


def test_collate(spark, sf_dir):
    r = reads(spark, sf_dir).withColumnRenamed("lane", "file")
    summaries = [Q.nucleotide_use(), Q.frequent_sequence(3, 0.001), Q.sequence_use(), Q.quality_use(), Q.read_quality(), Q.adapters("ACGT"), Q.nucleotide_by_cycle(), Q.quality_by_cycle()]
    summaries[0].add_filter = lambda d: F.col("tile") == 1
    out = Q.collate(r, summaries, sample=None)
    assert out.sources.count() == 4 and set(out.tables) == {s.name for s in summaries}
    assert out.flagged["frequent_sequence"].where("flagged").count() > 0
    all_reads, left = out.tables["nucleotide_use"].agg(F.sum("A")).first()[0], out.tables["sequence_use"].agg(F.sum(F.col("n_occurrences") * F.col("n_reads"))).first()[0]
    assert all_reads > 0 and left == r.where("tile <> 1").count()


def test_files(spark, tmp_path):
    for name, n in (("a", 30), ("b", 5)):
        (tmp_path / f"{name}.fastq").write_text("".join(f"@{i}\nACGTN\n+\nIIIII\n" for i in range(n)))
    out = Q.assess_files(spark, str(tmp_path), "fastq$", sample=10)
    assert {r.source: r["read"] for r in out["read_counts"].collect()} == {"a.fastq": 30, "b.fastq": 5}
    assert {r.source: r.A for r in out["base_calls"].collect()} == {"a.fastq": 10, "b.fastq": 5}
    details = {r.source: r.length for r in Q.file_details(spark, str(tmp_path), "fastq$").collect()}
    assert details == {p.name: p.stat().st_size for p in tmp_path.iterdir()}
    (tmp_path / "hits.txt").write_text("r1\t-\tc\t4\tACG\tIII\t0\t\nr2\t+\tc\t9\tAC\tII\t0\t\n")
    assert Q.assess_files(spark, str(tmp_path), "hits", kind="bowtie")["read_counts"].first().aligned == 2


def test_fences():
    assert Q.fences([1, 2, 3, 4, 100]) == (-1, 7)
    assert Q.fences([5]) == (5, 5)


def test_one_pass_counts_all_tables(spark):
    """All tables of a run from one pass over the reads, equal to those that are counted one by one."""
    rnd = random.Random(4)
    rows = [(i, f"l{i % 3}", i % 4 + 1, "".join(rnd.choice("ACGTN") for _ in range(i % 7)), "".join(chr(33 + rnd.randint(0, 40)) for _ in range(i % 7)), float(i % 5) if i % 9 else None, i % 2 if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "row_ix bigint, lane string, tile int, sread string, qual string, align_quality double, n_match int")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kept, aligned = F.col("align_quality") >= 2, F.col("n_match") == 1
    folders = []
    once = Q.assess_once(df.mapInArrow(count, df.schema), "lane", kept, aligned, sample=None, folders=folders, left="ACG", least=1)
    want = Q.assess(df, "lane", kept, aligned, sample=None, left="ACG", least=1)
    assert set(once) == set(want)
    for name in want:
        assert sorted(once[name].columns) == sorted(want[name].columns), name
        cols = sorted(want[name].columns)
        plain = lambda t: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in t.select(*cols).collect())  # noqa: B023, E731
        assert plain(once[name]) == plain(want[name]), name
    assert seen.value == 400 and len(folders) == 1
