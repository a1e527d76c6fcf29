"""Folders of growing files as a stream, and samples in one pass."""

import gzip
import json
import os
import random
from collections import Counter

import pytest

from strandmill.errors import ArgumentMismatch
from strandmill.streaming import fastq as S
from strandmill.streaming import splits as P


def record(k, w=None):
    """Titles, sequences and qualities that begin with the marks of others where they can."""
    w = k % 9 if w is None else w
    return f"@r{k}{'@+'[k % 2]}\n{'acgT.'[k % 5] * w}\n+{'@' * (k % 3)}\n{('@', '+', 'I')[k % 3] * w}\n"


def row(k, w=None):
    w = k % 9 if w is None else w
    return f"r{k}{'@+'[k % 2]}", ("ACGT-"[k % 5]) * w, ("@", "+", "I")[k % 3] * w


@pytest.mark.parametrize("split", [1, 7, 40, 1000, 1 << 20])
def test_ranges_give_each_record_once(tmp_path, split):
    path = tmp_path / "a.fastq"
    path.write_text("".join(map(record, range(200))) + "@half\nAC")
    reader = P.SplitReader(str(tmp_path), "fastq", 1 << 40, split)
    start = reader.initialOffset()
    end = reader.latestOffset()
    assert end == {str(path): path.stat().st_size - len("@half\nAC")}
    got = [tuple(r.values())[2:] for part in reader.partitions(start, end) for b in reader.read(part) for r in b.to_pylist()]
    assert got == [row(k) for k in range(200)]


def test_ends_of_records(tmp_path, monkeypatch):
    path = tmp_path / "a"
    text = "".join(map(record, range(1, 60)))
    ends = [0]
    for k in range(1, 60):
        ends.append(ends[-1] + len(record(k)))
    path.write_text(text)
    for look in (4, 64, 1 << 16):
        monkeypatch.setattr(P, "LOOK", look)
        for limit in range(0, len(text) + 1, 7):
            assert P.last_end(str(path), 0, limit) == max(e for e in ends if e <= limit)
            assert P.last_end(str(path), ends[10], max(limit, ends[10])) == max(e for e in ends if ends[10] <= e <= max(limit, ends[10]))


def run(spark, folder, out, **options):
    q = P.stream_folder(spark, str(folder), **options).writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "log")).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted((r.id, r.sread, r.qual) for r in spark.read.parquet(str(out / "rows")).collect())


def test_stream_restarts(spark, tmp_path):
    """Files grow and appear between runs from one checkpoint; each record comes once, and steps are bounded."""
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.fastq").write_text("".join(map(record, range(100))) + record(100)[:9])
    (folder / "b.fastq.gz").write_bytes(gzip.compress("".join(map(record, range(1000, 1050))).encode()))
    want = sorted(row(k) for k in [*range(100), *range(1000, 1050)])
    assert run(spark, folder, out, step=600, split=150, checkpoint=str(out / "log")) == want
    steps = [json.loads(open(out / "log" / "offsets" / n).read().splitlines()[-1]) for n in sorted(os.listdir(out / "log" / "offsets"), key=lambda n: int(n) if n.isdigit() else -1) if n.isdigit()]
    assert len(steps) > 3
    with open(folder / "a.fastq", "a") as f:
        f.write(record(100)[9:] + "".join(map(record, range(101, 140))))
    (folder / "c.fastq").write_text("".join(map(record, range(2000, 2020))))
    want = sorted(want + [row(k) for k in [*range(100, 140), *range(2000, 2020)]])
    assert run(spark, folder, out, step=600, split=150, checkpoint=str(out / "log")) == want
    assert run(spark, folder, out) == want


def test_stream_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fastq").write_text("@a\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="differ in width"):
        run(spark, tmp_path / "in", tmp_path / "out")
    with pytest.raises(ArgumentMismatch):
        P.FastqSplits({"path": "x", "split": "0"}).streamReader(None)
    with pytest.raises(ArgumentMismatch):
        P.FastqSplits({}).streamReader(None)


def test_long_records_in_small_ranges(tmp_path):
    path = tmp_path / "a"
    path.write_text(record(1, 50_000) + record(2, 3) + record(3, 120_000) + record(4, 1))
    reader = P.SplitReader(str(tmp_path), "a", 1000, 999, str(tmp_path))
    at, got = reader.initialOffset(), []
    for _ in range(9):
        end = reader.latestOffset()
        got += [tuple(r.values())[2:] for part in reader.partitions(at, end) for b in reader.read(part) for r in b.to_pylist()]
        at = end
    assert got == [row(1, 50_000), row(2, 3), row(3, 120_000), row(4, 1)]


def test_samples_in_one_pass(spark, tmp_path):
    df = spark.range(1, 3001, 1, 6).withColumnRenamed("id", "row_ix").selectExpr("row_ix", "concat('r', row_ix) AS id")
    s, taken = S.Sampler(df, 200), Counter()
    for k in range(1, 16):
        ids = [r.row_ix for r in s.draw().collect()]
        assert len(set(ids)) == 200
        taken.update((i - 1) // 500 for i in ids)
        assert s.status() == {"n": 200, "current": k, "added": 3000 * k, "total": 3000, "buffer": 200}
    # 3,000 draws over six parts: chi-square with five degrees of freedom below its 99.9th percentile.
    assert sum((taken[k] - 500) ** 2 / 500 for k in range(6)) < 20.5
    # The rows are those of the exact sample over the whole table.
    assert {r.row_ix for r in S.Sampler(df, 200).draw().collect()} == {r.row_ix for r in S.exact_sample(df, 200, seed=1).collect()}
    # A total that is too large is found out; fewer rows are all taken; none give none.
    for total in (10**9, 3000, 1):
        assert S.Sampler(df, 100, total=total).draw().count() == 100
    assert S.Sampler(df, 5000).draw().count() == 3000
    none = S.Sampler(df.where("false"), 5)
    assert none.draw().count() == 0 and none.status()["buffer"] == 0
    rows, added, written = S.bottom_rows(df, 100, 7, 3000)
    assert added == 3000 and 100 <= written < 300
    assert random
