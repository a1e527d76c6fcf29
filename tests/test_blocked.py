"""Block-gzipped FASTQ in many tasks."""

import gzip
import random

import pytest

from strandmill.errors import InputError, typed_errors
from strandmill.sources.bam import block
from strandmill.sources.blocked import read_fastq_blocked
from strandmill.sources.fastq import read_fastq


def blocked(path, text, size=700, tail=b""):
    raw = text.encode()
    path.write_bytes(b"".join(block(raw[k : k + size]) for k in range(0, len(raw), size)) + block(b"") + tail)
    return str(path)


def records(n, seed):
    """Titles full of marks, and qualities that look like titles."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        w = rnd.choice([0, 1, 5, 40, 300])
        out.append((f"r{i}{'@' * rnd.randint(0, 30)} @+{i}", "".join(rnd.choice("acGTN.") for _ in range(w)), "".join(rnd.choice("@+I") for _ in range(w))))
    return "".join(f"@{a}\n{s}\n+\n{q}\n" for a, s, q in out), [(a, s.upper().replace(".", "-"), q) for a, s, q in out]


@pytest.mark.parametrize("split", [1 << 26, 3000, 300, 60])
def test_splits_change_nothing(spark, tmp_path, split):
    (one, a), (two, b) = records(300, 1), records(40, 2)
    paths = [blocked(tmp_path / "x.gz", one), blocked(tmp_path / "w.gz", two, 90)]
    got = read_fastq_blocked(spark, paths, split=split)
    if split == 300:
        assert got.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, got.select("row_ix", "id", "sread", "qual").collect())) == [(k, *r) for k, r in enumerate(a + b, 1)]
    if split == 3000:
        same = read_fastq(spark, paths)
        cols = ["row_ix", "id", "sread", "qual"]
        assert sorted(map(tuple, same.select(*cols).collect())) == sorted(map(tuple, got.select(*cols).collect()))


def test_long_records_and_ends(spark, tmp_path):
    text = f"@a\n{'A' * 50_000}\n+\n{'@' * 50_000}\n@b\r\nAC\r\n+\r\nII\r\n@c\n{'C' * 90_000}\n+c\n{'+' * 90_000}"
    got = read_fastq_blocked(spark, blocked(tmp_path / "l.gz", text, 4000), split=100).orderBy("row_ix").collect()
    assert [(r.row_ix, r.id, len(r.sread), len(r.qual)) for r in got] == [(1, "a", 50_000, 50_000), (2, "b", 2, 2), (3, "c", 90_000, 90_000)]
    assert read_fastq_blocked(spark, blocked(tmp_path / "e.gz", "")).count() == 0
    for name, bad, message in (("cut", "@a\nAC\n+\n", "within a record"), ("wide", "@a\nAC\n+\nI\n", "differ in width"), ("no", "a\nAC\n+\nII\n", "does not begin with @")):
        with pytest.raises(InputError, match=message), typed_errors():
            read_fastq_blocked(spark, blocked(tmp_path / name, bad)).collect()
    (tmp_path / "z.gz").write_bytes(gzip.compress(b"@a\nA\n+\nI\n"))
    with pytest.raises(InputError, match="not made of blocks"), typed_errors():
        read_fastq_blocked(spark, str(tmp_path / "z.gz"))
