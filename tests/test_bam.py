"""Alignment maps in many tasks, and ranges by their index."""

import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandmill.errors import InputError
from strandmill.sources import bam, ranges

SCHEMA = "row_ix bigint, id string, sread string, qual string, chromosome string, position int, strand string, align_quality double"
COLS = ["id", "sread", "qual", "chromosome", "position", "strand", "align_quality"]


def rows(n, seed=1, widest=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        w = rnd.randint(0, widest)
        placed = rnd.random() < 0.9
        out.append(("".join(rnd.choice("ACGTN") for _ in range(w)), "".join(chr(33 + rnd.randint(0, 60)) for _ in range(w)), rnd.choice(["a", "b"]) if placed else None, rnd.randint(1, 3_000_000) if placed else None, rnd.choice("+-") if placed else None, float(rnd.randint(0, 60)) if rnd.random() < 0.8 else None))
    out.sort(key=lambda r: (r[2] is None, r[2] or "", r[3] or 0))
    return [(i, f"r{i}", *r) for i, r in enumerate(out, 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two maps of 4,000 rows each, in many blocks."""
    to = str(tmp_path_factory.mktemp("bam") / "maps")
    given = rows(8000)
    df = spark.createDataFrame(given, SCHEMA).repartitionByRange(2, "row_ix").sortWithinPartitions("row_ix")
    bam.write_bam(df, to, ["a", "b"], text=3000)
    return to, given


@pytest.mark.parametrize("split", [1 << 26, 100_000, 5000, 700])
def test_splits_change_nothing(spark, folder, split):
    to, given = folder
    out = bam.read_bam(spark, to, split=split)
    if split == 5000:
        assert out.rdd.getNumPartitions() > 50
    got = sorted((r.row_ix, *(r[c] for c in COLS)) for r in out.collect())
    assert got == given


def test_ranges_by_index(spark, folder, tmp_path):
    to, given = folder
    for chromosome, a, b in (("a", 1, 5000), ("b", 1_000_000, 1_020_000), ("b", 2_990_000, 1 << 29), ("a", 7, 7), ("none", 1, 100)):
        want = [r[1] for r in given if r[4] == chromosome and r[5] <= b and r[5] + len(r[2]) - 1 >= a]
        for index in (True, False):
            out = bam.read_bam(spark, to, chromosome, a, b, index=index)
            assert [r.id for r in out.orderBy("row_ix").collect()] == want
    # Blocks that the index does not name are not read: the file is useless but for them.
    name = sorted(f for f in os.listdir(to) if f.endswith(".bam"))[0]
    path, data = os.path.join(to, name), bytearray(open(os.path.join(to, name), "rb").read())
    with open(path, "rb") as f:
        at = [c for c, _ in ranges.blocks(f, 0, len(data))]
    chunks = bam.index_chunks(open(path + ".bai", "rb").read(), 0, 1, 100_000)
    assert chunks and chunks[-1][1] >> 16 < len(data) // 4
    spoilt = str(tmp_path / "spoilt.bam")
    first = next(c for c in at if c > chunks[-1][1] >> 16)
    data[first + 200 :] = bytes(len(data) - first - 200)
    open(spoilt, "wb").write(data)
    os.link(path + ".bai", spoilt + ".bai")
    mine = {r[1] for r in given if r[4] == "a" and r[5] <= 100_000}
    assert {r.id for r in bam.read_bam(spark, spoilt, "a", 1, 100_000).collect()} == mine
    with pytest.raises(Exception, match="no block begins|is damaged"):
        bam.read_bam(spark, spoilt).collect()


def test_records_longer_than_splits(spark, tmp_path):
    rnd = random.Random(4)
    given = [(i, f"r{i}", "A" * n, "I" * n, "a", i, "+", 1.0) for i, n in enumerate([10, 200_000, 5, 70_000, 0, 300_000, 1, 1], 1)]
    # Qualities that look like records: a name of one letter and nothing else, again and again.
    fake = struct.pack("<iiiBBHHHiiii", 34, 0, 5, 2, 0, 0, 0, 0, 0, -1, -1, 0) + b"x\0"
    tricky = [(9 + i, f"t{i}", "C" * 300, "".join(chr(33 + min(b, 93)) for b in (fake * 9)[:300]), "a", 50, "-", 2.0) for i in range(50)]
    noise = [(60 + i, f"n{i}", "G" * w, "".join(chr(33 + rnd.randint(0, 93)) for _ in range(w)), "a", 60, "-", None) for i, w in enumerate([90_000] * 3 + [40] * 20)]
    to = str(tmp_path / "long")
    given = [(k, *r[1:]) for k, r in enumerate(given + tricky + noise, 1)]
    bam.write_bam(spark.createDataFrame(given, SCHEMA).coalesce(1), to, ["a"], text=2000)
    for split in (1 << 26, 40_000, 900):
        got = sorted((r.row_ix, *(r[c] for c in COLS)) for r in bam.read_bam(spark, to, split=split).collect())
        assert got == given, split


def test_rows_are_encoded_at_once():
    """Batches give the bytes of the rows, also where letters are other than ASCII, which rows are encoded one by one."""
    rnd = random.Random(8)
    schema = pa.schema([("id", pa.string()), ("sread", pa.string()), ("qual", pa.string()), ("chromosome", pa.string()), ("position", pa.int32()), ("strand", pa.string()), ("align_quality", pa.float64())])
    for letters, plain in (("ACGTN=acx-", True), ("ACGTé", False)):
        given = []
        for w in [0, 1, 2, 31, 300] * 20:
            given.append((f"r{w}", "".join(rnd.choice(letters) for _ in range(w)), "".join(chr(33 + rnd.randint(0, 93)) for _ in range(w)), rnd.choice([None, "a", "b"]), rnd.choice([None, 0, 1, 16_384, 16_385, 1 << 20, (1 << 29) - 5]), rnd.choice([None, "+", "-"]), rnd.choice([None, 0.0, 3.9, 255.0])))
        batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in given], schema=schema).slice(3)
        data, at = bam.encoded_rows({"a": 0, "b": 1}, batch)
        assert (bam._encoded_at_once({"a": 0, "b": 1}, batch) is not None) == plain
        assert [data[a:b] for a, b in zip(at, at[1:])] == [bam.encoded({"a": 0, "b": 1}, *r) for r in given[3:]]
    assert bam.encoded_rows({}, batch.slice(0, 0))[0] == b""
    with pytest.raises(KeyError):
        bam.encoded_rows({"b": 0}, batch)


def test_small_ranges_share_tasks(spark, tmp_path):
    """Ranges of a few bytes are no more tasks than a bounded number, and give the same rows."""
    to = str(tmp_path / "many")
    given = [(i, f"r{i}", "ACGTN" * 8, "I" * 40, "a", i, "+", 1.0) for i in range(1, 1501)]
    bam.write_bam(spark.createDataFrame(given, SCHEMA).coalesce(1), to, ["a"], text=300)
    found = bam.read_bam(spark, to, split=100)
    assert found.rdd.getNumPartitions() <= 256
    assert sorted((r.row_ix, *(r[c] for c in COLS)) for r in found.collect()) == given
    # Ranges stay as they are where there are few, and a task has no more than it has by default.
    assert bam.joined(20_000, 256 * 20_000) == 20_000 and bam.joined(20_000, 257 * 20_000) == 40_000
    assert bam.joined(20_000, 1 << 50) <= ranges.SPLIT and bam.joined(1 << 30, 1 << 50) == 1 << 30


def test_false_beginnings_are_walked_again(spark, tmp_path, monkeypatch):
    """Qualities hold whole chains of well-formed records; the places where ranges end tell that they are none."""
    one = struct.pack("<iiiBBHHHiiii", 34, 0, 5, 2, 0, 0, 0, 0, 0, -1, -1, 0) + b"x\0"
    raw = one * 1700

    def record(name, qual):
        body = struct.pack("<iiBBHHHiiii", 0, 9, len(name) + 1, 30, 0, 0, 0, len(qual), -1, -1, 0) + name + b"\0" + bytes((len(qual) + 1) // 2) + qual
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<ii", 0, 1) + struct.pack("<i", 2) + b"a\0" + struct.pack("<i", 1000)
    text = b"".join(record(b"r%d" % i, raw) for i in range(6))
    path = tmp_path / "false.bam"
    path.write_bytes(b"".join(map(bam.block, [head, *(text[k : k + 20_000] for k in range(0, len(text), 20_000)), b""])))
    got = bam.read_bam(spark, str(path), split=400).orderBy("row_ix").collect()
    assert [(r.row_ix, r.id, len(r.sread)) for r in got] == [(k + 1, f"r{k}", len(raw)) for k in range(6)]


def test_blocks():
    data = bytes(random.Random(2).randrange(256) for _ in range(200_000))
    whole = b"".join(bam.block(data[k : k + 65_000]) for k in range(0, len(data), 65_000)) + bam.block(b"")
    assert b"".join(zlib.decompress(whole[a : a + ranges.block_size(whole[a : a + 64])], 31) for a in [0]) == data[:65_000]
    assert ranges.block_size(b"\x1f\x8b\x08\0" + bytes(30)) == 0 and ranges.block_size(b"") == 0


def test_broken_maps(spark, tmp_path):
    for name, data in (("none", b""), ("text", b"hello"), ("gz", bam.block(b"hello"))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="no binary alignment map"):
            bam.read_bam(spark, str(tmp_path / name)).collect()
    head = b"BAM\1" + struct.pack("<ii", 0, 0)
    (tmp_path / "empty").write_bytes(bam.block(head) + bam.block(b""))
    assert bam.read_bam(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "cut").write_bytes(bam.block(head) + bam.block(struct.pack("<i", 100) + bytes(50)))
    with pytest.raises(Exception, match="within a record"):
        bam.read_bam(spark, str(tmp_path / "cut")).collect()
    assert InputError and np
