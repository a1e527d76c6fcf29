"""Incremental reading, batches and samples."""

import pytest

from strandmill.errors import ArgumentMismatch, InputError
from strandmill.streaming import fastq as S


def test_records():
    data = b"@a x\nAC\nG\n+\nI@I\n@b\n.\n+b\nI\n@c\nA\n+\n"
    found, size = S.parse_records(data, 9)
    assert found == [("a x", "ACG", "I@I"), ("b", "-", "I")] and data[size:] == b"@c\nA\n+\n"
    assert S.parse_records(b"@e\n\n+\n\n@f\nA\n+\nI\n", 9)[0] == [("e", "", ""), ("f", "A", "I")]
    with pytest.raises(InputError):
        S.parse_records(b"xx\n", 1)
    with pytest.raises(InputError):
        S.parse_records(b"@a\nA\n+\nII\n", 1)


def test_stream(spark, tmp_path):
    path = tmp_path / "r.fastq"
    path.write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(120)))
    reader = S.FastqStreamReader(str(path), 50, 64)
    at, seen = reader.initialOffset(), []
    for _ in range(5):
        rows, at = reader.read(at)
        seen.append(len(list(rows)))
    assert seen == [50, 50, 20, 0, 0]
    assert len(list(reader.readBetweenOffsets({"byte": 0, "record": 0}, {"byte": 0, "record": 7}))) == 7
    query = S.read_stream(spark, str(path), 50).writeStream.format("memory").queryName("reads").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        assert spark.table("reads").count() == 120 and spark.table("reads").selectExpr("max(row_ix)").first()[0] == 120
    finally:
        query.stop()


def test_batches(spark):
    df = spark.range(1, 257).withColumnRenamed("id", "row_ix")
    b = S.RecordBatches(df, 50)
    assert [x.count() for x in b] == [50] * 5 + [6] and b.take() is None and b.status() == {"n": 50, "current": 6, "total": 6}
    assert [x.count() for x in S.RecordBatches(df, ranges=[(1, 10), (21, 50)])] == [10, 30]
    assert S.RecordBatches(df.where("false")).take() is None
    with pytest.raises(ArgumentMismatch):
        S.RecordBatches(df, 0)
    s = S.Sampler(df, 10, ordered=True)
    one, two = ([r.row_ix for r in s.draw().collect()] for _ in range(2))
    assert len(one) == 10 and one == sorted(one) and one != two
