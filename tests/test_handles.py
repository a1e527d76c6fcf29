"""Small tables about tables: handles of several files, lanes, views, columns and displays."""

import pytest

from strandmill import schema
from strandmill.errors import ArgumentMismatch, IncompatibleTypes, ValidityError, ValueUnavailable
from strandmill.operators import tables as X
from strandmill.operators.filters import width_filter
from strandmill.operators.viewer import RangeView
from strandmill.sources import catalog
from strandmill.streaming import fastq as S


def fastq(path, n, w=4):
    path.write_text("".join(f"@r{i}\n{'A' * w}\n+\n{'I' * w}\n" for i in range(n)))
    return str(path)


def test_handles(spark, tmp_path):
    paths = [fastq(tmp_path / "a", 25), fastq(tmp_path / "b", 7)]
    batches = S.Handles(spark, paths, S.RecordBatches, 10)
    counts = [{p: d and d.count() for p, d in batches.take().items()} for _ in range(3)]
    assert [list(c.values()) for c in counts] == [[10, 7], [10, None], [5, None]]
    assert batches.status()[paths[0]]["current"] == 3 and batches[0].progress() == {"added": 25, "records": 25, "buffer": 0}
    samples = S.Handles(spark, paths, S.Sampler, 5)
    assert [d.count() for d in samples.take().values()] == [5, 5] and samples.status()[paths[1]]["total"] == 7


def test_lanes(spark, tmp_path):
    folder = tmp_path / "Data" / "C1-36" / "Bustard1" / "GERALD1"
    folder.mkdir(parents=True)
    for lane, n in ((1, 3), (2, 4), (5, 1)):
        fastq(folder / f"s_{lane}_sequence.txt", n)
    lanes = catalog.LaneSet(catalog.InstrumentPath(str(tmp_path)), [{"lane": f"L{k}", "sample": f"x{k}"} for k in range(1, 9)])
    got = lanes.read_fastq(spark).groupBy("lane", "sample").count().collect()
    assert sorted(map(tuple, got)) == [("L1", "x1", 3), ("L2", "x2", 4), ("L5", "x5", 1)]
    assert {r.lane for r in lanes.read_fastq(spark, [2, 5]).collect()} == {"L2", "L5"}
    with pytest.raises(ArgumentMismatch):
        lanes.read_fastq(spark, [9])


def test_views(spark):
    df = spark.createDataFrame([(1, "c", "+", 100 + k, "A" * 30) for k in range(50)], "row_ix bigint, chromosome string, strand string, position int, sread string")
    track = spark.createDataFrame([("g", "c", 10, 120), ("h", "c", 900, 990), ("i", "d", 100, 200)], "name string, chromosome string, start int, end int")
    view = RangeView({"f": df}, "c", 80, 279, track=track)
    assert [tuple(r) for r in view.features().collect()] == [("g", "c", 80, 120)]
    moved = view.zoom(2).pan(0.5).toggle_strand()
    assert (moved.start, moved.end, moved.ignore_strand) == (180, 279, True) and moved.track is track
    assert moved.restore() is view and moved.back().ignore_strand is False and view.restore() is view and view.back() is view
    assert view.switch("fine_coverage").function.name == "fine_coverage" and view.switch("fine_coverage").switch(None).chosen is None
    for bad in ("coarse_coverage", "none"):
        with pytest.raises(ArgumentMismatch):
            view.switch(bad)
    assert sum(r.depth for r in view.data().collect()) == 1500


def test_columns(spark):
    reads, encoding = schema.reads_of(spark, ["acgt", "AC"], ["hhhh", "hh"], ["a", "b"])
    assert encoding == "phred64" and [(r.row_ix, r.id, r.sread) for r in reads.orderBy("row_ix").collect()] == [(1, "a", "ACGT"), (2, "b", "AC")]
    assert schema.reads_of(spark, ["A", "CC"], keep=width_filter(2))[0].count() == 1 and schema.reads_of(spark, ["A"])[1] is None
    assert schema.reads_of(spark, ["A"], ["h"], encoding="phred33")[1] == "phred33"
    with pytest.raises(IncompatibleTypes):
        schema.reads_of(spark, ["A"], [])
    with pytest.raises(ValidityError):
        schema.reads_of(spark, ["A"], ["II"])
    assert schema.show(reads) == "reads with qualities: 2 rows; width: 2..4 cycles\ncolumns: " + " ".join(reads.columns)
    placed = spark.createDataFrame([(1, "c", "+", 1, "AC"), (2, "d", None, 2, "AC")], "row_ix bigint, chromosome string, strand string, position int, sread string")
    assert schema.show(placed).splitlines()[:3] == ["alignments: 2 rows; width: 2 cycles", "chromosomes: c d", "strands: + 1 none 1"]


def test_intensity_tables(spark):
    df = spark.createDataFrame([(1, 3, 4, [[1.0, 2.0, 3.0, 4.0]] * 2), (2, 3, 5, [[1.0, 2.0, 3.0, 4.0]] * 2)], "row_ix bigint, lane int, tile int, intensity array<array<double>>")
    assert X.intensity_shape(df) == (2, 4, 2) and X.read_info(df).columns == ["row_ix", "lane", "tile"]
    with pytest.raises(ValueUnavailable):
        X.measurement_error(df)
    assert X.measurement_error(df.withColumnRenamed("intensity", "error")).count() == 2
    with pytest.raises(ValidityError):
        X.intensity_shape(df.unionByName(spark.createDataFrame([(3, 1, 1, [])], df.schema)))
