"""Plots hold the values that they are drawn from, as SVG and as PDF."""

import re

import pytest

from strandmill.errors import ArgumentMismatch
from strandmill.plans import report as R


def test_ribbons(spark):
    rows = [("a", c, s, n) for c in (1, 2, 3) for s, n in ((10, 1), (20, 1), (30, 1 + c), (40, 1))] + [("b", 1, 5, 2)]
    sheet = R.ribbons_drawn(spark.createDataFrame(rows, "lane string, cycle int, score int, n bigint"), "lane")
    kinds = [(k, note) for k, _, _, note in sheet.shapes if k in ("area", "line")]
    assert kinds == [("area", "a: quartiles"), ("line", "a: median"), ("area", "b: quartiles"), ("line", "b: median")]
    low, high = 5, 30
    back = lambda y: low + (sheet.height - 30 - y) / (sheet.height - 50) * (high - low)
    median = next(points for k, points, _, note in sheet.shapes if note == "a: median")
    assert [round(back(y), 6) for _, y in median] == [30, 30, 30]
    area = next(points for k, points, _, note in sheet.shapes if note == "a: quartiles")
    assert [round(back(y), 6) for _, y in area[:3]] == [20, 22.5, 25] and [round(back(y), 6) for _, y in area[3:]] == [30, 30, 30]


def test_maps_of_tiles(spark):
    rows = [("a", t, t * 10) for t in range(1, 101)] + [("b", t, 5) for t in range(1, 101, 2)]
    sheet = R.tiles_drawn(spark.createDataFrame(rows, "lane string, tile int, n_read bigint"), "lane", "n_read")
    cells = {note: (points[0], colour) for kind, points, colour, note in sheet.shapes if kind == "rect" and note}
    assert len(cells) == 150
    # The second column runs up: tile 51 lies at its foot, beside tile 50.
    foot, last = cells["a, tile 51: 510"][0], cells["a, tile 50: 500"][0]
    assert foot[0] > last[0] and abs(foot[1] - last[1]) < 1e-9
    assert cells["a, tile 100: 1000"][1] == R.SCALE[-1] and cells["b, tile 1: 5"][1] == R.SCALE[0]
    colours = [R.SCALE.index(cells[f"a, tile {t}: {t * 10}"][1]) for t in range(1, 101)]
    assert colours == sorted(colours) and set(colours) >= {2, 3, 4}
    assert R.tiles_drawn(spark.createDataFrame([], "lane string, tile int, n_read bigint"), "lane", "n_read") is None


def test_pdf_is_well_formed(spark, tmp_path):
    tables = {
        "read_counts": spark.createDataFrame([("a (1)", 5)], "lane string, read bigint"),
        "cycle_quality": spark.createDataFrame([("a", c, chr(33 + s), s, 3) for c in range(1, 9) for s in (10, 20, 30)], "lane string, cycle int, quality string, score int, n bigint"),
        "tiles": spark.createDataFrame([("a", t, t, float(t)) for t in range(1, 101)], "lane string, tile int, n_read bigint, median_read double"),
        "own": spark.createDataFrame([(k,) for k in range(40)], "x int"),
    }
    path = R.write_report(tables, str(tmp_path / "pdf"), "Run \\ one", "pdf")
    data = open(path, "rb").read()
    assert data.startswith(b"%PDF-1.4") and data.endswith(b"%%EOF\n")
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data[start:])]
    assert data[start:].startswith(b"xref") and all(data[p:].startswith(b"%d 0 obj" % k) for k, p in enumerate(places, 1))
    for size, body in re.findall(rb"/Length (\d+) >>\nstream\n(.*?)\nendstream", data, re.S):
        assert len(body) == int(size)
    assert b"(Run \\\\ one)" in data and b"a \\(1\\)" in data and data.count(b"/Type /Page ") >= 3
    # The line of mean scores: eight points at one height, between the frame's edges.
    assert len(re.findall(rb"RG [\d.]+ [\d.]+ m(?: [\d.]+ [\d.]+ l){7} S", data)) >= 2
    page = open(R.write_report(tables, str(tmp_path / "html"), more=True), encoding="utf-8").read()
    assert page.count("<rect") > 200 and page.count("<polygon") == 1 and "a, tile 7: 7" in page
    assert spark.read.parquet(f"file://{tmp_path}/html/tables/tiles").count() == 100
    with pytest.raises(ArgumentMismatch):
        R.write_report(tables, str(tmp_path / "x"), kind="doc")
