"""Reports: the tables of an assessment and plots of them, as a page or as a PDF file.

Plots are drawn from small tables (a number for each cycle, tile, score or bin), as a list of shapes that is written as SVG
or as PDF: lines, ribbons between quartiles, and maps of tiles in the classes of quantiles.
"""

from __future__ import annotations

import html
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InputError, one_of
from ..operators.summaries import occurrence_curve, tile_geometry
from ..sources.files import discard, scratch_folder

PAGE = Template("<!DOCTYPE html><html><head><meta charset='utf-8'><title>$title</title><style>body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}</style></head><body><h1>$title</h1>$body</body></html>\n")
#: Sections in their order: table and heading.
SECTIONS = [
    ("read_counts", "Read counts"), ("base_calls", "Base calls"), ("read_quality", "Read quality"), ("base_quality", "Base quality"), ("frequent_sequences", "Frequent sequences"),
    ("sequence_distribution", "Occurrences of sequences"), ("cycle_base_calls", "Base calls by cycle"), ("cycle_quality", "Quality by cycle"), ("tiles", "Tiles"), ("align_quality", "Alignment quality"),
    ("multiple_alignment", "Multiple alignments"), ("depth", "Depth of coverage"), ("adapter_contamination", "Adapter contamination"),
]


def _by_cycle(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by, "cycle").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean"))


def _curve(df: DataFrame, by: str) -> DataFrame:
    """Share of the reads that occur at most so often."""
    kinds = [c for c in (by, "type") if c in df.columns]
    curve = occurrence_curve(df, tuple(kinds))
    return curve.withColumn(by, F.concat_ws(" ", *kinds))


def _scored(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("score", F.ascii("quality"))


#: Plots of a table: x, y, what the lines are for (by default the sources), and how the points come from the table.
PLOTS: dict[str, list[tuple[str, str, str | None, Callable[[DataFrame, str], DataFrame] | None]]] = {
    "read_quality": [("quality", "density", None, None)],
    "base_quality": [("score", "n", None, _scored)],
    "sequence_distribution": [("n_occurrences", "share", None, _curve)],
    "cycle_base_calls": [("cycle", "n", "base", None)],
    "cycle_quality": [("cycle", "mean", None, _by_cycle), ("cycle", "quartiles", "ribbon", None)],
    "tiles": [("tile", "n_read", None, None), ("tile", "median_read", None, None), ("tile", "n_read", "map", None), ("tile", "median_read", "map", None)],
    "align_quality": [("align_quality", "n", None, None)],
    "multiple_alignment": [("n_match", "n", None, None)],
    "depth": [("coverage", "count", None, None), ("coverage", "cumulative", None, None)],
}
#: Rows of a table on the page; the table's file has all.
SHOWN = 50
COLOURS = ["#1b6ca8", "#c1440e", "#4c8c4a", "#7b4f9d", "#b8860b", "#555555"]


def table_html(df: DataFrame, most: int = SHOWN) -> str:
    rows = df.limit(most + 1).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else f'{v:.4g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in rows[:most])
    return f"<table><tr>{head}</tr>{body}</table>" + ("<p>Further rows are not shown.</p>" if len(rows) > most else "")


@dataclass
class Drawing:
    """Shapes on a sheet; y runs down.  Each is a kind (line, area, rect, text) with its points, colour and note."""

    width: int = 640
    height: int = 320
    shapes: list[tuple[str, list[tuple[float, float]], str, str]] = field(default_factory=list)

    def add(self, kind: str, points: list[tuple[float, float]], colour: str = "#999999", note: str = "") -> None:
        self.shapes.append((kind, points, colour, note))

    def svg(self) -> str:
        out = []
        for kind, points, colour, note in self.shapes:
            at, title = " ".join(f"{x:.1f},{y:.1f}" for x, y in points), f"<title>{html.escape(note)}</title>"
            if kind == "line":
                out.append(f"<polyline fill='none' stroke='{colour}' points='{at}'>{title}</polyline>")
            elif kind == "area":
                out.append(f"<polygon fill='{colour}' fill-opacity='0.3' points='{at}'>{title}</polygon>")
            elif kind == "text":
                out.append(f"<text x='{points[0][0]:.1f}' y='{points[0][1]:.1f}'>{html.escape(note)}</text>")
            else:
                (x0, y0), (x1, y1) = points
                fill = f"fill='{colour}'" if kind == "rect" else f"fill='none' stroke='{colour}'"
                out.append(f"<rect x='{x0:.1f}' y='{y0:.1f}' width='{x1 - x0:.1f}' height='{y1 - y0:.1f}' {fill}>{title}</rect>")
        return f"<svg width='{self.width}' height='{self.height}' font-size='11'>{''.join(out)}</svg>"

    def pdf(self, left: float, top: float, scale: float = 0.8) -> str:
        """Operators that draw it with its upper left corner at a place of a page."""
        at = lambda p: f"{left + p[0] * scale:.2f} {top - p[1] * scale:.2f}"
        out = []
        for kind, points, colour, note in self.shapes:
            rgb = " ".join(f"{int(colour[k : k + 2], 16) / 255:.3f}" for k in (1, 3, 5))
            if kind == "text":
                out.append(f"BT 0 0 0 rg /F1 8 Tf {at(points[0])} Td ({_pdf_text(note)}) Tj ET")
                continue
            if kind in ("rect", "frame"):
                (x0, y0), (x1, y1) = points
                points = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
            path = f"{at(points[0])} m " + " ".join(f"{at(p)} l" for p in points[1:])
            if kind in ("line", "frame"):
                out.append(f"{rgb} RG {path} S")
            else:
                pale = " ".join(f"{1 - 0.3 * (1 - float(c)):.3f}" for c in rgb.split()) if kind == "area" else rgb
                out.append(f"{pale} rg {path} f")
        return "\n".join(out)


def _pdf_text(text: str) -> str:
    return "".join(c if 32 <= ord(c) < 127 else "?" for c in text).replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")


def pdf_file(pages: list[str], width: int = 595, height: int = 842) -> bytes:
    """A PDF file of pages of operators, with one font."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{4 + 2 * k} 0 R' for k in range(len(pages)))}] >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for k, page in enumerate(pages):
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width} {height}] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>")
        objects.append(f"<< /Length {len(page.encode('latin-1'))} >>\nstream\n{page}\nendstream")
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n{body}\nendobj\n".encode("latin-1")
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode("latin-1")


def _framed(points: list[tuple[float, float]], width: int, height: int) -> tuple[Drawing, Callable[[tuple[float, float]], tuple[float, float]]]:
    """A sheet with axes for points, and where each point lies on it."""
    (x0, x1), (y0, y1) = ((min(p[k] for p in points), max(p[k] for p in points)) for k in (0, 1))
    sheet = Drawing(width, height)
    sheet.add("frame", [(40, 20), (width - 20, height - 30)])
    for x, y, text in ((40, height - 8, f"{x0:.4g}"), (width - 60, height - 8, f"{x1:.4g}"), (2, height - 30, f"{y0:.3g}"), (2, 20, f"{y1:.3g}")):
        sheet.add("text", [(x, y)], note=text)
    return sheet, lambda p: (40 + (p[0] - x0) / ((x1 - x0) or 1) * (width - 60), height - 30 - (p[1] - y0) / ((y1 - y0) or 1) * (height - 50))


def lines_drawn(df: DataFrame, x: str, y: str, group: str, most: int = 20_000, width: int = 640, height: int = 320) -> Drawing | None:
    """Lines of a table, one for each group.  A table of more than `most` points is drawn by the mean in each pixel's column."""
    points = df.where(df[x].isNotNull() & df[y].isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(group).cast("string").alias("g"))
    n, low, high = points.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if n > most:
        column = F.round((F.col("x") - low) / ((high - low) or 1) * width)
        points = points.groupBy("g", column.alias("column")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    series: dict[str, list[tuple[float, float]]] = {}
    for r in points.select("x", "y", "g").collect():
        series.setdefault(str(r[2]), []).append((r[0], r[1]))
    if not series:
        return None
    sheet, at = _framed([p for s in series.values() for p in s], width, height)
    for i, (g, s) in enumerate(sorted(series.items())):
        sheet.add("line", [at(p) for p in sorted(s)], COLOURS[i % len(COLOURS)], g)
    return sheet


def lines_svg(df: DataFrame, x: str, y: str, group: str, most: int = 20_000, width: int = 640, height: int = 320) -> str:
    sheet = lines_drawn(df, x, y, group, most, width, height)
    return sheet.svg() if sheet else "<p>Not available.</p>"


def ribbons_drawn(df: DataFrame, by: str, width: int = 640, height: int = 320) -> Drawing | None:
    """Scores by cycle, of counts (by, cycle, score, n): a ribbon between the quartiles of each source and a line of medians."""
    at_ = df.groupBy(by, "cycle").agg(F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"))
    series: dict[str, list[tuple[int, float, float, float]]] = {}
    for r in at_.where("cycle is not null and q is not null").collect():
        series.setdefault(str(r[0]), []).append((r["cycle"], *r["q"]))
    if not series:
        return None
    sheet, at = _framed([(c, v) for s in series.values() for c, *q in s for v in q], width, height)
    for i, (g, s) in enumerate(sorted(series.items())):
        s.sort()
        colour = COLOURS[i % len(COLOURS)]
        sheet.add("area", [at((c, low)) for c, low, _, _ in s] + [at((c, high)) for c, _, _, high in reversed(s)], colour, f"{g}: quartiles")
        sheet.add("line", [at((c, mid)) for c, _, mid, _ in s], colour, f"{g}: median")
    return sheet


#: Colours of the classes of a map, low to high.
SCALE = ["#2c7bb6", "#abd9e9", "#ffffbf", "#fdae61", "#d7191c"]


def tiles_drawn(df: DataFrame, by: str, value: str, width: int = 640, height: int = 320) -> Drawing | None:
    """A map of tiles for each source: where they lie on the lane, in the classes of the quantiles of all tiles' values."""
    most = df.agg(F.max("tile")).first()[0]
    if not most:
        return None
    tiles = most if most in (68, 100, 120, 300) else next((k for k in (100, 120, 300) if most <= k), most)
    row, column = tile_geometry(F.col("tile"), tiles)
    cells = df.where(F.col(value).isNotNull()).select(F.col(by).cast("string").alias("g"), "tile", row.alias("row"), column.alias("column"), F.col(value).cast("double").alias("v"))
    breaks = cells.agg(F.percentile("v", F.array(*[F.lit(k / len(SCALE)) for k in range(1, len(SCALE))]))).first()[0]
    rows = cells.collect()
    if not rows:
        return None
    sheet, names = Drawing(width, height), sorted({r["g"] for r in rows})
    deep, across = max(r["row"] for r in rows), max(r["column"] for r in rows)
    room = (width - 20) / len(names)
    w, h = room * 0.8 / across, (height - 60) / deep
    for k, name in enumerate(names):
        sheet.add("text", [(10 + k * room, 14)], note=name)
        for r in rows:
            if r["g"] == name:
                x, y = 10 + k * room + (r["column"] - 1) * w, 20 + (r["row"] - 1) * h
                sheet.add("rect", [(x, y), (x + w, y + h)], SCALE[sum(r["v"] > b for b in breaks)], f"{name}, tile {r['tile']}: {r['v']:.6g}")
    for k, colour in enumerate(SCALE):
        sheet.add("rect", [(10 + 90 * k, height - 30), (24 + 90 * k, height - 18)], colour)
        sheet.add("text", [(28 + 90 * k, height - 20)], note=f"to {breaks[k]:.4g}" if k < len(breaks) else "above")
    return sheet


def plots_of(name: str, df: DataFrame, by: str, more: bool = True) -> list[tuple[str, Drawing | None]]:
    """Captions and plots of a table; ribbons and maps only with `more`."""
    out = []
    for x, y, group, points in PLOTS.get(name, []):
        if group in ("ribbon", "map") and not more:
            continue
        if group == "ribbon":
            out.append((f"Quartiles by {x}", ribbons_drawn(df, by)))
        elif group == "map":
            out.append((f"{y} on the lane", tiles_drawn(df, by, y)))
        else:
            out.append((f"{y} by {x}", lines_drawn(points(df, by) if points else df, x, y, group or by)))
    return out


def _as_pdf(sections: list[tuple[str, list[tuple[str, Drawing | None]], DataFrame]], title: str, most: int = SHOWN) -> bytes:
    pages, ops, y = [], [], 800.0

    def room(n: float) -> None:
        nonlocal ops, y
        if y - n < 40:
            pages.append("\n".join(ops))
            ops, y = [], 800.0

    def text(line: str, size: int) -> None:
        nonlocal y
        room(size + 4)
        ops.append(f"BT 0 0 0 rg /F1 {size} Tf 40 {y:.1f} Td ({_pdf_text(line)}) Tj ET")
        y -= size + 4

    text(title, 18)
    for heading, plots, df in sections:
        room(60)
        text(heading, 13)
        for caption, sheet in plots:
            room((sheet.height * 0.8 if sheet else 0) + 24)
            text(caption + ("" if sheet else ": not available"), 9)
            if sheet:
                ops.append(sheet.pdf(40, y))
                y -= sheet.height * 0.8 + 8
        text("  ".join(df.columns), 8)
        for r in df.limit(most).collect():
            text("  ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r)[:130], 8)
    return pdf_file([*pages, "\n".join(ops)])


def _kept(df: DataFrame, folder: str, scratch: list[str]) -> DataFrame:
    """A table that is computed once: written to the folder that all share, and copied into the report's."""
    spark, at = df.sparkSession, scratch_folder(df.sparkSession)
    df.write.parquet(at)
    scratch.append(at)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source, target = hadoop.Path(at), hadoop.Path(f"file://{os.path.abspath(folder)}")
    hadoop.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
    return spark.read.schema(df.schema).parquet(at)


def write_report(tables: dict[str, DataFrame], folder: str, title: str = "Quality assessment", kind: str = "html", tabular: bool = True, more: bool = False) -> str:
    """Write a page or a PDF file (and each table as Parquet) to a new local folder; gives the path of either.

    more: ribbons between quartiles and maps of tiles on the page too; a PDF file always has them.
    """
    one_of(kind, ("html", "pdf"), "kind")
    if os.path.exists(folder):
        raise InputError(f"'{folder}' exists")
    os.makedirs(folder)
    sections, scratch = [], []
    known = [s for s in SECTIONS if s[0] in tables] + [(n, n.replace("_", " ").capitalize()) for n in tables if n not in dict(SECTIONS)]
    for name, heading in known:
        df = _kept(tables[name], f"{folder}/tables/{name}", scratch) if tabular else tables[name]
        by = next((c for c in ("lane", "source", "file") if c in df.columns), None)
        sections.append((heading, plots_of(name, df, by, more or kind == "pdf") if by else [], df))
    path = os.path.join(folder, "index.html" if kind == "html" else "report.pdf")
    if kind == "pdf":
        with open(path, "wb") as out:
            out.write(_as_pdf(sections, title))
    else:
        drawn = lambda plots: "".join(f"<p>{html.escape(c)}</p>{d.svg() if d else '<p>Not available.</p>'}" for c, d in plots)
        body = "".join(f"<h2>{html.escape(h)}</h2>{drawn(plots)}{table_html(df)}" for h, plots, df in sections)
        with open(path, "w", encoding="utf-8") as out:
            out.write(PAGE.substitute(title=html.escape(title), body=body))
    if scratch:
        discard(tables[known[0][0]].sparkSession, scratch)
    return path
