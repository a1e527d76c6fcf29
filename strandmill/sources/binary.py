"""Binary maps, sequence lengths and intensities.  Alignment maps are in bam."""

from __future__ import annotations

import gzip
import io
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentMismatch, InputError, ValidityError
from .bam import BASES as BAM_BASES
from .bam import CIGAR as BAM_CIGAR
from .bam import read_bam
from .files import file_names, renumbered
from .ranges import SPLIT, open_at, seekable, size_of, tasks

__all__ = ["BAM_BASES", "BAM_CIGAR", "read_bam", "read_bfa_lengths", "read_cif", "read_ipar", "read_maq"]

#: Fixed values of the map format: its number, bytes for names, and read widths of the long and the short form.
MAP_FORMAT, MAP_NAME, MAP_WIDTHS = -1, 36, {False: 128, True: 64}


def _each(spark: SparkSession, files: list[str], parse: Callable[[str, io.BufferedIOBase], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Files as Spark's readers see them, plain or gzipped, through a parser that streams over their bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                raw = io.BytesIO(content)
                yield from parse(path, gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw)

    return spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(run, schema)


def _map_kind(short: bool) -> np.dtype:
    return np.dtype([("seq", "u1", (MAP_WIDTHS[short],)), ("size", "u1"), ("quality", "u1"), ("info1", "u1"), ("info2", "u1"), ("c", "u1", (2,)), ("flag", "u1"), ("other", "u1"), ("seqid", "<u4"), ("pos", "<u4"), ("dist", "<i4"), ("name", f"S{MAP_NAME}")])


def _map_head(path: str, data) -> tuple[list[str], int, int]:
    """Names of references, number of records, and bytes before the first."""
    number, n = struct.unpack("<ii", data.read(8))
    if number != MAP_FORMAT:
        raise InputError(f"'{path}' is no map file of this format")
    names, at = [], 16
    for _ in range(n):
        size = struct.unpack("<i", data.read(4))[0]
        names.append(data.read(size).rstrip(b"\0").decode())
        at += 4 + size
    return names, struct.unpack("<Q", data.read(8))[0], at


def _map_rows(path: str, data, names: list[str], row: int, left: int, short: bool) -> Iterator[pd.DataFrame]:
    """The next `left` records of an open map file, numbered on from `row`."""
    width, kind = MAP_WIDTHS[short], _map_kind(short)
    while left:
        some = min(left, 50_000)
        raw = data.read(some * kind.itemsize)
        if len(raw) < some * kind.itemsize:
            raise InputError(f"unexpected end of '{path}'")
        m = np.frombuffer(raw, dtype=kind)
        if (m["flag"] != 0).any() or (m["dist"] != 0).any():
            raise InputError("paired reads cannot be read")
        if (m["size"] > width).any():
            raise InputError("a read is wider than the format allows")
        base = np.where(m["seq"] == 0, ord("N"), np.frombuffer(b"ACGT", dtype=np.uint8)[m["seq"] >> 6])
        score = (m["seq"] & 63) + 33
        text = lambda x: [r[:s].astype(np.uint8).tobytes().decode() for r, s in zip(x, m["size"])]  # noqa: B023, E731
        yield pd.DataFrame({
            "file": path, "row_ix": np.arange(row + 1, row + some + 1), "id": [x.decode() for x in m["name"]], "sread": text(base), "qual": text(score), "chromosome": [names[i] for i in m["seqid"]],
            "position": (m["pos"] >> 1).astype(int) + 1, "strand": np.where(m["pos"] & 1, "-", "+"), "align_quality": m["quality"].astype(float), "n_mismatch_best": m["info1"] & 15,
            "mismatch_quality": m["info2"], "n_mismatch_best_24": m["info1"] >> 4, "n_exact_match_24": m["c"][:, 0], "n_one_mismatch_24": m["c"][:, 1],
        })
        left -= some
        row += some


def read_maq(spark: SparkSession, files: list[str], limit: int = -1, short: bool = False, split: int = SPLIT) -> DataFrame:
    """Alignments of one binary map file; paired reads are an error.

    Records have one size, so a plain file is cut into ranges of about `split` bytes, each a task that seeks to its own.  A
    gzipped file is read from its start by one task, which streams over it.
    """
    if len(files) != 1:
        raise InputError("one map file at a time can be read")
    own = ", ".join(f"{c} int" for c in ("n_mismatch_best", "mismatch_quality", "n_mismatch_best_24", "n_exact_match_24", "n_one_mismatch_24"))
    schema = f"file string, row_ix bigint, id string, sread string, qual string, chromosome string, position int, strand string, align_quality double, {own}"

    def parse(path: str, data) -> Iterator[pd.DataFrame]:
        names, n, _ = _map_head(path, data)
        yield from _map_rows(path, data, names, 0, n if limit < 0 else min(n, limit), short)

    path = files[0]
    if not seekable(path):
        return _each(spark, files, parse, schema)
    with open_at(path) as f:
        zipped = f.read(2) == b"\x1f\x8b"
        f.seek(0)
        names, n, at = ([], 0, 0) if zipped else _map_head(path, f)
        if not zipped and size_of(f) < at + n * _map_kind(short).itemsize:
            raise InputError(f"unexpected end of '{path}'")
    n = n if limit < 0 else min(n, limit)
    step, size = max(1, split // _map_kind(short).itemsize), _map_kind(short).itemsize
    rows = [(path, 0, -1)] if zipped else [(path, k, min(step, n - k)) for k in range(0, n, step)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, first, many in f.itertuples(index=False):
                with open_at(path, at + int(first) * size) as data:
                    if many < 0:
                        yield from parse(path, gzip.GzipFile(fileobj=data))
                    else:
                        yield from _map_rows(path, data, names, int(first), int(many), short)

    return tasks(spark, rows, "path string, first bigint, many bigint").mapInPandas(run, schema)


def read_bfa_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Names and lengths of the sequences in a binary FASTA file."""

    def parse(path: str, data) -> Iterator[pd.DataFrame]:
        names, sizes = [], []
        while head := data.read(4):
            n = struct.unpack("<i", head)[0]
            if n > 200:
                raise InputError("a sequence name is longer than 200 characters; is the file valid?")
            names.append(data.read(n).split(b"\0")[0].decode())
            size, words = struct.unpack("<ii", data.read(8))
            if size >> 5 not in (words, words - 1):
                raise InputError("lengths in the file do not agree")
            sizes.append(size)
            data.seek(16 * words, io.SEEK_CUR)
        yield pd.DataFrame({"name": names, "length": sizes})

    return _each(spark, file_names(path), parse, "name string, length int")


def _cif_head(path: str, data) -> tuple[int, int]:
    """Bytes of a value, and clusters, of one cycle of one tile."""
    head = data.read(13)
    if head[:3] != b"CIF":
        raise InputError(f"'{path}' is no intensity file")
    version, width, _, _, n = struct.unpack("<BBHHI", head[3:])
    if version != 1:
        raise InputError(f"'{path}' has version {version}; 1 can be read")
    return width, n


def _cif(path: str, first: int, many: int, clusters: int) -> np.ndarray:
    """Values (cluster, base) of some clusters of one cycle of one tile; the file has a plane for each base."""
    with open_at(path) as f:
        width, n = _cif_head(path, f)
        if n != clusters:
            raise InputError("cluster counts differ between cycles")
        planes = []
        for base in range(4):
            f.seek(13 + (base * n + first) * width)
            raw = f.read(many * width)
            if len(raw) != many * width:
                raise InputError(f"'{path}' ends before its {4 * n} values")
            planes.append(np.frombuffer(raw, dtype=f"<i{width}"))
    return np.stack(planes, axis=1)


def read_cif(spark: SparkSession, folder: str, lane: int, cycles: list[int], tiles: list[int], iteration: int = 1, with_errors: bool = True, clusters: int = 100_000) -> DataFrame:
    """Intensities (lane, tile, row_ix, x, y, intensity, error) of binary files, one for each cycle and tile.

    A task has some clusters of a tile over all cycles: it seeks to their values in each cycle's file, so rows are whole
    where they are read and nothing is shuffled to bring cycles together.
    """
    paths = {t: [f"{folder}/L{lane:03d}/C{c}.{iteration}/s_{lane}_{t}" for c in cycles] for t in tiles}
    kinds = {"intensity": ".cif", "error": ".cnf"} if with_errors else {"intensity": ".cif"}
    file_names([p + ext for ps in paths.values() for p in ps for ext in kinds.values()])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for tile in f["tile"]:
                path = paths[tile][0] + ".cif"
                with open_at(path) as data:
                    yield pd.DataFrame({"tile": [tile], "n": [_cif_head(path, data)[1]]})

    sizes = sorted((int(r.tile), r.n) for r in tasks(spark, [(t,) for t in tiles], "tile int").mapInPandas(count, "tile int, n bigint").collect()) if cycles else []
    ranges = [(t, k, min(clusters, n - k), n) for t, n in sizes for k in range(0, n, clusters)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for tile, first, many, n in f.itertuples(index=False):
                for k in range(int(first), int(first + many), 5000):
                    size = min(5000, int(first + many) - k)
                    values = {name: np.stack([_cif(p + ext, k, size, int(n)) for p in paths[tile]], axis=1).astype(float) for name, ext in kinds.items()}
                    yield pd.DataFrame({"tile": tile, "row_ix": np.arange(k + 1, k + size + 1), **{name: [[list(c) for c in row] for row in v.tolist()] for name, v in values.items()}})

    from .delimited import field, fields

    rows = tasks(spark, ranges, "tile int, first bigint, many bigint, n bigint").mapInPandas(run, "tile int, row_ix bigint, " + ", ".join(f"{name} array<array<double>>" for name in kinds))
    spots = fields(spark, file_names([f"{folder}/s_{lane}_{t:04d}_pos.txt" for t in tiles]), "")
    spots = spots.select(F.regexp_extract("file", r"s_\d+_(\d+)_pos", 1).cast("int").alias("tile"), F.col("line_no").alias("row_ix"), field(1, "double").alias("x"), field(2, "double").alias("y"))
    return renumbered(spots.join(rows, ["tile", "row_ix"]), "tile").withColumn("lane", F.lit(lane))


def read_ipar(spark: SparkSession, folder: str, pattern: str = "", intensity_ext: str = r"_int\.txt\.p(\.gz)?$", error_ext: str = r"_nse\.txt\.p(\.gz)?$", position_ext: str = r"_pos\.txt$", with_errors: bool = True) -> DataFrame:
    """Intensities whose files hold all reads of a cycle together, cycles being parted by comment lines."""

    def parse(path: str, data) -> Iterator[pd.DataFrame]:
        cycles: list[list[list[float]]] = []
        fresh = True
        for line in io.TextIOWrapper(data, encoding="latin-1"):
            if line.startswith("#"):
                fresh = True
            elif line.strip():
                if fresh:
                    cycles.append([])
                    fresh = False
                cycles[-1].append([float(x) for x in line.split()])
        if len({len(c) for c in cycles}) > 1:
            raise InputError(f"cycles of '{path}' differ in their reads")
        stem = re.search(r"(s_\d+_\d+)", path)
        if stem is None:
            raise ArgumentMismatch(f"'{path}' names no lane and tile")
        yield pd.DataFrame({"stem": stem[1], "row_ix": np.arange(1, len(cycles[0]) + 1 if cycles else 1), "v": [list(r) for r in zip(*cycles)]})

    def read(ext: str, name: str) -> DataFrame:
        return _each(spark, file_names(folder, pattern + ".*" + ext), parse, "stem string, row_ix bigint, v array<array<double>>").withColumnRenamed("v", name)

    from .delimited import field, fields

    spots = fields(spark, file_names(folder, pattern + ".*" + position_ext), "")
    stem = F.regexp_extract("file", r"(s_\d+_\d+)", 1)
    spots = spots.select(stem.alias("stem"), F.col("line_no").alias("row_ix"), field(1, "double").alias("x"), field(2, "double").alias("y"))
    out = read(intensity_ext, "intensity")
    if with_errors:
        out = out.join(read(error_ext, "error"), ["stem", "row_ix"], "full")
        if out.where("intensity is null or error is null or size(intensity) <> size(error)").limit(1).count():
            raise ValidityError("intensities and errors differ in their reads or cycles")
    out = renumbered(out.join(spots, ["stem", "row_ix"], "left"), "stem")
    return out.withColumns({"lane": F.regexp_extract("stem", r"s_(\d+)_", 1).cast("int"), "tile": F.regexp_extract("stem", r"s_\d+_(\d+)", 1).cast("int")}).drop("stem")
