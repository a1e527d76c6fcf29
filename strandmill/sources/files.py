"""Which files to read, and their lines with the places that they had.

Paths are any that Spark reads; folders of other file systems than the local one are listed by Spark.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InputError


def is_local(path: str) -> bool:
    """Whether a path names the machine's own files, to Spark too."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return False
    spark = SparkSession.getActiveSession()
    default = spark and spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    return not default or default.startswith("file:")


def _listed(path: str) -> list[str]:
    """The file, or the files of the folder, that a path of any file system names; contents are not read."""
    spark = SparkSession.active()
    try:
        return sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())
    except AnalysisException:
        return []


def _is_file(path: str) -> bool:
    if is_local(path):
        return os.path.isfile(path)
    return [_within(x) for x in _listed(path)] == [_within(path)]


def file_names(path: str | list[str], pattern: str | None = None) -> list[str]:
    """Existing files as they are; else the files of folders whose names match a pattern, in order."""
    paths = [path] if isinstance(path, str) else list(path)
    if pattern is None and paths and all(map(_is_file, paths)):
        return paths
    found = []
    for p in paths:
        if is_local(p):
            inside = [os.path.join(p, f) for f in os.listdir(p)] if os.path.isdir(p) else []
            found += [f for f in inside if os.path.isfile(f)]
        elif not _is_file(p):
            found += _listed(p)
    found = sorted(f for f in found if re.search(pattern or "", f.rsplit("/", 1)[-1]))
    if not found:
        raise InputError(f"no input files found: {paths}, pattern {pattern!r}")
    return found


def located_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines (file, block, span, value) of text files, plain or compressed, in order within each block of a file; span is
    the block's length."""
    df = spark.read.text(paths)
    m = lambda c: F.col(f"_metadata.{c}")
    return df.select(m("file_path").alias("file"), m("file_block_start").alias("block"), m("file_block_length").alias("span"), "value")


def data_files(path: str | list[str], pattern: str | None = None) -> list[str]:
    """file_names() without those that begin with a dot or an underscore, which Spark's readers pass over too."""
    found = [f for f in file_names(path, pattern) if not f.rsplit("/", 1)[-1].startswith((".", "_"))]
    if not found:
        raise InputError(f"no input files found: {path}, pattern {pattern!r}")
    return found


def scratch_folder(spark: SparkSession) -> str:
    """A new name in the folder that driver and executors share; on one machine without one, in a temporary folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(shared or tempfile.mkdtemp()).rstrip('/')}/reads-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Delete scratch folders that nothing reads any more."""
    for name in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    folders.clear()


def _within(path: str) -> str:
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]+:(?://[^/]*)?", "", path)


def in_order(files: list[str], given: str | list[str]) -> list[str]:
    """Files as Spark names them, in the order of the paths that were given; those of a folder follow its place by name."""
    paths = [os.path.abspath(p) if is_local(p) else _within(p).rstrip("/") for p in ([given] if isinstance(given, str) else given)]
    known = {p: k for k, p in reversed(list(enumerate(paths)))}

    def place(file: str) -> tuple[int, str]:
        inside = at = unquote(_within(file))
        while at not in known and "/" in at:
            at = at.rsplit("/", 1)[0]
        return known.get(at, len(known)), inside

    return sorted(files, key=place)


class Places:
    """Lines before each block of the input, over all its files in their order, and in it: 32 bytes for each block.

    Blocks are those of one counting pass.  Where a later pass cuts files otherwise, because a setting or a file has
    changed, it meets a block that is unknown or has another number of lines; that is an error, never a wrong place.
    """

    def __init__(self, lines: DataFrame, given: str | list[str] = (), step: int = 1):
        """given: the paths, for the order of files.  step: each file counts as so many lines or a multiple of them."""
        counts = lines.groupBy("file", "block", "span").agg(F.count("*").alias("n")).toArrow().sort_by([("file", "ascending"), ("block", "ascending")])
        self.files: dict[str, tuple[np.ndarray, ...]] = {}
        if counts.num_rows:
            files = counts.column("file").combine_chunks().dictionary_encode()
            block, span, n = (counts.column(c).to_numpy() for c in ("block", "span", "n"))
            code = files.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for a, b in zip(cuts, cuts[1:]):
                self.files[files.dictionary[int(code[a])].as_py()] = (block[a:b], span[a:b], n[a:b], np.cumsum(n[a:b]) - n[a:b])
        #: Of each file, its number and the lines of those before it.
        self.order: dict[str, tuple[int, int]] = {}
        before = 0
        for k, file in enumerate(in_order(list(self.files), given)):
            self.order[file] = k, before
            before += -(-int(self.files[file][2].sum()) // step) * step

    def totals(self) -> dict[str, int]:
        return {f: int(n.sum()) for f, (_, _, n, _) in self.files.items()}

    def find(self, file: str, block: int, span: int) -> tuple[int, int]:
        """Lines before a block, those of earlier files included, and in it."""
        starts, spans, n, before = self.files.get(file, (np.empty(0, np.int64),) * 4)
        k = int(np.searchsorted(starts, block))
        if k == len(starts) or starts[k] != block or spans[k] != span:
            raise InputError(f"file '{file}', or how it is split, has changed since its lines were counted; read it again")
        return self.order[file][1] + int(before[k]), int(n[k])

    def walk(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, pa.RecordBatch]]:
        """(file, block, lines before, lines) in the order of the input; a block's lines may come in several parts."""
        key, at, end = None, 0, 0
        for part in _blocks(batches):
            now = tuple(part.column(c)[0].as_py() for c in ("file", "block", "span"))
            if now != key:
                self._ended(key, at, end)
                key = now
                at, n = self.find(*key)
                end = at + n
            yield key[0], key[1], at, part
            at += part.num_rows
        self._ended(key, at, end)

    @staticmethod
    def _ended(key: tuple | None, at: int, end: int) -> None:
        if at != end:
            raise InputError(f"file '{key[0]}' has changed since its lines were counted; read it again")


def numbered(lines: DataFrame, given: str | list[str] = ()) -> DataFrame:
    """Lines (file, file_no from 0, line_no from 1 in the file, place from 1 over all files in order, value), numbered
    without moving them."""
    places = lines.sparkSession.sparkContext.broadcast(Places(lines, given))
    names = ["file", "file_no", "line_no", "place", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, _, at, part in places.value.walk(batches):
            number, before = places.value.order[file]
            place = np.arange(at + 1, at + part.num_rows + 1)
            yield pa.RecordBatch.from_arrays([part.column("file"), pa.array(np.full(len(place), number), pa.int32()), pa.array(place - before, pa.int64()), pa.array(place, pa.int64()), part.column("value")], names)

    return lines.mapInArrow(run, "file string, file_no int, line_no bigint, place bigint, value string")


def renumbered(df: DataFrame, *parts: str) -> DataFrame:
    """Rows whose row_ix counts from 1 in each part (a file, a tile), numbered on from part to part in their order.  The
    table of parts is small, and is broadcast."""
    counts = df.groupBy(*parts).agg(F.max("row_ix").alias("_n"))
    before = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return df.join(F.broadcast(counts), list(parts)).withColumn("row_ix", F.col("row_ix") + F.col("_before")).select(*df.columns)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where another block of a file begins."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, file = batch.column("block"), batch.column("file")
        change = pc.or_(pc.not_equal(block[1:], block[:-1]), pc.not_equal(file[1:], file[:-1])) if batch.num_rows > 1 else pa.array([], pa.bool_())
        cuts = [0, *(np.flatnonzero(change.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def count_lines(spark: SparkSession, path: str | list[str], pattern: str | None = None, full_name: bool = False) -> DataFrame:
    """Line ends of each file, named by its base name or in full.

    A last line without an end does not count; it shows where lines and their ends are more bytes than the file, so in
    compressed files it counts.
    """
    lines = spark.read.text(file_names(path, pattern))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), (F.octet_length("value") + 1).alias("bytes"))
    counts = lines.groupBy("file", "size").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    plain = ~F.lower("file").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$")
    name = F.col("file") if full_name else F.element_at(F.split("file", "/"), -1)
    return counts.select(name.alias("file"), (F.col("n") - (plain & (F.col("bytes") > F.col("size"))).cast("int")).alias("lines"))
