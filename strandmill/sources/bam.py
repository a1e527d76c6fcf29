"""Binary alignment maps, many tasks a file.

A file is cut into byte ranges.  A task finds the first block of its range, and in its text the first record, as one from
which a chain of well-formed records runs on; it owns the records that begin in its range.  A first pass counts them and
notes where each range begins and ends: an end that is not the next one's beginning means that a record was taken for one
wrongly, and the next range is walked again from where the one before it ended.  So rows are numbered over all files
without moving text, and the second pass starts at known places.

With an index beside a file, a range of positions reads only the blocks that the index names.  Rows then are numbered by
their place in the file (compressed byte and byte within the block), which rises but leaves numbers out.
"""

from __future__ import annotations

import gzip
import io
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from .files import data_files
from .ranges import SPLIT, blocks, is_blocked, next_block, open_at, ragged, seekable, size_of, tasks

#: Letters of 4-bit bases and of CIGAR operations.
BASES, CIGAR = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_PAIRS = np.array([[ord(a), ord(b)] for a in BASES for b in BASES], dtype=np.uint8)
SCHEMA = "file string, row_ix bigint, id string, sread string, qual string, chromosome string, position int, strand string, align_quality double, cigar string, flag int"
#: Bytes of text that are parsed at once, and the most that one record may take to be believed where a range begins.
TEXT, RECORD = 4 << 20, 1 << 26
#: Tasks of a pass over files of small ranges.
TASKS = 256
#: Records of a chain that make a beginning certain enough for a first try.
CHAIN = 16
_HEAD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("quality", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("length", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("insert", "<i4")])


class Text:
    """The decompressed text of a file from a place (block << 16 | byte in it) on.  `at` is where the next record begins."""

    def __init__(self, f, size: int, place: int, blocked: bool):
        self.data, self.at, self.starts, self.size = b"", place & 0xFFFF, [], size
        self.more = blocks(f, place >> 16, size) if blocked else self._pieces(f, place >> 16)
        self.whole = False

    @staticmethod
    def _pieces(f, first: int) -> Iterator[tuple[int, bytes]]:
        """Ordinary gzip members or plain bytes: pieces of 64 KB stand for blocks."""
        f.seek(0)
        raw = gzip.GzipFile(fileobj=f) if f.read(2) == b"\x1f\x8b" else f
        f.seek(0)
        n = 0
        while piece := raw.read(1 << 16):
            if n >= first:
                yield n, piece
            n += 1

    def fill(self, least: int, last: int | None = None) -> None:
        """Hold so many bytes from `at` on, if there are, or those up to the block `last`; blocks that lie before it go."""
        keep = max((p for p, _ in self.starts if p <= self.at), default=0)
        parts, size = [self.data[keep:]], len(self.data) - keep
        self.at -= keep
        self.starts = [(p - keep, c) for p, c in self.starts if p >= keep]
        while size - self.at < least and not (last is not None and self.starts and self.starts[-1][1] >= last):
            step = next(self.more, None)
            if step is None:
                self.whole = True
                break
            if step[1]:
                self.starts.append((size, step[0]))
                parts.append(step[1])
                size += len(step[1])
        self.data = b"".join(parts)

    def place(self, at: np.ndarray) -> np.ndarray:
        """Places of bytes of the data that is held."""
        start, block = (np.array(x, dtype=np.int64) for x in zip(*self.starts))
        k = np.searchsorted(start, at, side="right") - 1
        return block[k] << 16 | at - start[k]

    def stop(self, end: int) -> int:
        """The byte of the data that a place is at, or one behind all that is held."""
        for p, c in self.starts:
            if c >= end >> 16:
                return p + (end & 0xFFFF if c == end >> 16 else 0)
        return len(self.data) + 1

    def next_place(self) -> int:
        """Where the next record begins; the file's size if it has ended."""
        self.fill(1)
        return int(self.place(np.array([self.at]))[0]) if self.at < len(self.data) else self.size << 16


def records(text: Text, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Steps (bytes, where records begin in them) of the records that begin before a place."""
    least, last = TEXT, end >> 16
    while True:
        text.fill(least, last)
        data, at, size, stop, found = text.data, text.at, len(text.data), text.stop(end), []
        while at < stop and at + 4 <= size:
            n = int.from_bytes(data[at : at + 4], "little", signed=True)
            if n < 32:
                raise InputError("a record of the alignment map is malformed")
            if at + 4 + n > size:
                break
            found.append(at)
            at += 4 + n
        if found:
            yield np.frombuffer(data, dtype=np.uint8), np.array(found, dtype=np.int64)
        # A record that runs on beyond what is held: more, also of what lies behind the end.
        text.at, least, last = (at, TEXT, end >> 16) if found else (at, 2 * least, None)
        if at >= stop:
            return
        if text.whole:
            if at < size:
                raise InputError("the alignment map ends within a record")
            return


def synchronise(text: Text, end: int, references: int) -> bool:
    """Move to the first record that begins before a place; whether there is one."""
    for least in (1 << 18, 1 << 22, RECORD):
        text.fill(least)
        size, limit = len(text.data), min(text.stop(end), len(text.data) - _HEAD.itemsize + 1)
        if limit <= 0:
            return False
        # One header for each byte: views that overlap.
        h = np.ndarray((size - _HEAD.itemsize + 1,), dtype=_HEAD, buffer=text.data, strides=(1,))
        need = 32 + h["name"].astype(np.int64) + 4 * h["ops"].astype(np.int64) + (h["length"].astype(np.int64) * 3 + 1) // 2
        good = (h["size"] >= need) & (h["size"] <= RECORD) & (h["name"] > 0) & (h["length"] >= 0)
        for ref, pos in (("ref", "pos"), ("mate", "mate_pos")):
            good &= (h[ref] >= -1) & (h[ref] < references) & (h[pos] >= -1)
        for first in np.flatnonzero(good[:limit]).tolist():
            at, n = first, 0
            while n < CHAIN and at < len(good) and good[at] and text.data[min(at + 35 + int(h["name"][at]), size - 1)] == 0:
                at, n = at + 4 + int(h["size"][at]), n + 1
            if n == CHAIN or at == size and text.whole or n and at >= len(good) and (n > 1 or least == RECORD or text.whole):
                text.at = first
                return True
        if text.whole:
            return False
    return False


def parsed(b: np.ndarray, at: np.ndarray, names: pa.Array, cache: dict[bytes, str]) -> tuple[pa.RecordBatch, np.ndarray]:
    """Columns of records without file and row_ix, and the bases of the reference that each spans."""
    h = b[at[:, None] + np.arange(_HEAD.itemsize)].view(_HEAD)[:, 0]
    name, ops, length = (h[c].astype(np.int64) for c in ("name", "ops", "length"))
    start = at + _HEAD.itemsize
    cigar = start + name
    packed = (length + 1) // 2
    seq = cigar + 4 * ops
    ends = np.cumsum(packed)
    nibbles = _PAIRS[b[np.repeat(seq - (ends - packed), packed) + np.arange(ends[-1] if len(ends) else 0)]].ravel()
    score = np.where(np.arange(256) < 94, np.arange(256) + 33, ord("!")).astype(np.uint8)
    raw = b.tobytes()
    texts = []
    for a, n in zip(cigar.tolist(), ops.tolist()):
        key = raw[a : a + 4 * n]
        if key not in cache:
            cache[key] = "".join(f"{x >> 4}{CIGAR[x & 15]}" for x in struct.unpack(f"<{n}I", key))
        texts.append(cache[key])
    if len(cache) > 100_000:
        cache.clear()
    upto = np.cumsum(ops)
    every = b[(np.repeat(cigar - 4 * (upto - ops), ops) + 4 * np.arange(upto[-1] if len(upto) else 0))[:, None] + np.arange(4)].view("<u4")[:, 0]
    sums = np.r_[0, np.cumsum(np.where(np.isin(every & 15, [CIGAR.index(x) for x in "MDN=X"]), every >> 4, 0))]
    mapped = (h["flag"] & 4 == 0) & (h["pos"] >= 0)
    columns = {
        "id": ragged(b, start, name - 1), "sread": ragged(nibbles, 2 * (ends - packed), length), "qual": ragged(score[b], seq + packed, length),
        "chromosome": names.take(pa.array(h["ref"], pa.int32(), mask=h["ref"] < 0)), "position": pa.array(h["pos"] + 1, pa.int32(), mask=~mapped),
        "strand": pa.array(["+", "-"]).take(pa.array(h["flag"] >> 4 & 1, pa.int32(), mask=~mapped)), "align_quality": pa.array(h["quality"].astype(float), mask=h["quality"] == 255),
        "cigar": pa.array(texts, pa.string()), "flag": pa.array(h["flag"].astype(np.int32)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns)), sums[upto] - sums[upto - ops]


def header(f, path: str) -> tuple[int, bool, list[str], int]:
    """Size, whether the file is made of blocks, names of the references, and the place of the first record."""
    size, blocked = size_of(f), is_blocked(f)
    text = Text(f, size, 0, blocked)

    def take(n: int) -> bytes:
        text.fill(n)
        got = text.data[text.at : text.at + n]
        text.at += n
        if len(got) < n:
            raise InputError(f"'{path}' is no binary alignment map")
        return got

    if take(4) != b"BAM\1":
        raise InputError(f"'{path}' is no binary alignment map")
    number = lambda: struct.unpack("<i", take(4))[0]
    take(number())
    names = []
    for _ in range(number()):
        names.append(take(number()).rstrip(b"\0").decode())
        take(4)
    return size, blocked, names, text.next_place()


def index_chunks(data: bytes, reference: int, start: int, end: int) -> list[tuple[int, int]]:
    """The stretches (places) of a file that can hold records of a reference that meet positions start to end, from 1."""
    if data[:4] != b"BAI\1":
        raise InputError("the index of an alignment map is malformed")
    low, high = start - 1, min(end, 1 << 29) - 1
    wanted = {0} | {k for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)) for k in range(first + (low >> shift), first + (high >> shift) + 1)}
    at, found, least = 8, [], 0
    for k in range(struct.unpack_from("<i", data, 4)[0]):
        bins = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(bins):
            number, n = struct.unpack_from("<Ii", data, at)
            if k == reference and number in wanted:
                found += np.frombuffer(data, dtype="<u8", count=2 * n, offset=at + 8).reshape(-1, 2).tolist()
            at += 8 + 16 * n
        n = struct.unpack_from("<i", data, at)[0]
        if k == reference and n:
            least = int(np.frombuffer(data, dtype="<u8", count=n, offset=at + 4)[min(low >> 14, n - 1)])
        at += 4 + 8 * n
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(a, least), b) for a, b in found if b > least):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def read_bam(spark: SparkSession, path: str | list[str], chromosome: str | None = None, start: int = 1, end: int = 1 << 29, split: int = SPLIT, index: bool = True) -> DataFrame:
    """Alignments of binary alignment maps, those that meet a range of positions if a chromosome is given.

    split: bytes of a range of a file, which is one task; neighbours share a task where there are more than TASKS.
    index: use the files `path.bai`, if each file has one.
    """
    files = data_files(path)
    own = [f for f in files if not f.endswith(".bai")]

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, file in zip(batch.column("k").to_pylist(), batch.column("file").to_pylist()):
                with open_at(file) as f:
                    size, blocked, names, place = header(f, file)
                chunks = None
                if chromosome is not None and index and blocked:
                    try:
                        with open_at(f"{file}.bai") as f:
                            chunks = index_chunks(f.read(), names.index(chromosome), start, end) if chromosome in names else []
                    except FileNotFoundError:
                        pass
                yield pa.RecordBatch.from_pylist([{"k": k, "size": size, "blocked": blocked, "names": names, "place": place, "chunks": chunks}], schema=kinds)

    kinds = pa.schema([("k", pa.int32()), ("size", pa.int64()), ("blocked", pa.bool_()), ("names", pa.list_(pa.string())), ("place", pa.int64()), ("chunks", pa.list_(pa.list_(pa.int64())))])
    if not all(map(seekable, own)):
        return _meets(_whole(spark, own), chromosome, start, end)
    heads = sorted(tasks(spark, list(enumerate(own)), "k int, file string").mapInArrow(head, "k int, size bigint, blocked boolean, names array<string>, place bigint, chunks array<array<bigint>>").collect())
    known = spark.sparkContext.broadcast({own[h.k]: (h.size, h.blocked, list(h.names)) for h in heads})
    before = np.cumsum([0, *(h.size for h in heads)])
    if chromosome is not None and heads and all(h.chunks is not None for h in heads):
        rows = [(own[h.k], a, b, int(before[h.k]) << 16, True) for h in heads for a, b in h.chunks]
    else:
        rows = numbered_ranges(spark, own, heads, known, split, synchronise, records)
    parse = _parser(known, chromosome, start, end)
    return tasks(spark, rows, "file string, place bigint, stop bigint, base bigint, by_place boolean").mapInArrow(parse, SCHEMA)


def joined(split: int, total: int) -> int:
    """Bytes of neighbouring ranges of `split` bytes that are one task, so that small ones do not make tasks without end.

    A task costs some tenths of a second whatever it reads.  At most TASKS of them, unless they had more than SPLIT bytes.
    """
    return split * max(1, min(-(-total // (split * TASKS)), SPLIT // split))


def numbered_ranges(spark: SparkSession, files: list[str], heads: list, known, split: int, find, steps) -> list[tuple]:
    """Ranges with records: file, place of the first, end, and the records before it over all files.

    find(text, end, names) moves to the first record of a range; steps(text, end) gives its records.  heads: k, size, whether
    the file is made of blocks, and the place of its first record.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size, blocked, names = known.value[row["file"]]
                first = last = n = 0
                with open_at(row["file"]) as f:
                    place = row["place"]
                    if place < 0:
                        block = next_block(f, row["begin"], size)
                        place = block << 16 if block < row["stop"] else -1
                    if place >= 0:
                        text, end = Text(f, size, place, blocked), row["stop"] << 16
                        if row["place"] >= 0 or find(text, end, len(names)):
                            first = text.next_place()
                            n = sum(len(at) for _, at in steps(text, end))
                            last = text.next_place()
                yield pa.RecordBatch.from_pylist([{"k": row["k"], "first": first, "last": last, "n": n}], schema=counted)

    counted = pa.schema([("k", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64())])
    cuts = []
    together = joined(split, sum(h.size for h in heads if h.blocked))
    for h in heads:
        # What is not made of blocks is one range.
        step = together if h.blocked else max(h.size, 1)
        stops = [*range(step, h.size, step), 1 << 46]
        cuts += [(len(cuts) + i, files[h.k], a, b, h.place if i == 0 else -1) for i, (a, b) in enumerate(zip([0, *stops], stops))]
    schema = "k int, file string, begin bigint, stop bigint, place bigint"
    look = lambda some: {r.k: r for r in tasks(spark, some, schema).mapInArrow(walk, "k int, first bigint, last bigint, n bigint").collect()}
    found, out, base, expect = look(cuts), [], 0, (None, 0)
    for k, file, begin, stop, place in cuts:
        r = found[k]
        here = place if file != expect[0] else expect[1]
        over = here >> 16 >= known.value[file][0] and known.value[file][1]
        if not over and here < stop << 16 and (r.n == 0 or r.first != here):
            r = look([(k, file, begin, stop, here)])[k]
        elif over or here >= stop << 16:
            expect = file, here
            continue
        if r.n:
            out.append((file, r.first, stop << 16, base, False))
        base += r.n
        expect = file, r.last if r.n else here
    return out


def _parser(known, chromosome: str | None, start: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size, blocked, names = known.value[row["file"]]
                with open_at(row["file"]) as f:
                    yield from _rows(Text(f, size, row["place"], blocked), row["stop"], row["file"], names, row["base"], row["by_place"], chromosome, start, end)

    return run


def _rows(text: Text, stop: int, file: str, names: list[str], base: int, by_place: bool, chromosome: str | None, start: int, end: int) -> Iterator[pa.RecordBatch]:
    cache: dict[bytes, str] = {}
    for b, at in records(text, stop):
        for k in range(0, len(at), 10_000):
            some = at[k : k + 10_000]
            out, span = parsed(b, some, pa.array(names, pa.string()), cache)
            number = base + text.place(some) if by_place else np.arange(base + 1, base + 1 + len(some))
            base += 0 if by_place else len(some)
            out = pa.RecordBatch.from_arrays([pa.array([file] * len(some)), pa.array(number, pa.int64()), *out.columns], ["file", "row_ix", *out.schema.names])
            if chromosome is not None:
                ref, pos = out.column("chromosome"), out.column("position").fill_null(0).to_numpy()
                near = (pos > 0) & (pos <= end) & (pos + span - 1 >= start)
                out = out.filter(pa.array(near & np.array([x == chromosome for x in ref.to_pylist()], dtype=bool)))
            if out.num_rows:
                yield out


def _whole(spark: SparkSession, files: list[str]) -> DataFrame:
    """Files of systems that only Spark reads: one task each; row_ix counts in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                f = io.BytesIO(content.as_py())
                size, blocked, names, place = header(f, path)
                yield from _rows(Text(f, size, place, blocked), 1 << 62, path, names, 0, False, None, 0, 0)

    return spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(run, SCHEMA)


def _meets(df: DataFrame, chromosome: str | None, start: int, end: int) -> DataFrame:
    if chromosome is None:
        return df
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit("(\\d+)[MDN=X]"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))
    return df.where((F.col("chromosome") == chromosome) & (F.col("position") <= end) & (F.col("position") + span > start))


# Writing, so that tables of alignments can be handed on.


def block(data: bytes) -> bytes:
    """A gzip member that tells its size; data has at most 65,280 bytes."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def encoded(names: dict[str, int], id: str, sread: str, qual: str, chromosome: str | None, position: int | None, strand: str | None, quality: float | None) -> bytes:
    """One record, aligned without gaps."""
    mapped = chromosome is not None and position is not None
    code = [BASES.index(x) if x in BASES else 15 for x in sread] + [0] * (len(sread) % 2)
    flag = (0 if mapped else 4) | (16 if strand == "-" else 0)
    size = len(sread) if mapped else 0
    number = 4680 if not mapped else _bin(position - 1, position - 1 + max(1, size))
    body = struct.pack("<iiBBHHHiiii", names[chromosome] if chromosome is not None else -1, position - 1 if mapped else -1, len(id.encode()) + 1, 255 if quality is None else int(quality), number, int(mapped), flag, len(sread), -1, -1, 0)
    body += id.encode() + b"\0" + (struct.pack("<I", size << 4) if mapped else b"") + bytes(a << 4 | b for a, b in zip(code[::2], code[1::2])) + bytes(ord(q) - 33 for q in qual)
    return struct.pack("<i", len(body)) + body


_CODES = np.array([BASES.index(chr(x)) if chr(x) in BASES else 15 for x in range(256)], dtype=np.uint8)


def _pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column without nulls, and where each begins and the last ends."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def encoded_rows(names: dict[str, int], batch: pa.RecordBatch) -> tuple[bytes, np.ndarray]:
    """What encoded() gives for each row, one behind the other, and where each begins and the last ends.  Rows with other
    letters than ASCII, or with what has no place in a record, are left to encoded()."""
    fields = ("id", "sread", "qual", "chromosome", "position", "strand", "align_quality")
    found = _encoded_at_once(names, batch)
    if found is not None:
        return found
    each = [encoded(names, *(r[c] for c in fields)) for r in batch.to_pylist()]
    return b"".join(each), np.r_[0, np.cumsum([len(x) for x in each])].astype(np.int64)


def _encoded_at_once(names: dict[str, int], batch: pa.RecordBatch) -> tuple[bytes, np.ndarray] | None:
    n = batch.num_rows
    if not n or any(batch.column(c).null_count for c in ("id", "sread", "qual")):
        return None
    (ids, id_at), (seq, seq_at), (qual, qual_at) = (_pieces(batch.column(c)) for c in ("id", "sread", "qual"))
    known = np.asarray(batch.column("chromosome").is_valid())
    ref = pc.fill_null(pc.index_in(batch.column("chromosome").cast(pa.string()), value_set=pa.array(list(names), pa.string())), -1).to_numpy(zero_copy_only=False)
    ref = np.where(known, np.array([*names.values(), -1], dtype=np.int64)[ref], -1)
    mapped = known & np.asarray(batch.column("position").is_valid())
    pos = np.where(mapped, pc.fill_null(batch.column("position").cast(pa.int64()), 0).to_numpy(zero_copy_only=False) - 1, -1)
    quality = pc.fill_null(batch.column("align_quality").cast(pa.float64()), 255).to_numpy(zero_copy_only=False)
    name, length, scores = np.diff(id_at) + 1, np.diff(seq_at), np.diff(qual_at)
    number, end = np.zeros(n, dtype=np.int64), pos + np.maximum(1, length)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        number = np.where(pos >> shift == end - 1 >> shift, first + (pos >> shift), number)
    number = np.where(mapped, number, 4680)
    fits = lambda x, least, most: bool(np.all((x >= least) & (x <= most)))
    if not (fits(seq, 0, 127) and fits(qual, 33, 127) and fits(ref[known], 0, 1 << 30) and fits(name, 0, 255) and fits(pos, -(1 << 31), (1 << 31) - 1) and fits(quality, 0, 255) and fits(number, 0, 65_535)):
        return None
    head = np.zeros(n, dtype=_HEAD)
    flag = np.where(mapped, 0, 4) + np.where(np.asarray(pc.fill_null(pc.equal(batch.column("strand").cast(pa.string()), "-"), False)), 16, 0)
    size = 32 + name + 4 * mapped + (length + 1) // 2 + scores
    for c, x in (("size", size), ("ref", ref), ("pos", pos), ("name", name), ("quality", quality.astype(np.int64)), ("bin", number), ("ops", mapped), ("flag", flag), ("length", length), ("mate", -1), ("mate_pos", -1)):
        head[c] = x
    at = np.r_[0, np.cumsum(size + 4)]
    out, start = np.zeros(int(at[-1]), dtype=np.uint8), at[:-1]
    within = lambda ends: np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
    out[start[:, None] + np.arange(_HEAD.itemsize)] = head.view(np.uint8).reshape(n, -1)
    start = start + _HEAD.itemsize
    out[np.repeat(start, name - 1) + within(id_at)] = ids
    start = start + name
    out[start[mapped][:, None] + np.arange(4)] = (length[mapped] << 4).astype("<u4").view(np.uint8).reshape(-1, 4)
    start = start + 4 * mapped
    place = within(seq_at)
    to, high, code = np.repeat(start, length) + place // 2, place % 2 == 0, _CODES[seq]
    out[to[high]] = code[high] << 4
    out[to[~high]] |= code[~high]
    out[np.repeat(start + (length + 1) // 2, scores) + within(qual_at)] = qual - 33
    return out.tobytes(), at


def _bin(start: int, end: int) -> int:
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end - 1 >> shift:
            return first + (start >> shift)
    return 0


def write_bam(df: DataFrame, folder: str, chromosomes: list[str], text: int = 65_280) -> None:
    """A local or shared folder of alignment maps, one a partition, each with its index where its rows are in the order of
    chromosomes and positions.  Columns: id, sread, qual, chromosome, position, strand, align_quality."""
    folder = folder.removeprefix("file://")
    names = {c: k for k, c in enumerate(chromosomes)}
    head = b"BAM\1" + struct.pack("<ii", 0, len(names)) + b"".join(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", 1 << 29) for c in chromosomes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        context = TaskContext.get()
        to = os.path.join(folder, f"part-{context.partitionId():05d}.bam")
        draft = f"{to}.{context.taskAttemptId()}"
        bins: list[dict[int, list[list[int]]]] = [{} for _ in names]
        line: list[dict[int, int]] = [{} for _ in names]
        rows, held, at = 0, b"", 0
        with open(draft, "wb") as f:
            at += f.write(block(head))
            for batch in batches:
                data, starts = encoded_rows(names, batch)
                given = np.frombuffer(data, dtype=np.uint8)[starts[:-1, None] + np.arange(_HEAD.itemsize)].view(_HEAD)[:, 0] if batch.num_rows else np.empty(0, _HEAD)
                ref, number = given["ref"].astype(np.int64), given["bin"].astype(np.int64)
                placed = (ref >= 0) & np.asarray(batch.column("position").is_valid())
                low = given["pos"].astype(np.int64)
                low, high = low >> 14, low + np.maximum(0, given["length"] - 1) >> 14
                # Rows that differ from the one before them in what the index tells of them.
                fresh = np.r_[True, np.any(np.diff([ref, number, placed, low, high]), axis=0)]
                rows += batch.num_rows
                i = 0
                while i < batch.num_rows:
                    # Rows that the block has room for; one that is longer than a block begins a block.
                    k = int(np.searchsorted(starts[1:], starts[i] + text - len(held), side="right"))
                    if k <= i and held:
                        at += f.write(block(held))
                        held = b""
                        continue
                    k = max(k, i + 1)
                    first, skipped = at << 16 | len(held), int(starts[i])
                    held += data[skipped : starts[k]]
                    while len(held) > text:
                        at += f.write(block(held[:text]))
                        held = held[text:]
                    cuts = [i, *(i + 1 + np.flatnonzero(fresh[i + 1 : k])).tolist(), k]
                    for a, b in zip(cuts, cuts[1:]):
                        if not placed[a]:
                            continue
                        place, end = first + int(starts[a]) - skipped, first + int(starts[b]) - skipped if b < k else at << 16 | len(held)
                        own = bins[ref[a]].setdefault(int(number[a]), [])
                        if own and own[-1][1] == place:
                            own[-1][1] = end
                        else:
                            own.append([place, end])
                        for w in range(int(low[a]), int(high[a]) + 1):
                            line[ref[a]].setdefault(w, place)
                    i = k
            at += f.write(block(held)) if held else 0
            f.write(block(b""))
        with open(f"{draft}.bai", "wb") as f:
            f.write(b"BAI\1" + struct.pack("<i", len(names)))
            for own, windows in zip(bins, line):
                f.write(struct.pack("<i", len(own)))
                for number, stretches in sorted(own.items()):
                    f.write(struct.pack("<Ii", number, len(stretches)) + b"".join(struct.pack("<QQ", *s) for s in stretches))
                last, least = max(windows, default=-1), 0
                f.write(struct.pack("<i", last + 1))
                for w in range(last + 1):
                    least = windows.get(w, least)
                    f.write(struct.pack("<Q", least))
        # The index first: a map is complete when it has its name.
        os.replace(f"{draft}.bai", f"{to}.bai")
        os.replace(draft, to)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    df.select("id", "sread", "qual", "chromosome", "position", "strand", "align_quality").mapInArrow(run, "rows bigint").collect()
