"""Byte-level BPE over rank files, encoded in overlapping chunks and decoded by joining raw bytes.

A text is cut into chunks of code points, each with some overlap into the next, which are rows that tasks pre-tokenise
independently of each other.  From a position where both neighbours begin a pre-token their further pre-tokens are the
same, because a match depends only on what follows its start: there, behind a character that is no white space (white
space looks ahead), the chunks are stitched.  The pieces between stitches are encoded, each by itself, and a text's ids
are joined in order.  Where an overlap has no such position, the text is done again with chunks and overlaps that are
16 times as long, until it has one everywhere or is a single chunk.  Texts of one chunk move to no other task.

Defined results: a null text counts as empty (no ids, hashes of the empty string); repeated rows give repeated rows, and
equal texts of several chunks are encoded once; columns other than the two that are named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, text_slices, texts_of

#: Code points of a chunk and of its overlap, and how much longer they get where chunks do not meet.
CHUNK, OVERLAP, LONGER = 16384, 512, 16
#: Code points above this are classed by the library itself, whose Unicode tables may be older.
_RARE = regex.compile("[\U00000250-\U0010ffff]")


class ChunkedBPE:
    def __init__(self, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.chunk, self.overlap = pattern, chunk, overlap
        self.find = regex.compile(pattern)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.raw[i] = b
        self.decimal = [b"%d" % i for i in range(len(self.raw))]
        self.kinds: dict[int, str | None] = {}

    def learn_kinds(self, block: int) -> None:
        """Stand-ins of the classes that the library gives the 256 code points of a block: two characters of one class can
        merge.  One vocabulary that can merge each of them with each probe tells all."""
        import tiktoken

        points = [c for c in range(block << 8, (block + 1) << 8) if not 0xD800 <= c < 0xE000]
        ranks = {bytes([b]): b for b in range(256)}
        for probe in "a1!":
            for c in points:
                whole = (probe + chr(c)).encode()
                for n in range(2, len(whole) + 1):
                    ranks.setdefault(whole[:n], len(ranks))
        one = tiktoken.Encoding("probe", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        for c in points:
            self.kinds[c] = next((p for p in "a1!" if len(one.encode_ordinary(p + chr(c))) == 1), "\u3000")

    def classed(self, text: str) -> str:
        """The text with rare code points replaced by stand-ins of the library's class, length kept."""
        if text.isascii() or not _RARE.search(text):
            return text
        rare = {ord(c) for c in _RARE.findall(text)}
        for block in {c >> 8 for c in rare - self.kinds.keys()}:
            self.learn_kinds(block)
        return text.translate({c: self.kinds[c] for c in rare})

    def starts(self, seen: str, last: bool) -> list[int]:
        """Where pre-tokens of a chunk begin; where the cut may have changed a match, none is given."""
        spans = [m.span() for m in self.find.finditer(seen)]
        # A match that reaches the cut may go on behind it; one before it stands, but for white space that looked at it.
        while not last and spans and (spans[-1][1] >= len(seen) or seen[spans[-1][0] :].isspace()):
            spans.pop()
        return [a for a, _ in spans]

    def edges(self, text: str, last: bool, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
        """Of a chunk with its overlap: where pre-tokens begin in its first `overlap` code points, and in those behind
        the chunk, where the next one begins; there only behind a character that is no white space."""
        seen = self.classed(text)
        at = self.starts(seen, last)
        return [x for x in at if x < overlap], [x - chunk for x in at if x >= chunk and not seen[x - 1].isspace()]

    def pieces(self, text: str) -> list[str]:
        """A text cut at the stitches of its chunks, as the distributed form cuts it."""
        chunk, overlap = self.chunk, self.overlap
        while True:
            at = range(0, len(text), chunk) if len(text) > chunk + overlap else [0]
            edges = [self.edges(c, last, chunk, overlap) for _, last, c in cut(text, chunk, overlap)] if len(at) > 1 else [([0], [])]
            meet = [0, *(min(set(tail) & set(head), default=None) for (_, tail), (head, _) in zip(edges, edges[1:]))]
            if None not in meet:
                stitches = [a + m for a, m in zip(at, meet)]
                return [text[a:b] for a, b in zip(stitches, [*stitches[1:], len(text)])]
            chunk, overlap = chunk * LONGER, overlap * LONGER

    def encode(self, text: str) -> list[int]:
        return [i for s in self.pieces(text) for i in self.core.encode_ordinary(s)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def hashes(self, parts: list[list[int]]) -> tuple[int, str, str]:
        """Of lists of ids: their number, and the hashes of the ids and of the bytes that they give again."""
        n, ids_hash, raw_hash = 0, hashlib.sha256(), hashlib.sha256()
        for ids in filter(len, parts):
            ids_hash.update((b"," if n else b"") + b",".join(map(self.decimal.__getitem__, ids)))
            raw_hash.update(self.decode(ids))
            n += len(ids)
        return n, ids_hash.hexdigest(), raw_hash.hexdigest()

    def digests(self, text: str) -> tuple[int, str, str]:
        return self.hashes([self.core.encode_ordinary(s) for s in self.pieces(text)])


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, bool, str]]:
    """Number of each chunk, whether it is the last, and its text with the overlap."""
    if len(text) <= chunk + overlap:
        yield 0, True, text
        return
    for k, at in enumerate(range(0, len(text), chunk)):
        yield k, at + chunk >= len(text), text[at : at + chunk + overlap]


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> ChunkedBPE:
    return ChunkedBPE(path, pattern)


def _keyed(long: DataFrame, chunk: int, overlap: int, chunks: bool) -> DataFrame:
    """Rows (key, seq, last, piece) of the chunks of long texts, or (id, key); equal texts have equal keys."""
    kind = long.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                keys = [hashlib.sha256(t.encode()).digest() for t in texts]
                if not chunks:
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(keys, pa.binary())], ["id", "key"])
                    continue
                for key, text in zip(keys, texts):
                    seq, last, piece = map(list, zip(*cut(text, chunk, overlap)))
                    for at in range(0, len(seq), 64):
                        some = slice(at, at + 64)
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(seq[some]), pa.binary()), pa.array(seq[some], pa.int32()), pa.array(last[some]), pa.array(piece[some], pa.string())], ["key", "seq", "last", "piece"])

    return long.mapInArrow(run, "key binary, seq int, last boolean, piece string" if chunks else f"id {kind}, key binary")


def _long_ids(long: DataFrame, ranks: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Rows (key, seq, ids) of the pieces of texts that have several chunks; ids are 32-bit numbers."""
    out, left = None, None
    while True:

        def edges(batches: Iterator[pa.RecordBatch], chunk: int = chunk, overlap: int = overlap) -> Iterator[pa.RecordBatch]:
            coder = _coder(ranks, pattern)
            for batch in batches:
                for part in text_slices(batch, "piece"):
                    found = [coder.edges(t, last, chunk, overlap) for t, last in zip(part.column("piece").to_pylist(), part.column("last").to_pylist())]
                    head, tail = (pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "seq", "piece")), head, tail], ["key", "seq", "piece", "head", "tail"])

        def encode(batches: Iterator[pa.RecordBatch], chunk: int = chunk) -> Iterator[pa.RecordBatch]:
            coder = _coder(ranks, pattern)
            for batch in batches:
                for part in text_slices(batch, "piece"):
                    rows = zip(*(part.column(c).to_pylist() for c in ("piece", "start", "stop")))
                    ids = [np.array(coder.core.encode_ordinary(t[a : None if b is None else chunk + b]), dtype=np.int32).tobytes() for t, a, b in rows]
                    yield pa.RecordBatch.from_arrays([part.column("key"), part.column("seq"), pa.array(ids, pa.binary())], ["key", "seq", "ids"])

        chunks = _keyed(long, chunk, overlap, True)
        if left is not None:
            chunks = chunks.join(left, "key", "left_semi")
        # Each chunk is a row of its own task; those of equal texts become one.
        seen = durable(chunks.groupBy("key", "seq").agg(F.first("last").alias("last"), F.first("piece").alias("piece")).mapInArrow(edges, "key binary, seq int, piece string, head array<int>, tail array<int>"))
        before = seen.select("key", (F.col("seq") + 1).alias("seq"), F.col("tail").alias("before"))
        meet = F.when(F.col("seq") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("before", "head")))
        starts = durable(seen.select("key", "seq", "head").join(before, ["key", "seq"], "left").select("key", "seq", meet.alias("start")))
        left = starts.where("start is null").select("key").distinct()
        stops = starts.select("key", (F.col("seq") - 1).alias("seq"), F.col("start").alias("stop"))
        pieces = seen.select("key", "seq", "piece").join(starts.join(left, "key", "left_anti").join(stops, ["key", "seq"], "left"), ["key", "seq"])
        ids = pieces.select("key", "seq", "piece", "start", "stop").mapInArrow(encode, "key binary, seq int, ids binary")
        out = ids if out is None else out.unionByName(ids)
        if not starts.where("start is null").limit(1).count():
            return out
        left = durable(left)
        chunk, overlap = chunk * LONGER, overlap * LONGER


def _coded(docs: DataFrame, ranks: str, pattern: str, id_col: str, text_col: str, chunk: int, overlap: int, names: list[str], kinds: list, ddl: str, make) -> DataFrame:
    """Per row: id and what make(coder, lists of ids) gives of its ids."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    is_long = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in batches:
            for part in text_slices(batch, "text"):
                done = [make(coder, [coder.core.encode_ordinary(x)]) for x in texts_of(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, t) for c, t in zip(zip(*done), kinds))], ["id", *names])

    def join(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        done = make(_coder(ranks, pattern), [np.frombuffer(b, dtype=np.int32).tolist() for b in rows.column("ids").to_pylist()])
        return pa.table([rows.column("key").slice(0, 1), *(pa.array([x], t) for x, t in zip(done, kinds))], names=["key", *names])

    long = docs.where(is_long)
    found = _long_ids(long, ranks, pattern, chunk, overlap).groupBy("key").applyInArrow(join, f"key binary, {ddl}")
    rows = _keyed(long, chunk, overlap, False).join(found, "key").select("id", *names)
    return docs.where(~is_long).mapInArrow(run, f"id {kind}, {ddl}").unionByName(rows).withColumnRenamed("id", id_col)


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: id and `ids`, the text's token ids."""
    make = lambda coder, parts: ([i for ids in parts for i in ids],)
    return _coded(docs, ranks, pattern, id_col, text_col, chunk, overlap, ["ids"], [pa.list_(pa.int32())], "ids array<int>", make)


def bpe_decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and `bytes`, the raw bytes of the ids joined (null ids: empty)."""
    schema = f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = pa.array([coder.decode(x or []) for x in part.column(ids_col).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(id_col), raw], [id_col, "bytes"])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode and decode: id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256."""
    ddl = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _coded(docs, ranks, pattern, id_col, text_col, chunk, overlap, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], ddl, ChunkedBPE.hashes)
