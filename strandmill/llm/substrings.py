"""Removing word sequences that occur more than once, by a count-min prefilter and exact groups of what it lets through.

A window is `width` consecutive words of one text.  Its *anchor* is the least hash among its runs of GRAM words, so equal
windows have equal anchors, at different places.  About one run of words in fourteen is an anchor.

1. Each partition counts its anchors in a sketch of ROWS rows of cells.  The sketches are added up, block by block, in
   shuffled tasks; what comes back is one bit a cell: two or more.  An anchor whose bits are set in all rows may be
   repeated.  Cells only ever count too much, so no repeated window is lost.
2. Windows with such anchors are grouped by 128 bits of hash.  A task settles repeats among its own windows and sends each
   of its hashes on once, so a window that is everywhere arrives once a task and not once an occurrence.
3. Documents meet the places of their repeated windows by 96 bits of a digest of the text.

Texts that occur in several rows are found by the same sketch and an exact count; one copy stands for all in step 2, and
each copy loses all its words if it has a window at all.

The sketch has a fixed size (`cells` a row, two bits of result a cell pair, 64 MB at the default), collected and broadcast.
Where it fills (beyond some 30 GB of distinct text at the default), more unique windows go through step 2, up to all of
them, at a row a window; the result stays the same.

Defined results: a null text has no words; texts of fewer words than a window lose nothing; rows that repeat a text are
places of their own, also when they agree in the id; an empty table gives an empty table; columns that are not named are
ignored.  A very long text is held whole by its task (some 60 bytes a word).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, text_slices, texts_of
from .shingles import mixed, word_hashes

GRAM, ROWS, BLOCK = 8, 2, 1 << 20
#: Cells of a row of the sketch.
CELLS = 1 << 28
#: Anchors, or windows, that a task holds before it sends them on.
HELD = 4_000_000
#: Texts with more than this part of all rows are at most as many, and are broadcast.
FREQUENT = 10_000
_BASES = np.array([0x5851F42D4C957F2D, 0xD1342543DE82EF95], dtype=np.uint64)
_SALT = np.uint64(0xA0761D6478BD642F)


class Runs:
    """Hashes of runs of words of many texts, by running sums of h[i] * base**i, which wrap at 64 bits."""

    def __init__(self, texts: list[str]):
        self.words, self.counts = word_hashes(texts, lower=False)
        self.ends = np.cumsum(self.counts)
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def hashes(self, width: int, kind: int = 0) -> np.ndarray:
        n = len(self.words)
        if kind not in self.sums:
            base = _BASES[kind]
            back = np.uint64(pow(int(base), -1, 1 << 64))
            power, inverse = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b)]) for b in (base, back))
            words = self.words if kind == 0 else mixed(self.words ^ _SALT)
            self.sums[kind] = np.r_[np.uint64(0), np.cumsum(words * power[:n])], inverse
        sums, inverse = self.sums[kind]
        return mixed((sums[width:] - sums[: len(sums) - width]) * inverse[: max(0, n - width + 1)])

    def windows(self, width: int) -> np.ndarray:
        """Which runs of `width` words lie within one text, by their first word."""
        n = max(0, len(self.words) - width + 1)
        inside = np.ones(n, dtype=bool)
        for back in range(1, width):
            at = self.ends - back
            inside[at[(at >= 0) & (at < n)]] = False
        return inside

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The anchor of each window, with those that cross texts at 0; and which runs of GRAM words are anchors."""
        gram = min(GRAM, width)
        g = self.hashes(gram) | np.uint64(1)
        span = width - gram + 1
        if len(g) < span:
            return g[:0], np.zeros(len(g), dtype=bool)
        least = _slide(g, span, np.minimum)
        least[~self.windows(width)] = 0
        edge = np.zeros(span - 1, dtype=np.uint64)
        most = _slide(np.r_[edge, least, edge], span, np.maximum)
        return least, most == g


def _slide(x: np.ndarray, span: int, better) -> np.ndarray:
    """The best of each `span` neighbours, by doubling."""
    if len(x) < span:
        return x[:0].copy()
    size = 1
    while size * 2 <= span:
        x = better(x[:-size], x[size:])
        size *= 2
    return better(x[: len(x) - (span - size)], x[span - size :]) if span > size else x.copy()


def _cells(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cells of keys in each row of the sketch; rows are laid end to end."""
    return [(mixed(keys + np.uint64(r) * _SALT) & np.uint64(cells - 1)) + np.uint64(r * cells) for r in range(ROWS)]


def repeated_cells(docs: DataFrame, width: int, cells: int) -> list[tuple[int, bytes]]:
    """Blocks of the merged sketch as compressed bits: cells that count two or more.  docs: d1, text."""
    schema = "block int, once binary, more binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in text_slices(batch, "text"):
                runs = Runs(texts_of(part, "text"))
                _, chosen = runs.anchors(width)
                held += [(runs.hashes(min(GRAM, width)) | np.uint64(1))[chosen], part.column("d1").to_numpy().view(np.uint64)]
                if sum(map(len, held)) > HELD:
                    yield from _blocks(np.concatenate(held), cells)
                    held = []
        if held:
            yield from _blocks(np.concatenate(held), cells)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, once, more in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "more"))):
                if block not in sums:
                    sums[block] = np.zeros(BLOCK, dtype=np.uint8)
                at = np.frombuffer(once, dtype=np.uint32)
                sums[block][at] = np.minimum(sums[block][at] + 1, 2)
                sums[block][np.frombuffer(more, dtype=np.uint32)] = 2
        for block, n in sums.items():
            if (n > 1).any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(np.packbits(n > 1).tobytes(), 1)])], ["block", "bits"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.mapInArrow(count, schema).repartition(parts, "block").mapInArrow(merge, "block int, bits binary").toArrow()
    return list(zip(found.column("block").to_pylist(), found.column("bits").to_pylist()))


def _blocks(keys: np.ndarray, cells: int) -> Iterator[pa.RecordBatch]:
    """A partition's sketch: offsets within each block of cells that count one, and of those that count more."""
    at, n = np.unique(np.concatenate(_cells(keys, cells)), return_counts=True)
    block = (at // np.uint64(BLOCK)).astype(np.int32)
    at = (at % np.uint64(BLOCK)).astype(np.uint32)
    cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)].tolist()
    rows = [(int(block[a]), at[a:b][n[a:b] == 1].tobytes(), at[a:b][n[a:b] > 1].tobytes()) for a, b in zip(cuts, cuts[1:]) if b > a]
    for k in range(0, len(rows), 64):
        one = list(zip(*rows[k : k + 64]))
        yield pa.RecordBatch.from_arrays([pa.array(one[0], pa.int32()), pa.array(one[1], pa.binary()), pa.array(one[2], pa.binary())], ["block", "once", "more"])


class Sketch:
    """Bits of repeated cells; blocks that no task sent are empty."""

    def __init__(self, blocks: list[tuple[int, bytes]], cells: int):
        self.cells = cells
        self.bits = np.zeros((cells * ROWS + 7) // 8, dtype=np.uint8)
        for block, bits in blocks:
            at = block * (BLOCK // 8)
            part = np.frombuffer(zlib.decompress(bits), dtype=np.uint8)[: len(self.bits) - at]
            self.bits[at : at + len(part)] = part

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Keys that may have been counted twice or more."""
        found = np.ones(len(keys), dtype=bool)
        for at in _cells(keys, self.cells):
            found &= (self.bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & np.uint8(1) == 1
        return found


#: h1, h2: a window's hash.  d1, d2: 96 bits of its text's digest; d2 has another 31 bits for its place and one that it asks.
_FOUND = "h1 bigint, h2 bigint, d1 bigint, d2 bigint, sure binary, text string, n bigint"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_TYPES = [pa.int64()] * 4 + [pa.binary(), pa.string(), pa.int64()]


def _rows(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(_NAMES, _TYPES)], _NAMES)


def _settled(held: list[tuple[np.ndarray, ...]], ask: bool) -> Iterator[pa.RecordBatch]:
    """Windows of a task: each hash once; it asks if it is alone, else the places of all its windows are sure."""
    h1, h2, d1, d2, pos = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((h2, h1))
    new = np.r_[True, (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)]
    group = np.cumsum(new) - 1
    alone = np.bincount(group) == 1
    first = order[new]
    for k in range(0, len(first), 100_000):
        one = first[k : k + 100_000]
        low = pos[one].astype(np.int64) << 1 | (alone[k : k + 100_000] & ask)
        yield _rows(len(one), h1=h1[one].view(np.int64), h2=h2[one].view(np.int64), d1=d1[one], d2=d2[one] << 32 | low)
    sure = np.sort(order[~alone[group]])
    if ask and len(sure):
        d1, d2, pos = d1[sure], d2[sure], pos[sure]
        cut = np.r_[True, (np.diff(d1) != 0) | (np.diff(d2) != 0) | (np.diff(pos) != 1)]
        start, size = np.flatnonzero(cut), np.diff(np.r_[np.flatnonzero(cut), len(cut)])
        runs = np.c_[pos[start], size].astype(np.int32)
        doc = np.flatnonzero(np.r_[True, (np.diff(d1[start]) != 0) | (np.diff(d2[start]) != 0)]).tolist()
        for k in range(0, len(doc), 1000):
            ends = [*doc[k + 1 : k + 1000], doc[k + 1000] if k + 1000 < len(doc) else len(runs)]
            some = doc[k : k + 1000]
            yield _rows(len(some), d1=d1[start[some]], d2=d2[start[some]], sure=[runs[a:b].tobytes() for a, b in zip(some, ends)])


def _candidates(docs: DataFrame, width: int, sketch: Broadcast, distinct: bool) -> DataFrame:
    """Windows that may be repeated, of texts that occur once; others are given as texts.  distinct: rows are different
    texts with their number `n`, whose windows are wanted in any case and ask for themselves where the text occurs once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: dict[bool, list] = {True: [], False: []}
        table = Sketch(*sketch.value)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = [part.column(c).to_numpy() for c in ("d1", "d2")]
                if distinct:
                    own = part.column("n").to_numpy() == 1
                else:
                    copied = np.flatnonzero(table.maybe(ids[0].view(np.uint64)))
                    own = np.ones(part.num_rows, dtype=bool)
                    own[copied] = False
                    keys = [(int(ids[0][i]), int(ids[1][i])) for i in copied]
                    texts = []
                    for i, key in zip(copied.tolist(), keys):
                        texts.append(None if key in seen else part.column("text")[i].as_py())
                        seen.add(key)
                    yield _rows(len(keys), d1=[a for a, _ in keys], d2=[b for _, b in keys], text=texts, n=[1] * len(keys))
                for ask in (True, False) if distinct else (True,):
                    chosen = np.flatnonzero(own == ask)
                    runs = Runs([part.column("text")[i].as_py() for i in chosen.tolist()])
                    least, _ = runs.anchors(width)
                    at = np.flatnonzero(least)
                    at = at[table.maybe(least[at])]
                    if len(at):
                        doc = np.searchsorted(runs.ends, at, side="right")
                        h1, h2 = (runs.hashes(width, kind)[at] for kind in (0, 1))
                        held[ask].append((h1, h2, ids[0][chosen[doc]], ids[1][chosen[doc]], (at - (runs.ends - runs.counts)[doc]).astype(np.int32)))
                    if sum(len(h[0]) for h in held[ask]) > HELD:
                        yield from _settled(held[ask], ask)
                        held[ask] = []
        for ask, some in held.items():
            if some:
                yield from _settled(some, ask)

    return docs.mapInArrow(find, _FOUND)


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), cells: int = CELLS) -> DataFrame:
    """Per row: id, the columns of `keep`, n_words, n_removed, kept (words that stay, joined by one space) and removed
    (list of first word and number of words of each stretch that goes)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("d1"), F.shiftright(F.xxhash64(F.lit(1), text), 32).alias("d2"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    sketch = spark.sparkContext.broadcast((repeated_cells(docs.select("d1", "text"), width, cells), cells))
    found = durable(_candidates(docs.select("d1", "d2", "text"), width, sketch, False))
    copied = durable(found.where("n is not null").groupBy("d1", "d2").agg(F.first("text", ignorenulls=True).alias("text"), F.sum("n").alias("n")))
    again = durable(_candidates(copied, width, sketch, True))
    both = found.where("n is null").drop("text", "n").unionByName(again.drop("text", "n"))
    group = Window.partitionBy("h1", "h2")
    asked = both.where("h1 is not null").select("h1", "h2", "d1", "d2").withColumn("size", F.count("*").over(group)).where("d2 & 1 = 1 and size > 1")
    low = F.shiftright(F.col("d2").bitwiseAND((1 << 32) - 1), 1).cast("int")
    places = asked.select("d1", F.shiftright("d2", 32).alias("d2"), low.alias("pos"), F.lit(None).cast("binary").alias("sure"))
    places = places.unionByName(both.where("h1 is null").select("d1", "d2", F.lit(None).cast("int").alias("pos"), "sure"))
    cover = places.groupBy("d1", "d2").agg(F.collect_list("pos").alias("pos"), F.collect_list("sure").alias("sure")).withColumn("whole", F.lit(False))
    many = copied.where("n > 1").select("d1", "d2", "n")
    hot = F.broadcast(many.where(F.col("n") * FREQUENT > docs.count()).select("d1", "d2"))
    none = [F.array().cast("array<int>").alias("pos"), F.array().cast("array<binary>").alias("sure"), F.lit(True).alias("whole")]
    cover = cover.unionByName(many.select("d1", "d2", *none))
    rows = docs.join(hot, ["d1", "d2"], "left_anti").join(cover, ["d1", "d2"], "left")
    rows = rows.unionByName(docs.join(hot, ["d1", "d2"], "left_semi").select("*", *none))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ["id", *(f"keep_{c}" for c in keep)]}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                out = [_kept(*row, width) for row in zip(*(part.column(c).to_pylist() for c in ("text", "pos", "sure", "whole")))]
                cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kinds), *cols], [*kinds, "n_words", "n_removed", "kept", "removed"])

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", n_words bigint, n_removed bigint, kept string, removed array<array<int>>"
    done = rows.select(*kinds, "text", "pos", "sure", "whole").mapInArrow(finish, schema)
    return done.select(F.col("id").alias(id_col), *(F.col(f"keep_{c}").alias(c) for c in keep), "n_words", "n_removed", "kept", "removed")


def _kept(text: str, pos: list[int] | None, sure: list[bytes] | None, whole: bool | None, width: int) -> tuple[int, int, str, list]:
    words = text.encode().split()
    n = len(words)
    if whole:
        goes = np.full(n, n >= width)
    else:
        starts = np.zeros(n + 1, dtype=np.int64)
        at = np.array(pos or [], dtype=np.int64)
        np.add.at(starts, at, 1)
        np.add.at(starts, at + width, -1)
        for first, size in (r for b in sure or [] for r in np.frombuffer(b, dtype=np.int32).reshape(-1, 2).tolist()):
            starts[first] += 1
            starts[first + size - 1 + width] -= 1
        goes = np.cumsum(starts)[:n] > 0
    edge = np.flatnonzero(np.diff(np.r_[False, goes, False]))
    stretches = np.c_[edge[::2], edge[1::2] - edge[::2]].tolist()
    return n, int(goes.sum()), b" ".join(compress(words, ~goes)).decode(), stretches


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
c AS (SELECT r, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM c),
k AS (SELECT r, list(i) AS gone FROM g GROUP BY r),
f AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN w ELSE (SELECT coalesce(list(w[x.j] ORDER BY x.j), []) FROM (SELECT unnest(range(1, len(w) + 1)) AS j) AS x WHERE NOT list_contains(gone, x.j)) END AS kept
    FROM d LEFT JOIN k USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM f
"""
