"""Fill-in-middle examples: a text is cut twice and its parts are put in another order, behind marks that tell them apart.

A batch is one buffer of UTF-8 bytes, and all its rows are done together.  A table gives each byte its class; a byte starts
a unit by its class and its left neighbour's (a code point: no continuation byte; a word: no white space, behind white
space or a text's start).  The running count of starts, less its value where a text begins, numbers the units of each
text; searching it finds the bytes where all cuts lie.  One gather lays the parts and marks of all rows out.

The cuts come from the SHA-256 of `seed:id`, so they depend on nothing but the id, and equal seeds give equal rows.

Defined results: a null text is empty and plain, an empty one too; a text that holds a mark is plain, as it could not be
rebuilt; a null id is hashed as if it had no digits; repeated rows give repeated rows; an empty table gives an empty table;
columns that are not named are ignored.  A very long text is a batch of its own (about 40 bytes a byte).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_slices

MARKS = b"<P><S><M>"
FORMS = ["plain", "psm", "spm"]
SPACE, CONTINUES, OTHER = 0, 1, 2
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[0x80:0xC0] = CONTINUES
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and the ends of its rows, from 0; nulls are empty."""
    if not len(texts):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = texts.fill_null("").cast(pa.large_string())
    _, ends, data = wide.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces data[start : start + size] of each row (rows x pieces) laid end to end, and the ends of rows."""
    flat, n = start.ravel(), size.ravel()
    stop = np.cumsum(n)
    at = np.repeat(flat - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)
    return data[at], np.r_[0, np.cumsum(size.sum(axis=1))]


def units(data: np.ndarray, ends: np.ndarray, words: bool) -> np.ndarray:
    """Which bytes start a unit."""
    kind = _CLASS[data]
    if not words:
        return kind != CONTINUES
    left = np.r_[np.uint8(SPACE), kind[:-1]]
    left[ends[:-1][ends[:-1] < len(data)]] = SPACE
    return (kind != SPACE) & (left == SPACE)


def marks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where marks begin, whose they are (0 P, 1 S, 2 M) and in which row; a mark does not reach into the next row."""
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")))
    which = np.searchsorted(np.array(sorted(b"PSM"), dtype=np.uint8), data[at + 1])
    letters = np.frombuffer(b"MPS\0", dtype=np.uint8)[which]
    row = np.searchsorted(ends, at, side="right") - 1
    good = (letters == data[at + 1]) & (at + 3 <= ends[row + 1])
    return at[good], np.array([2, 0, 1, 3])[which[good]], row[good]


def transform(texts: pa.Array, h: np.ndarray, keep: int, spm: int, words: bool) -> dict[str, np.ndarray | pa.Array]:
    """Outputs of all rows.  h: four unsigned numbers a row."""
    data, ends = buffers(texts)
    begin = units(data, ends, words)
    count = np.r_[0, np.cumsum(begin)]
    base = count[ends[:-1]]
    n = count[ends[1:]] - base
    first, second = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    held = np.zeros(len(n), dtype=bool)
    held[marks(data, ends)[2]] = True
    plain = (ends[1:] == ends[:-1]) | held | (h[:, 2] % 100 >= keep)
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < spm, 2, 1))
    # The byte where unit k of a text starts is the first one behind which k + 1 starts have been seen; k = n is the end.
    cut = lambda k: np.where(k == n, ends[1:], np.where(k == 0, ends[:-1], np.searchsorted(count[1:], base + k + 1)))
    a, b = np.minimum(first, second), np.maximum(first, second)
    low, high = cut(a), cut(b)
    start, stop = ends[:-1], ends[1:]
    mark = [np.full(len(n), len(data) + 3 * k) for k in range(3)]
    three, none = np.where(plain, 0, 3), np.zeros(len(n), dtype=np.int64)
    prefix, middle, suffix = (start, low - start), (low, high - low), (high, stop - high)
    as_is = (start, stop - start)
    pick = lambda *three_ways: tuple(np.choose(form, [w[k] for w in three_ways]) for k in (0, 1))
    P, S, M, nothing = (mark[0], three), (mark[1], three), (mark[2], three), (start, none)
    pieces = [pick(nothing, P, S), pick(as_is, prefix, suffix), pick(nothing, S, P), pick(nothing, suffix, prefix), pick(nothing, M, M), pick(nothing, middle, middle)]
    out, out_ends = gather(np.r_[data, np.frombuffer(MARKS, dtype=np.uint8)], np.stack([p[0] for p in pieces], 1), np.stack([p[1] for p in pieces], 1))
    return {"n": n, "form": form, "plain": plain, "prefix": a, "middle": b - a, "output": strings(out, out_ends)}


def rebuilt(outputs: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts from outputs and forms alone: the marks tell where the parts are."""
    data, ends = buffers(outputs)
    at, which, row = marks(data, ends)
    where = np.zeros((3, len(form)), dtype=np.int64)
    used = form[row] != 0
    where[which[used], row[used]] = at[used]
    p, s, m = where
    start, stop = ends[:-1], ends[1:]
    zero = np.zeros_like(start)
    pick = lambda *ways: np.choose(form, ways)
    begins = np.stack([pick(start, p + 3, p + 3), pick(start, m + 3, m + 3), pick(start, s + 3, s + 3)], 1)
    sizes = np.stack([pick(stop - start, s - p - 3, m - p - 3), pick(zero, stop - m - 3, stop - m - 3), pick(zero, m - s - 3, p - s - 3)], 1)
    return strings(*gather(data, begins, sizes))


def cut_numbers(key: Column, seed: int = 1) -> Column:
    """The first four unsigned 32-bit numbers of the SHA-256 of seed:key, as an array of longs."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, keep: int = 90, spm: int = 20, unit: str = "char", keep_cols: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, keep_cols, n (units), form (plain, psm or spm), prefix_chars and middle_chars (units; null if plain),
    output and restored, the text rebuilt from output and form.  keep, spm: percent that is transformed, and of that spm."""
    if unit not in ("char", "word"):
        raise ValueError(f"unit is char or word, not {unit}")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), cut_numbers(F.col(id_col), seed).alias("h"), *(F.col(c).alias(f"keep_{c}") for c in keep_cols))
    kinds = {c: docs.schema[c].dataType.simpleString() for c in docs.columns if c not in ("text", "h")}
    names = ["n", "form", "prefix_chars", "middle_chars", "output", "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                h = part.column("h").flatten().to_numpy().reshape(-1, 4)
                done = transform(part.column("text"), h, keep, spm, unit == "word")
                where = [pa.array(done[c], pa.int64(), mask=done["plain"]) for c in ("prefix", "middle")]
                form = pa.DictionaryArray.from_arrays(pa.array(done["form"], pa.int32()), FORMS).cast(pa.string())
                texts = [x.cast(pa.string()) for x in (done["output"], rebuilt(done["output"], done["form"]))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kinds), pa.array(done["n"], pa.int64()), form, *where, *texts], [*kinds, *names])

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, restored string"
    done = docs.mapInArrow(run, schema)
    return done.select(F.col("id").alias(id_col), *(F.col(f"keep_{c}").alias(c) for c in keep_cols), *names)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
h AS (SELECT *, CAST(length(t) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p
"""
