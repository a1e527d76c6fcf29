"""Trimming of reads by quality, letters and adapters.

Each kind has a function that gives the kept range as columns and one that cuts reads and qualities alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentMismatch, one_of, warn
from ..schema import DNA
from .sequence import IUPAC, narrow


def _character(a: str) -> str:
    if len(a) != 1 or ord(a) > 127:
        raise ArgumentMismatch("'a' must be one character below 128")
    return a


def _set(characters: str) -> str:
    """Inside of a regular expression's class; escapes make any character safe."""
    return "".join(f"\\x{ord(x):02x}" for x in characters)


def _upto(a: str) -> str:
    return f"\\x00-\\x{ord(_character(a)):02x}"


def tail_end(c, k: int, a: str, successive: bool = False) -> Column:
    """Where to cut so that no k characters at most `a` are left: in all, or in a row."""
    c = F.col(c) if isinstance(c, str) else c
    low = _upto(a)
    if successive:
        if k < 1:
            raise ArgumentMismatch("'k' must be at least 1")
        return F.length(F.regexp_replace(c, f"(?s)[{low}]{{{k}}}.*$", ""))
    if k < 0:
        raise ArgumentMismatch("'k' must not be negative")
    if k == 0:
        return F.when(c.isNotNull(), F.lit(0))
    return F.length(F.regexp_extract(c, f"^(?:[^{low}]*+[{low}]){{0,{k - 1}}}[^{low}]*+", 0))


def window_end(c, k: int, a: str, halfwidth: int) -> Column:
    """Where to cut before the first window with k characters at most `a`.

    At a 0-based cycle j the window holds cycle min(width - 1, halfwidth), always, and the cycles j + 1 - halfwidth to
    j + halfwidth, drawn into the read at its ends.
    """
    if k < 0 or halfwidth < 1:
        raise ArgumentMismatch("'k' must not be negative and 'halfwidth' must be positive")
    limit, h = ord(_character(a)), halfwidth

    @F.pandas_udf("int")
    def end(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for reads in batches:
            text = reads.fillna("")
            size = text.str.len().to_numpy(dtype=np.int64)
            first = np.cumsum(size) - size
            codes = np.frombuffer("".join(text).encode("utf-32-le"), dtype=np.uint32)
            low = (codes <= limit).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(low)))
            some = size > 0
            start, last = np.repeat(first[some], size[some]), np.repeat((first + size - 1)[some], size[some])
            j = np.arange(len(codes))
            # Of a window the cycles inside of the read, and its first or last one again for each cycle outside.
            a, b = j + 1 - h, j + h
            count = upto[np.minimum(b, last) + 1] - upto[np.maximum(a, start)]
            if len(codes):
                count += low[start] * np.maximum(start - a, 0) + low[last] * np.maximum(b - last, 0)
                count += low[np.minimum(start + h, last)]
            hit = np.append(np.flatnonzero(count >= k), len(codes))
            cut_at = hit[np.searchsorted(hit, first)]
            yield pd.Series(np.minimum(cut_at - first, size).astype(np.int32)).where(reads.notna().to_numpy())

    return end(F.col(c) if isinstance(c, str) else c)


def end_bounds(c, a: str, left: bool = True, right: bool = True, relation: str = "<=", alphabet: str | None = None) -> tuple[Column, Column]:
    """First and last place kept when characters are stripped from the ends: those in `a`, or up to the last of them in
    the alphabet's order (by default that of character codes)."""
    one_of(relation, ("<=", "=="), "relation")
    c = F.col(c) if isinstance(c, str) else c
    if alphabet is None:
        known, cls = True, _set(a) if relation == "==" else f"\\x00-\\x{max(map(ord, a)):02x}"
    else:
        known = set(a) <= set(alphabet)
        places = [alphabet.index(x) for x in a if x in alphabet]
        chosen = "".join(alphabet[: max(places) + 1]) if places and relation == "<=" else "".join(x for x in a if x in alphabet)
        cls = _set(chosen)
    if not known:
        warn("some of 'a' are not in the alphabet", "ArgumentWarning")
    start, end = F.lit(1), F.length(c)
    if left and cls:
        start = 1 + F.length(c) - F.length(F.regexp_replace(c, f"^[{cls}]+", ""))
    if right and cls:
        end = F.length(F.regexp_replace(c, f"[{cls}]+$", ""))
    if cls and (left or right):
        emptied = start > F.length(c) if left else end == 0
        start, end = F.when(emptied, 1).otherwise(start), F.when(emptied, 0).otherwise(end)
    return start.cast("int"), end.cast("int")


def cut(reads: DataFrame, start, end, drop_empty: bool = True) -> DataFrame:
    """Reads and qualities narrowed to a range."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    marked = reads.withColumns({"_start": lit(start), "_end": lit(end)})
    new = {c: narrow(c, F.col("_start"), F.col("_end")) for c in ("sread", "qual") if c in reads.columns}
    out = marked.withColumns(new)
    out = out.where(F.col("_end") >= F.col("_start")) if drop_empty else out
    return out.drop("_start", "_end")


def ranges(reads: DataFrame, start, end) -> DataFrame:
    """row_ix, start, end and width of what would be kept."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return reads.select("row_ix", lit(start).alias("start"), lit(end).alias("end")).withColumn("width", F.col("end") - F.col("start") + 1)


def trim_tails(reads: DataFrame, k: int, a: str, successive: bool = False, as_ranges: bool = False, by: str = "qual") -> DataFrame:
    """Cut before the k-th character at most `a` (or the first k in a row); emptied reads are dropped."""
    end = tail_end(by, k, a, successive)
    return ranges(reads, 1, end) if as_ranges else cut(reads, 1, end)


def trim_window(reads: DataFrame, k: int, a: str, halfwidth: int, as_ranges: bool = False, by: str = "qual") -> DataFrame:
    """Cut before the first window with k characters at most `a`; emptied reads are dropped."""
    end = window_end(by, k, a, halfwidth)
    return ranges(reads, 1, end) if as_ranges else cut(reads, 1, end)


def trim_ends(reads: DataFrame, a: str, left: bool = True, right: bool = True, relation: str = "<=", as_ranges: bool = False, by: str = "qual") -> DataFrame:
    """Strip characters from the ends, by quality or by the letters of the reads; emptied reads stay."""
    start, end = end_bounds(by, a, left, right, relation, DNA if by == "sread" else None)
    return ranges(reads, start, end) if as_ranges else cut(reads, start, end, drop_empty=False)


def allowed_mismatches(allowed, n: int) -> list[int]:
    """How many mismatches an overlap of 1, 2, ... n letters may have: by a rate, or a list for the longest overlaps."""
    if isinstance(allowed, (int, float)) and 0 <= allowed < 1:
        return [int(allowed * i) for i in range(1, n + 1)]
    given = [int(x) for x in (allowed if hasattr(allowed, "__len__") else [allowed])]
    return ([-1] * (n - len(given)) + given)[-n:]


def adapter_bounds(c, left: str = "", right: str = "", left_allowed=0, right_allowed=0, left_fixed: bool = True, right_fixed: bool = True, left_indels: bool = False, right_indels: bool = False) -> tuple[Column, Column]:
    """First and last place kept when the longest matching end of `left` is cut from the start, and beginning of `right`
    from the end.  Where a side is not fixed, ambiguity letters match what they may stand for; where it has indels, what is
    allowed are edits between the adapter's part and the read's beginning or end."""
    c = F.col(c) if isinstance(c, str) else c
    start = 1 + _overlap(left, allowed_mismatches(left_allowed, len(left)), True, left_fixed, left_indels)(c) if left else F.lit(1)
    end = F.length(c) - _overlap(right, allowed_mismatches(right_allowed, len(right)), False, right_fixed, right_indels)(c) if right else F.length(c)
    return start, end


def _edits(x: np.ndarray, size: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Least number of edits between a pattern and any beginning of each read; differ[k] tells where its k-th letter
    differs from the letters of the reads (rows of x)."""
    row = np.tile(np.arange(x.shape[1] + 1), (len(x), 1))
    for k, other in enumerate(differ, 1):
        now = np.empty_like(row)
        now[:, 0] = k
        for i in range(1, row.shape[1]):
            now[:, i] = np.minimum(np.minimum(now[:, i - 1], row[:, i]) + 1, row[:, i - 1] + other[:, i - 1])
        row = now
    return np.where(np.arange(row.shape[1])[None, :] <= size[:, None], row, len(differ) + x.shape[1] + 1).min(axis=1)


def _possible() -> np.ndarray:
    """For each character the bits of the bases that it may stand for; none for other characters, which match nothing."""
    bits = np.zeros(256, dtype=np.int64)
    for letter, bases in IUPAC.items():
        bits[ord(letter)] = sum(1 << "ACGT".index(b) for b in bases)
    return bits


def _overlap(pattern: str, allowed: list[int], at_start: bool, fixed: bool = True, indels: bool = False):
    n = len(pattern)
    reach = n + max(allowed) if indels else n
    code = np.frombuffer(pattern.encode(), dtype=np.uint8)
    possible = _possible()

    @F.pandas_udf("int")
    def overlap(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for reads in batches:
            text = reads.fillna("")
            size = text.str.len().to_numpy(dtype=int)
            edge = [(s[:reach].ljust(reach, "\0") if at_start else s[-reach:].rjust(reach, "\0")).encode("ascii", "replace") for s in text]
            x = np.frombuffer(b"".join(edge), dtype=np.uint8).reshape(len(edge), reach)
            best = np.zeros(len(edge), dtype=np.int32)
            unlike = (lambda part, own: part != own) if fixed else (lambda part, own: (possible[part] & possible[own]) == 0)
            for j in range(1, n + 1):
                own = code[n - j :] if at_start else code[:j]
                if indels and allowed[j - 1] >= 0:
                    # From the read's edge inwards: the end of a read is compared backwards.
                    part, letters = (x, own) if at_start else (x[:, ::-1], own[::-1])
                    near = _edits(part[:, : j + allowed[j - 1]], size, np.array([unlike(part[:, : j + allowed[j - 1]], c) for c in letters])) <= allowed[j - 1]
                    best[near] = np.minimum(j, size[near])
                elif not indels:
                    misses = unlike(x[:, :j] if at_start else x[:, n - j :], own)
                    best[(misses.sum(axis=1) <= allowed[j - 1]) & (size >= j)] = j
            yield pd.Series(best).where(reads.notna().to_numpy())

    return overlap


def trim_adapters(reads: DataFrame, left: str = "", right: str = "", left_allowed=0, right_allowed=0, as_ranges: bool = False, **options) -> DataFrame:
    """Remove adapters from the ends of reads; emptied reads stay.  Options are those of adapter_bounds()."""
    start, end = adapter_bounds("sread", left, right, left_allowed, right_allowed, **options)
    return ranges(reads, start, end) if as_ranges else cut(reads, start, end, drop_empty=False)
