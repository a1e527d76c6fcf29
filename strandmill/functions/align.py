"""Pairwise alignment of reads with a subject, by affine gap scores, for a batch of reads at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentMismatch, one_of
from .quality import offset

KINDS = ("global", "local", "overlap")


def quality_scores(error: np.ndarray, subject_error: float = 10 ** (-22 / 10), letters: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds in bits of equal and of different letters, by the chance that either of the two is wrong."""
    either = error + subject_error - letters / (letters - 1) * error * subject_error
    either = np.clip(either, 1e-12, 1 - 1 / letters)
    return np.log2(letters * (1 - either)), np.log2(letters / (letters - 1) * either)


def aligned_scores(codes: np.ndarray, sizes: np.ndarray, subject: np.ndarray, equal: np.ndarray, other: np.ndarray, kind: str, opening: float, extension: float) -> np.ndarray:
    """Scores of reads (rows of codes, padded) with a subject; equal and other are scores for each letter of each read.

    One row of all reads' tables is held at a time.  A gap of n letters costs opening + n * extension.
    """
    reads, width, n = len(codes), codes.shape[1], len(subject)
    free = kind != "global"
    gap = lambda k: -(opening + extension * k)
    best = np.zeros((reads, n + 1)) if free else np.tile(np.array([0.0, *(gap(k) for k in range(1, n + 1))]), (reads, 1))
    down = np.full((reads, n + 1), -np.inf)
    top = np.zeros(reads) if kind == "local" else np.full(reads, -np.inf)
    last = np.where(sizes == 0, best[:, -1] if not free else 0.0, -np.inf)
    for i in range(width):
        now = np.empty_like(best)
        now[:, 0] = 0.0 if free else gap(i + 1)
        down = np.maximum(down, best - opening) - extension
        across = np.full(reads, -np.inf)
        here = i < sizes
        for j in range(1, n + 1):
            across = np.maximum(across, now[:, j - 1] - opening) - extension
            score = best[:, j - 1] + np.where(codes[:, i] == subject[j - 1], equal[:, i], other[:, i])
            score = np.maximum(np.maximum(score, down[:, j]), across)
            now[:, j] = np.maximum(score, 0) if kind == "local" else score
        if kind == "local":
            top = np.where(here, np.maximum(top, now.max(axis=1)), top)
        elif kind == "overlap":
            # Ends of either side are free: the read's end anywhere, or the subject's end at any letter of the read.
            top = np.where(here, np.maximum(top, now[:, -1]), top)
            top = np.where(sizes == i + 1, np.maximum(top, now.max(axis=1)), top)
        last = np.where(sizes == i + 1, now[:, -1], last)
        best = now
    return last if kind == "global" else np.where(sizes == 0, 0.0, top)


def alignment_score(sread, subject: str, qual=None, kind: str = "global", opening: float = 10, extension: float = 4, match: float | None = None, mismatch: float | None = None, encoding: str = "phred33") -> Column:
    """Score of each read's best alignment with a subject: global, local or overlap (free ends).

    Letters score by the reads' qualities (without qualities, as of quality 22), or by match and mismatch if these are given.
    """
    one_of(kind, KINDS, "kind")
    if (match is None) != (mismatch is None):
        raise ArgumentMismatch("'match' and 'mismatch' belong together")
    code, zero = np.frombuffer(subject.encode(), dtype=np.uint8), offset(encoding)

    def scores(reads: pd.Series, quals: pd.Series | None) -> pd.Series:
        text = reads.fillna("")
        sizes = text.str.len().to_numpy(dtype=int)
        width = int(sizes.max(initial=0))
        table = lambda s: np.frombuffer(b"".join(x.encode("ascii", "replace")[:width].ljust(width, b"\0") for x in s), dtype=np.uint8).reshape(len(s), width)
        if match is not None:
            equal, other = np.full((len(text), width), float(match)), np.full((len(text), width), float(mismatch))
        else:
            q = np.full((len(text), width), 22.0) if quals is None else np.maximum(table(quals.fillna("")).astype(float) - zero, 0)
            equal, other = quality_scores(10 ** (-q / 10))
        out = aligned_scores(table(text), sizes, code, equal, other, kind, opening, extension)
        return pd.Series(out).where(reads.notna().to_numpy())

    @F.pandas_udf("double")
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for reads in batches:
            yield scores(reads, None)

    @F.pandas_udf("double")
    def graded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for reads, quals in batches:
            yield scores(reads, quals)

    return plain(sread) if qual is None or match is not None else graded(sread, qual)


def pairwise_alignment(reads: DataFrame, subject: str, **options) -> DataFrame:
    """row_ix and score of each read; qualities are used where the table has them."""
    qual = "qual" if "qual" in reads.columns else None
    return reads.select("row_ix", alignment_score("sread", subject, qual, **options).alias("score"))


#: What a step of an alignment takes: a letter of both, of the read alone, of the subject alone.
BOTH, READ, SUBJECT = 0, 1, 2
_END = 3
#: Bytes of the tables that are kept for a block of reads.
KEPT = 64 << 20


def traced(codes: np.ndarray, sizes: np.ndarray, subject: np.ndarray, equal: np.ndarray, other: np.ndarray, kind: str, opening: float, extension: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of a block of reads as aligned_scores() has them, and how they come about: steps (a row for each step back from
    the end, a column for each read, _END where a read has none), and the letters of read and subject before the first.

    A byte for each cell tells where its score came from (two bits) and whether the gaps that end there go on (a bit each).
    """
    reads, width, n = len(codes), codes.shape[1], len(subject)
    free = kind != "global"
    gap = lambda k: -(opening + extension * k)
    best = np.zeros((reads, n + 1)) if free else np.tile(np.array([0.0, *(gap(k) for k in range(1, n + 1))]), (reads, 1))
    down = np.full((reads, n + 1), -np.inf)
    came = np.full((width + 1, reads, n + 1), _END, dtype=np.uint8)
    if not free:
        came[0, :, 1:] = SUBJECT
        came[1:, :, 0] = READ
        came[0, :, 2:] |= 8
        came[2:, :, 0] |= 4
    rows = np.arange(reads)
    at_i, at_j = sizes.copy(), np.full(reads, n)
    top = np.zeros(reads) if kind == "local" else np.full(reads, -np.inf)
    score = np.where(sizes == 0, 0.0 if free else best[:, -1], -np.inf)
    for i in range(width):
        now = np.empty_like(best)
        now[:, 0] = 0.0 if free else gap(i + 1)
        longer = down > best - opening
        down = np.maximum(down, best - opening) - extension
        across = np.full(reads, -np.inf)
        step = came[i + 1]
        step[:, 1:] = longer[:, 1:] * np.uint8(4)
        for j in range(1, n + 1):
            opened = now[:, j - 1] - opening
            step[:, j] |= (across > opened) * np.uint8(8)
            across = np.maximum(across, opened) - extension
            both = best[:, j - 1] + np.where(codes[:, i] == subject[j - 1], equal[:, i], other[:, i])
            most = np.maximum(np.maximum(both, down[:, j]), across)
            from_ = np.where(both >= most, BOTH, np.where(down[:, j] >= most, READ, SUBJECT)).astype(np.uint8)
            if kind == "local":
                from_ = np.where(most <= 0, np.uint8(_END), from_)
                most = np.maximum(most, 0)
            step[:, j] |= from_
            now[:, j] = most
        here = i < sizes
        if kind == "local":
            k = now.argmax(axis=1)
            better = here & (now[rows, k] > top)
            top, at_i, at_j = np.where(better, now[rows, k], top), np.where(better, i + 1, at_i), np.where(better, k, at_j)
        elif kind == "overlap":
            better = here & (now[:, -1] > top)
            top, at_i, at_j = np.where(better, now[:, -1], top), np.where(better, i + 1, at_i), np.where(better, n, at_j)
            k = now.argmax(axis=1)
            better = (sizes == i + 1) & (now[rows, k] > top)
            top, at_i, at_j = np.where(better, now[rows, k], top), np.where(better, i + 1, at_i), np.where(better, k, at_j)
        else:
            score = np.where(sizes == i + 1, now[:, -1], score)
        best = now
    if free:
        score = np.where(sizes == 0, 0.0, top)
        nothing = (sizes == 0) | (kind == "local") & (top <= 0)
        at_i, at_j = np.where(nothing, 0, at_i), np.where(nothing, 0, at_j)
    steps, state = [], np.full(reads, BOTH)
    going = (at_i > 0) | (at_j > 0) if not free else (at_i > 0) & (at_j > 0)
    while going.any():
        cell = came[at_i, rows, at_j]
        # In no gap, the cell tells where its score came from; in one, whether the gap goes on.
        op = np.where(state == BOTH, cell & 3, state)
        going &= op != _END
        op = np.where(going, op, _END)
        steps.append(op.astype(np.uint8))
        more = np.where(op == READ, cell & 4, np.where(op == SUBJECT, cell & 8, 0)) > 0
        state = np.where(more, op, BOTH)
        at_i, at_j = at_i - ((op == BOTH) | (op == READ)), at_j - ((op == BOTH) | (op == SUBJECT))
        going &= ((at_i > 0) | (at_j > 0)) if not free else (at_i > 0) & (at_j > 0)
    return score, np.array(steps, dtype=np.uint8).reshape(-1, reads), at_i, at_j


_ALIGNED = "score double, read_start int, read_width int, subject_start int, subject_width int, aligned_read string, aligned_subject string, mismatches int, insertions int, deletions int, cigar string"


def _drawn(read: str, subject: str, steps: np.ndarray, before: int, left: int) -> tuple:
    """Columns of one alignment: steps from its first, and the letters before it."""
    ops = steps[steps != _END][::-1]
    of_read, of_subject = ops != SUBJECT, ops != READ
    n, m = int(of_read.sum()), int(of_subject.sum())
    top, low = (np.full(len(ops), ord("-"), dtype=np.uint8) for _ in range(2))
    top[of_read] = np.frombuffer(read[before : before + n].encode("ascii", "replace"), dtype=np.uint8)
    low[of_subject] = np.frombuffer(subject[left : left + m].encode("ascii", "replace"), dtype=np.uint8)
    cuts = np.r_[0, np.flatnonzero(np.diff(ops)) + 1, len(ops)] if len(ops) else np.array([0])
    body = "".join(f"{b - a}{'MID'[ops[a]]}" for a, b in zip(cuts, cuts[1:]))
    ends = [f"{k}S" if k else "" for k in (before, len(read) - before - n)] if len(ops) else ["", ""]
    wrong = int(((ops == BOTH) & (top != low)).sum())
    return before + 1, n, left + 1, m, top.tobytes().decode(), low.tobytes().decode(), wrong, int((ops == READ).sum()), int((ops == SUBJECT).sum()), f"{ends[0]}{body}{ends[1]}"


def alignments(reads: DataFrame, subject: str, kind: str = "global", opening: float = 10, extension: float = 4, match: float | None = None, mismatch: float | None = None, encoding: str = "phred33") -> DataFrame:
    """The reads table with each read's best alignment with a subject: score, where it starts and how wide it is in read and
    subject, both with gaps as dashes, mismatches, insertions (letters of the read alone), deletions and a CIGAR against the
    subject.  Of equal scores a letter of both comes before a gap in the subject, and that before one in the read."""
    one_of(kind, KINDS, "kind")
    if (match is None) != (mismatch is None):
        raise ArgumentMismatch("'match' and 'mismatch' belong together")
    graded = match is None and "qual" in reads.columns
    code, zero, names = np.frombuffer(subject.encode(), dtype=np.uint8), offset(encoding), [c.split()[0] for c in _ALIGNED.split(", ")]

    def block(f: pd.DataFrame) -> pd.DataFrame:
        text = f["sread"].fillna("")
        sizes = text.str.len().to_numpy(dtype=int)
        width = int(sizes.max(initial=0))
        table = lambda s: np.frombuffer(b"".join(x.encode("ascii", "replace")[:width].ljust(width, b"\0") for x in s), dtype=np.uint8).reshape(len(s), width)
        if match is not None:
            equal, other = np.full((len(text), width), float(match)), np.full((len(text), width), float(mismatch))
        else:
            q = np.maximum(table(f["qual"].fillna("")).astype(float) - zero, 0) if graded else np.full((len(text), width), 22.0)
            equal, other = quality_scores(10 ** (-q / 10))
        score, steps, before, left = traced(table(text), sizes, code, equal, other, kind, opening, extension)
        out = [_drawn(t, subject, steps[:, k], int(before[k]), int(left[k])) for k, t in enumerate(text)]
        found = pd.DataFrame(out, columns=names[1:], index=f.index)
        found.insert(0, "score", score)
        found = found.astype("object")
        found[f["sread"].isna().to_numpy()] = None
        return pd.concat([f, found], axis=1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # Reads of like width share a block, so that one wide read does not widen the tables of all.
            order = f["sread"].fillna("").str.len().to_numpy(dtype=int)
            f = f.iloc[np.argsort(order, kind="stable")].reset_index(drop=True)
            order = np.sort(order)
            at = 0
            while at < len(f):
                size = 1
                while at + size < len(f) and (size + 1) * (order[at + size] + 1) * (len(subject) + 1) <= KEPT and size < 4096:
                    size += 1
                yield block(f.iloc[at : at + size].reset_index(drop=True))
                at += size

    return reads.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in reads.dtypes) + ", " + _ALIGNED)


def as_alignments(aligned: DataFrame) -> DataFrame:
    """Alignments as reads that are placed: position is where they start in the subject, align_quality their score."""
    known = [c for c in ("file", "row_ix", "id", "sread", "qual") if c in aligned.columns]
    none = [F.lit(None).cast("string").alias(c) for c in ("chromosome", "strand")]
    return aligned.select(*known, none[0], F.col("subject_start").alias("position"), none[1], F.col("score").alias("align_quality"), "cigar")
