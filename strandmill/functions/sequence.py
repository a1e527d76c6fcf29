"""Columns computed from sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentMismatch

#: Ambiguity letters, what they stand for, and their complements.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}
PAIRED = ("ACGTMRWSYKVHDBN", "TGCAKYWSRMBDHVN")


def letters(c) -> Column:
    """The characters of a string; none for an empty one, which split() would give one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def narrow(c, start=1, end=None, width=None) -> Column:
    """The part from start to end, both counted from 1 and included, or of a width."""
    c = F.col(c) if isinstance(c, str) else c
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    if width is None:
        width = (F.length(c) if end is None else lit(end)) - lit(start) + 1
    return F.substring(c, lit(start).cast("int"), lit(width).cast("int"))


def reverse_complement(c) -> Column:
    return F.reverse(F.translate(c, *PAIRED))


def letter_count(c, letter: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.length(c) - F.length(F.translate(c, letter, ""))


def other_count(c) -> Column:
    """Letters besides A, C, G and T."""
    c = F.col(c) if isinstance(c, str) else c
    return F.length(F.translate(c, "ACGT", ""))


def letter_frequency(c, alphabet: str = "ACGT", other: bool = True) -> list[Column]:
    """A count for each letter of the alphabet, then of all others."""
    c = F.col(c) if isinstance(c, str) else c
    out = [letter_count(c, x).alias(x) for x in alphabet]
    return out + [F.length(F.translate(c, alphabet, "")).alias("other")] * other


def most_frequent_letter(c, among: str = "ACTG", other: bool = True) -> Column:
    """The largest of the letters' counts."""
    counts = letter_frequency(c, among, other)
    return F.greatest(*counts) if len(counts) > 1 else counts[0]


def dusty_score(c) -> Column:
    """Low complexity: over triplets of A, C, G and T, the sum of squares of each one's repeats beyond the first."""

    @F.pandas_udf("bigint")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        code = np.full(256, 64, dtype=np.int64)
        code[list(b"ACGT")] = range(4)
        for reads in batches:
            out = np.zeros(len(reads), dtype=np.int64)
            # Reads are joined with a letter that is none, and counted in steps whose tables of 64 triplets are small.
            for at in range(0, len(reads), 4096):
                text = reads.iloc[at : at + 4096].fillna("")
                raw = "-".join([*text, "--"]).encode("ascii", "replace")
                c = code[np.frombuffer(raw, dtype=np.uint8)]
                size = text.str.len().to_numpy(dtype=np.int64) + 1
                owner = np.repeat(np.arange(len(text)), size)
                triplet = c[: len(owner)] * 16 + c[1 : len(owner) + 1] * 4 + c[2 : len(owner) + 2]
                known = np.maximum(np.maximum(c[: len(owner)], c[1 : len(owner) + 1]), c[2 : len(owner) + 2]) < 4
                counts = np.bincount(owner[known] * 64 + triplet[known], minlength=64 * len(text)).reshape(-1, 64)
                out[at : at + len(text)] = (np.maximum(counts - 1, 0) ** 2).sum(axis=1)
            yield pd.Series(out).where(reads.notna().to_numpy()).astype("Int64")

    return score(F.col(c) if isinstance(c, str) else c)


def polyn(nucleotides: str, n: int) -> dict[str, str]:
    """Each letter repeated n times."""
    if any(len(x) != 1 for x in nucleotides):
        raise ArgumentMismatch("'nucleotides' must be single letters")
    return {x: x * n for x in nucleotides}


def edit_distance(c, subject: str) -> Column:
    """Global edit distance to a subject, whose ambiguity letters cost what they miss on average."""
    if set(subject) <= set("ACGT"):
        plain = F.levenshtein(c, F.lit(subject)).cast("double")
        return F.when(other_count(c) == 0, plain).otherwise(_ambiguous_distance(subject)(c))
    return _ambiguous_distance(subject)(c)


def mismatch_table(alphabet: str) -> np.ndarray:
    """Costs of putting one letter for another: the share of their possible bases that differ."""
    share = np.array([[(b in IUPAC.get(x, x)) / len(IUPAC.get(x, x)) for b in "ACGT"] for x in alphabet])
    return 1 - share @ share.T


def _ambiguous_distance(subject: str):
    alphabet = "".join(IUPAC)
    costs = mismatch_table(alphabet)
    place = {x: i for i, x in enumerate(alphabet)}

    @F.pandas_udf("double")
    def distance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = np.array([place.get(x, -1) for x in subject])
        for reads in batches:
            width = int(reads.fillna("").str.len().max() or 0) if len(reads) else 0
            code = np.full((len(reads), width), -1)
            for i, r in enumerate(reads.fillna("")):
                code[i, : len(r)] = [place.get(x, -1) for x in r]
            size = reads.fillna("").str.len().to_numpy(dtype=int)
            # Rows of all reads' tables at once; letters outside the alphabet match nothing.
            row = np.tile(np.arange(len(s) + 1, dtype=float), (len(reads), 1))
            out = np.where(size == 0, float(len(s)), np.nan)
            for i in range(width):
                now = np.empty_like(row)
                now[:, 0] = i + 1
                for j in range(len(s)):
                    known = (code[:, i] >= 0) & (s[j] >= 0)
                    swap = np.where(known, costs[np.maximum(code[:, i], 0), max(s[j], 0)], 1.0)
                    now[:, j + 1] = np.minimum(np.minimum(now[:, j], row[:, j + 1]) + 1, row[:, j] + swap)
                row = now
                out = np.where(size == i + 1, row[:, -1], out)
            yield pd.Series(out).where(reads.notna().to_numpy())

    return distance
