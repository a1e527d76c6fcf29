"""Alignments with their strings, places and edits, against tables in full."""

import random
import re

import pytest
from test_functions import plain_alignment

from strandmill.errors import ArgumentMismatch
from strandmill.functions.align import alignments, as_alignments

SUBJECT = "ACGTTGCAAC"


def rescored(r, kind, match, mismatch, opening, extension):
    """The score that an alignment has by its own strings."""
    total, before = 0.0, None
    for a, b in zip(r.aligned_read, r.aligned_subject):
        now = "read" if b == "-" else "subject" if a == "-" else None
        if now is None:
            total += match if a == b else mismatch
        else:
            total -= extension + (opening if now != before else 0)
        before = now
    return total


@pytest.mark.parametrize("kind", ["global", "local", "overlap"])
@pytest.mark.parametrize("costs", [(2, -1, 3, 1), (1, -3, 0, 1), (5, -4, 10, 4)])
def test_alignments(spark, kind, costs):
    rnd = random.Random(3)
    reads = ["".join(rnd.choice("ACGTN") for _ in range(rnd.randint(0, 14))) for _ in range(80)] + [SUBJECT, SUBJECT[:4] + SUBJECT[6:], SUBJECT[:5] + "GG" + SUBJECT[5:], "TT" + SUBJECT]
    df = spark.createDataFrame([(i, f"r{i}", s, "x") for i, s in enumerate(reads)] + [(999, "none", None, "x")], "row_ix bigint, id string, sread string, other string")
    match, mismatch, opening, extension = costs
    got = {r.row_ix: r for r in alignments(df, SUBJECT, kind, opening, extension, match, mismatch).collect()}
    assert got[999].score is None and got[999].cigar is None and got[999].other == "x"
    for i, s in enumerate(reads):
        r = got[i]
        assert abs(r.score - plain_alignment(s, SUBJECT, match, mismatch, kind, opening, extension)) < 1e-9, (kind, s)
        assert abs(rescored(r, *((kind,) + costs)) - r.score) < 1e-9, (kind, s, r)
        assert r.aligned_read.replace("-", "") == s[r.read_start - 1 : r.read_start - 1 + r.read_width]
        assert r.aligned_subject.replace("-", "") == SUBJECT[r.subject_start - 1 : r.subject_start - 1 + r.subject_width]
        assert (r.insertions, r.deletions) == (r.aligned_subject.count("-"), r.aligned_read.count("-"))
        assert r.mismatches == sum(a != b and "-" not in (a, b) for a, b in zip(r.aligned_read, r.aligned_subject))
        ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDS])", r.cigar)]
        if r.aligned_read:
            assert sum(n for n, op in ops if op in "MIS") == len(s) and sum(n for n, op in ops if op in "MD") == r.subject_width
        if kind == "global":
            assert (r.read_width, r.subject_width) == (len(s), len(SUBJECT))
        if kind == "overlap" and s:
            ends = r.read_start - 1 == 0 or r.subject_start - 1 == 0, r.read_start - 1 + r.read_width == len(s) or r.subject_start - 1 + r.subject_width == len(SUBJECT)
            assert all(ends)


def test_known_alignments(spark):
    df = spark.createDataFrame([(1, "a", "ACGTCA", "IIIIII"), (2, "b", "TTACGTGGCAACTT", "I" * 14)], "row_ix bigint, id string, sread string, qual string")
    whole = alignments(df, "ACGTTCA", opening=3, extension=1, match=2, mismatch=-2).orderBy("row_ix").first()
    assert whole.aligned_read.replace("-", "") == "ACGTCA" and (whole.deletions, whole.insertions, whole.mismatches) == (1, 0, 0) and whole.cigar in ("3M1D3M", "4M1D2M")
    rows = alignments(df, SUBJECT, "local").orderBy("row_ix").collect()
    assert rows[1].cigar == "2S10M2S" and rows[1].subject_start == 1 and rows[1].mismatches == 1
    placed = as_alignments(alignments(df, SUBJECT, "local")).orderBy("row_ix").collect()
    assert (placed[1].position, placed[1].id, placed[1].chromosome) == (1, "b", None) and placed[1].align_quality == rows[1].score
    with pytest.raises(ArgumentMismatch):
        alignments(df, SUBJECT, match=1)
    assert alignments(df.where("false"), SUBJECT).count() == 0
