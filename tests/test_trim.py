"""Trimming, on hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.errors import ArgumentMismatch
from strandmill.functions import trim as T


def table(spark, quals, reads=None):
    return spark.createDataFrame([(i, (reads or quals)[i], q) for i, q in enumerate(quals)], "row_ix bigint, sread string, qual string")


def kept(df):
    return [r.qual for r in df.orderBy("row_ix").collect()]


@pytest.mark.parametrize("qual, k, a, successive, expected", [
    ("CCCBBBAAA", 1, "A", False, ["CCCBBB"]), ("CCCABBBAAA", 2, "A", False, ["CCCABBB"]), ("CCCABBBABAA", 2, "A", True, ["CCCABBBAB"]),
    ("CCCABBBABAA", 2, "B", True, ["CCC"]), ("CCCABBBABAA", 1, "C", False, []),
])
def test_tails(spark, qual, k, a, successive, expected):
    assert kept(T.trim_tails(table(spark, [qual]), k, a, successive)) == expected


def window_by_hand(q, k, a, h):
    """The running count as a loop: seeded at the first cycle, updated before each test."""
    if not q:
        return 0
    m = [c <= a for c in q]
    n = (h + 1) * m[0] + sum(m[min(len(q) - 1, j)] for j in range(1, h + 1))
    for j in range(len(q)):
        n += m[min(len(q) - 1, j + h)] - m[max(0, j - h)]
        if n >= k:
            return j
    return len(q)


def test_window(spark):
    assert kept(T.trim_window(table(spark, ["DDDBDBBBB"]), 4, "C", 2)) == ["DDDBDB"]
    rnd = random.Random(5)
    quals = ["".join(rnd.choice("ABCD") for _ in range(rnd.randint(0, 15))) for _ in range(300)]
    for k, h in ((2, 1), (4, 2), (3, 5)):
        got = [r.end for r in T.trim_window(table(spark, quals), k, "B", h, as_ranges=True).orderBy("row_ix").collect()]
        assert got == [window_by_hand(q, k, "B", h) for q in quals]


def test_ends(spark):
    df = table(spark, ["AABCBAA", "AAA", "", "BCB"])
    assert kept(T.trim_ends(df, "A")) == ["BCB", "", "", "BCB"]
    assert kept(T.trim_ends(df, "A", right=False)) == ["BCBAA", "", "", "BCB"]
    assert kept(T.trim_ends(df, "A", left=False)) == ["AABCB", "", "", "BCB"]
    assert kept(T.trim_ends(df, "B", relation="==")) == ["AABCBAA", "AAA", "", "C"]
    assert kept(T.trim_ends(table(spark, ["]^[-\\"]), "]", relation="==")) == ["^[-\\"]


def test_arguments(spark):
    df = table(spark, ["ABC"])
    assert kept(T.trim_tails(df, 0, "A")) == []
    for call in (lambda: T.trim_tails(df, 0, "A", successive=True), lambda: T.trim_tails(df, -1, "A"), lambda: T.trim_tails(df, 1, "AB"), lambda: T.trim_window(df, 1, "A", 0)):
        with pytest.raises(ArgumentMismatch):
            call()


def test_adapters(spark):
    reads = ["ACGTTTTT", "CGTTTTTT", "GGGGGACG", "TTTT", "ACGT", ""]
    df = table(spark, ["I" * len(r) for r in reads], reads)
    out = {r.row_ix: r.sread for r in T.trim_adapters(df, left="ACGT").collect()}
    assert out == {0: "TTTT", 1: "TTTTT", 2: "GGGGGACG", 3: "TTT", 4: "", 5: ""}
    out = {r.row_ix: r.sread for r in T.trim_adapters(df, right="ACGT").collect()}
    assert out == {0: "ACGTTTTT", 1: "CGTTTTTT", 2: "GGGGG", 3: "TTTT", 4: "", 5: ""}
    assert T.allowed_mismatches(0.25, 8) == [0, 0, 0, 1, 1, 1, 1, 2]
    assert T.allowed_mismatches([0, 1], 4) == [-1, -1, 0, 1]


def test_nulls(spark):
    df = spark.createDataFrame([(1, None, None)], "row_ix bigint, sread string, qual string")
    assert df.select(T.tail_end("qual", 1, "A").alias("x"), F.lit(1)).first().x is None
    assert T.trim_tails(df, 1, "A").count() == 0


def test_ambiguous_adapters(spark):
    """Without fixed letters, N and the like in the adapter or the read match what they may stand for."""
    df = spark.createDataFrame([(1, "ACGTTTT", "IIIIIII"), (2, "NCGTTTT", "IIIIIII"), (3, "TTTTGAN", "IIIIIII"), (4, "", "")], "row_ix bigint, sread string, qual string")
    got = {r.row_ix: (r.start, r.end) for r in T.trim_adapters(df, "ANG", "GAC", as_ranges=True, left_fixed=False, right_fixed=False).collect()}
    assert got == {1: (4, 7), 2: (4, 7), 3: (1, 4), 4: (1, 0)}
    got = {r.row_ix: (r.start, r.end) for r in T.trim_adapters(df, "ANG", "GAC", as_ranges=True).collect()}
    assert got == {1: (1, 7), 2: (1, 7), 3: (1, 7), 4: (1, 0)}


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_adapters_with_indels(spark):
    rnd = random.Random(3)
    reads = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 14))) for _ in range(60)] + ["ACGTTTTTT", "ACTTTTTT", "AACGTTTTT", "TTTTGGC", "TTTTGC"]
    df = table(spark, ["I" * len(s) for s in reads], reads)
    left, right, allowed = "GACG", "GGCA", [0, 1, 1, 2]
    got = {r.row_ix: (r.start, r.end) for r in T.trim_adapters(df, left, right, allowed, allowed, as_ranges=True, left_indels=True, right_indels=True).collect()}
    for i, s in enumerate(reads):
        head = max([j for j in range(1, 5) if min(plain_edits(left[4 - j :], s[:k]) for k in range(len(s) + 1)) <= allowed[j - 1]], default=0)
        tail = max([j for j in range(1, 5) if min(plain_edits(right[:j], s[len(s) - k :]) for k in range(len(s) + 1)) <= allowed[j - 1]], default=0)
        assert got[i] == (1 + min(head, len(s)), len(s) - min(tail, len(s))), s
