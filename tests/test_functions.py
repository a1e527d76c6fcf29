"""Column functions, on hand-made cases and against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.errors import ArgumentMismatch, IncompatibleTypes, ReadsError, ReadsWarning, ValidityError
from strandmill.functions import quality as Q
from strandmill.functions.align import pairwise_alignment, quality_scores
from strandmill.functions import sequence as S
from strandmill.schema import as_reads, detail, labelled, labels_of, renew, renewable, validated


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_ix bigint, s {kind}")


def test_letters_of_empty(spark):
    assert [r.x for r in column(spark, ["", "AC"]).select(S.letters("s").alias("x")).collect()] == [[], ["A", "C"]]


def test_reverse_complement(spark):
    assert column(spark, ["ACGTMRWSYKVHDBN"]).select(S.reverse_complement("s").alias("x")).first().x == "NVHDBMRSWYKACGT"


def test_narrow(spark):
    df = column(spark, ["ABCDEF"])
    assert [df.select(c.alias("x")).first().x for c in (S.narrow("s", 2, 4), S.narrow("s", 3), S.narrow("s", 2, width=2))] == ["BCD", "CDEF", "BC"]


def test_dusty(spark):
    rnd = random.Random(1)
    reads = ["", "AC", "AAAAAA", *("".join(rnd.choice("AACGTN") for _ in range(rnd.randint(0, 40))) for _ in range(100))]

    def score(s):
        t = Counter(s[i : i + 3] for i in range(len(s) - 2))
        return sum((n - 1) ** 2 for k, n in t.items() if set(k) <= set("ACGT"))

    assert [r.x for r in column(spark, reads).orderBy("row_ix").select(S.dusty_score("s").alias("x")).collect()] == [score(s) for s in reads]


def test_edit_distance(spark):
    df = column(spark, ["ACGT", "ACG", "ACGA", "", None, "ACGN"])
    assert [r.x for r in df.orderBy("row_ix").select(S.edit_distance(F.col("s"), "ACGT").alias("x")).collect()] == [0, 1, 1, 4, None, 0.75]
    assert [r.x for r in df.orderBy("row_ix").select(S.edit_distance(F.col("s"), "ACGR").alias("x")).collect()][:3] == [1, 1, 0.5]


def test_quality(spark):
    df = column(spark, ["]]X", "]]]X"])
    wide = Q.wide_scores(df.withColumnRenamed("s", "qual"), 4).orderBy("row_ix").collect()
    assert [tuple(r)[1:] for r in wide] == [(60, 60, 55, None), (60, 60, 60, 55)]
    assert [r.x for r in df.orderBy("row_ix").select(Q.quality_sum("s").alias("x")).collect()] == [175.0, 235.0]
    assert df.select(Q.table_score("s", {"]": 2}).alias("x")).orderBy("x").first().x == 4.0
    for text, encoding in ((";J", "phred33"), (";K", "phred64"), ("", "phred33")):
        assert Q.infer_encoding(column(spark, [text]).withColumnRenamed("s", "qual")) == encoding
    assert Q.encoding_table("phred33")["!"] == 0 and Q.encoding_table("phred33")["~"] == 93
    assert column(spark, ["!I"]).select(Q.recoded("s", "phred33", "phred64").alias("x")).first().x == "@h"


def test_polyn():
    assert S.polyn("AC", 3) == {"A": "AAA", "C": "CCC"}
    with pytest.raises(ArgumentMismatch):
        S.polyn(["AC"], 3)


def test_schema(spark):
    df = spark.createDataFrame([(1, "a", "acgt", "IIII")], "row_ix bigint, id string, sread string, qual string")
    reads = as_reads(df)
    assert validated(reads).first().sread == "ACGT" and detail(reads)["width"] == (4, 4)
    with pytest.raises(ValidityError):
        renew(reads, qual="II")
    with pytest.raises(IncompatibleTypes):
        renew(reads, nothing=1)
    assert renew(reads, id="b").first().id == "b" and renewable(reads)["sread"] == "string"
    assert labels_of(labelled(reads, id="name")) == {"id": "name"}


def test_errors():
    assert issubclass(ValidityError, ReadsError) and ValidityError("x").kind == "ValidityError"
    with pytest.raises(ValueError):
        ReadsError("x", "no kind")
    with pytest.raises(ValueError):
        ReadsWarning("x", "no kind")


def plain_alignment(read, subject, equal, other, kind, opening, extension):
    """All three tables in full."""
    import math

    low, n, m = -math.inf, len(read), len(subject)
    free = kind != "global"
    best = [[low] * (m + 1) for _ in range(n + 1)]
    up, side = [[low] * (m + 1) for _ in range(n + 1)], [[low] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 or j == 0:
                k = i + j
                best[i][j] = 0.0 if free or k == 0 else -(opening + extension * k)
                continue
            up[i][j] = max(up[i - 1][j], best[i - 1][j] - opening) - extension
            side[i][j] = max(side[i][j - 1], best[i][j - 1] - opening) - extension
            best[i][j] = max(best[i - 1][j - 1] + (equal if read[i - 1] == subject[j - 1] else other), up[i][j], side[i][j])
            if kind == "local":
                best[i][j] = max(best[i][j], 0.0)
    if kind == "global":
        return best[n][m]
    if kind == "local":
        return max(map(max, best))
    return max([*best[n], *(row[m] for row in best)]) if n else 0.0


def test_pairwise_alignment(spark):
    rnd = random.Random(2)
    reads = ["".join(rnd.choice("ACGTN") for _ in range(rnd.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i, s, "I" * len(s)) for i, s in enumerate(reads)], "row_ix bigint, sread string, qual string")
    subject = "ACGTTGCA"
    for kind in ("global", "local", "overlap"):
        got = {r.row_ix: r.score for r in pairwise_alignment(df, subject, kind=kind, match=2, mismatch=-1, opening=3, extension=1).collect()}
        for i, s in enumerate(reads):
            assert abs(got[i] - plain_alignment(s, subject, 2, -1, kind, 3, 1)) < 1e-9, (kind, s)
        equal, other = (float(x[0]) for x in quality_scores(np.array([10**-4.0])))
        got = {r.row_ix: r.score for r in pairwise_alignment(df, subject, kind=kind).collect()}
        assert all(abs(got[i] - plain_alignment(s, subject, equal, other, kind, 10, 4)) < 1e-9 for i, s in enumerate(reads))
