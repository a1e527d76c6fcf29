"""Filters, order, intervals, summaries and samples."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.errors import ArgumentMismatch, IncompatibleTypes, ReadsError, ValidityError
from strandmill.operators import filters as D
from strandmill.operators import intervals as I
from strandmill.operators import order as O
from strandmill.operators import summaries as A
from strandmill.operators import tables as X

ALIGNED = "row_ix bigint, chromosome string, strand string, position int, sread string, qual string, id string"


def aligned(spark, rows):
    return spark.createDataFrame([(i, c, s, p, r, "I" * len(r or ""), f"r{i}") for i, (c, s, p, r) in enumerate(rows, 1)], ALIGNED)


def places(df):
    return sorted(r.row_ix for r in df.collect())


def test_occurrence_keys(spark):
    df = aligned(spark, [("chr1", "+", 1, "A"), ("chr1", "+", 1, "T"), ("chr1", "+", 1, "A")])
    two = df.where("row_ix < 3")
    assert places(D.occurrence_filter(with_read=True)(two)) == [1, 2]
    assert places(D.occurrence_filter(with_read=False)(two)) == [1]
    assert places(D.occurrence_filter(with_read=None)(df)) == [1, 2]
    assert places(D.occurrence_filter(with_read=None, duplicates="tail")(df)) == [2, 3]
    assert places(D.occurrence_filter(with_read=None, duplicates="none")(df)) == [2]
    assert len(places(D.occurrence_filter(with_read=None, duplicates="sample")(df))) == 2
    assert places(D.occurrence_filter(duplicates=lambda g, n: sorted(g["row_ix"])[-n:])(df)) == [2, 3]
    assert places(D.occurrence_filter(2, 2)(df)) == [1, 3]
    with pytest.raises(ArgumentMismatch):
        D.occurrence_filter(2, 1)


def test_nulls_in_filters(spark):
    df = aligned(spark, [(None, None, None, "A"), ("c", "-", 5, "N")])
    assert places(D.position_filter(1, 9)(df)) == [2]
    assert places(D.strand_filter([None])(df)) == [1]
    assert places(D.chromosome_filter("c")(df)) == [2] and places(D.chromosome_filter("c", exclude=True)(df)) == [1]
    assert places(D.id_filter()(df)) == [1, 2] and places(D.id_filter("r1", fixed=True)(df)) == [1]
    assert places(D.clean(df)) == [1]
    assert places(D.occurrence_filter(with_read=True)(df)) == [1, 2]
    with pytest.raises(ReadsError):
        D.unique_filter()


def test_stats(spark):
    df = aligned(spark, [("c", "+", 1, "A"), ("c", "+", 2, "N")])
    a, b = D.read_filter(lambda d: F.col("row_ix") == 1, "A"), D.read_filter(lambda d: F.col("row_ix") == 2, "B")
    assert [tuple(r)[1:] for r in (a | b).stats(df).orderBy("position").collect()] == [("A", 2, 1, None), ("B", 2, 1, None), ("(A | B)", 2, 2, "|")]
    assert [tuple(r)[1:] for r in (~b).stats(df).orderBy("position").collect()] == [("B", 2, 1, None), ("!(B)", 2, 1, "!")]
    assert places(D.compose(a, D.n_filter())(df)) == [1] and D.compose(a, b).name == "A o B"
    assert places(D.subset_by_rules(df, [a, D.read_filter()])) == [1]
    assert [r.passes for r in (~a).marked(df).orderBy("row_ix").collect()] == [False, True]


@pytest.mark.parametrize("strand, coords, extend, runs", [("+", "leftmost", 5, [7, 15, 3]), ("-", "leftmost", 5, [2, 15, 8]), ("+", "fiveprime", 5, [7, 15, 3])])
def test_coverage_runs(spark, strand, coords, extend, runs):
    df = aligned(spark, [("ChrA", strand, 8, "A" * 10)])
    out = I.coverage(df, width={"ChrA": 25}, coords=coords, extend=extend).orderBy("start").collect()
    assert [r.end - r.start + 1 for r in out] == runs and [r.depth for r in out] == [0, 1, 0]


def test_coverage_by_hand(spark, monkeypatch):
    monkeypatch.setattr(I, "BIN", 16)
    rnd = random.Random(2)
    reads = [(rnd.choice("ab"), rnd.choice("+-"), rnd.randint(1, 90), "A" * rnd.randint(1, 12)) for _ in range(60)]
    out = I.coverage(aligned(spark, reads), shift={"a": 3, "b": 0}).collect()
    depth = {(r.chromosome, p): r.depth for r in out for p in range(r.start, r.end + 1)}
    for c, move in (("a", 3), ("b", 0)):
        for p in range(1, 110):
            want = sum(x == c and q + move <= p < q + move + len(s) for x, _, q, s in reads)
            assert depth.get((c, p), 0) == want
    runs = sorted((r.chromosome, r.start, r.end, r.depth) for r in out)
    assert all(b[1] == a[2] + 1 and a[3] != b[3] for a, b in zip(runs, runs[1:]) if a[0] == b[0])
    with pytest.raises(ArgumentMismatch):
        I.coverage(aligned(spark, reads), width={"a": 5})


def test_overlaps_by_hand(spark):
    rnd = random.Random(3)
    reads = [(rnd.choice(["a", "b", None]), "+", rnd.choice([None, rnd.randint(1, 300)]), "A" * rnd.randint(1, 20)) for _ in range(80)]
    spans = [(i, rnd.choice("ab"), s, s + rnd.randint(0, 40)) for i, s in enumerate(rnd.sample(range(1, 300), 12))]
    ranges = spark.createDataFrame(spans, "n int, chromosome string, start int, end int")
    meets = lambda r, s: r[0] == s[1] and r[2] is not None and r[2] <= s[3] and r[2] + len(r[3]) - 1 >= s[2]
    got = {r.row_ix: r.overlaps for r in I.overlaps_any(aligned(spark, reads), ranges, 16).collect()}
    assert got == {i: any(meets(r, s) for s in spans) for i, r in enumerate(reads, 1)}
    counts = {r.n_: r.n for r in I.count_overlaps(aligned(spark, reads), ranges.withColumnRenamed("n", "n_"), ("n_",), 16).collect()}
    assert counts == {s[0]: sum(meets(r, s) for r in reads) for s in spans}


def test_windows(spark):
    df = aligned(spark, [("c", "+", 5, "AAA"), ("c", "-", 6, "AA"), ("d", "+", 5, "A")])
    fine = I.coverage_window(df, "c", 5, 7)
    assert sorted(map(tuple, fine.collect())) == [("+", 5, 1), ("+", 6, 1), ("+", 7, 1), ("-", 6, 1), ("-", 7, 1)]
    assert I.coverage_window(df, "c", 1, 20_000).count() == 2
    mean = I.coverage_frames({"f": fine, "g": fine.where("strand = '+'")})
    assert {(r.strand, r["at"]): r.depth for r in mean.collect()}[("-", 6)] == -0.5


def test_order(spark):
    rnd = random.Random(4)
    reads = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 9))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(reads)), "row_ix bigint, sread string")
    want = sorted(range(200), key=lambda i: (reads[i], i))
    got = [r.row_ix for r in O.read_order(df).orderBy("place").collect()]
    assert got == want and [r.row_ix for r in O.sorted_reads(df).collect()] == want
    ranks = {r.row_ix: r["rank"] for r in O.read_rank(df).collect()}
    assert ranks == {i: 1 + sum(s < reads[i] for s in reads) for i in range(200)}
    first = {}
    assert {r.row_ix: r.duplicated for r in O.duplicated(df).collect()} == {i: first.setdefault(s, i) != i for i, s in enumerate(reads)}


def test_hot_keys(spark):
    """Half of all rows on one key, in many partitions: order, rank, repeats and occurrences are whole, and tasks are even."""
    rnd = random.Random(5)
    reads = ["ACGTACGT" if rnd.random() < 0.5 else "ACGTAC" + "".join(rnd.choice("ACGT") for _ in range(4)) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(reads)), "row_ix bigint, sread string").repartition(8)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        want = sorted(range(3000), key=lambda i: (reads[i], i))
        placed = O.read_order(df)
        assert [r.row_ix for r in placed.orderBy("place").collect()] == want
        sizes = [r["count"] for r in df.orderBy("sread", "row_ix").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * 3000 / 4
        least = {}
        for k, i in enumerate(want):
            least.setdefault(reads[i], k + 1)
        assert {r.row_ix: r["rank"] for r in O.read_rank(df).collect()} == {i: least[s] for i, s in enumerate(reads)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    first = {}
    assert {r.row_ix: r.duplicated for r in O.duplicated(df).collect()} == {i: first.setdefault(s, i) != i for i, s in enumerate(reads)}
    places = {}
    for i, s in enumerate(reads):
        places.setdefault(s, []).append(i)
    for how, part in (("head", lambda x: x[:2]), ("tail", lambda x: x[-2:]), ("none", lambda x: x if len(x) <= 2 else [])):
        got = [r.row_ix for r in D.occurrence_filter(1, 2, None, how)(df).collect()]
        assert sorted(got) == sorted(i for x in places.values() for i in part(x)), how


def test_tile_geometry(spark):
    import warnings

    tiles = spark.range(1, 121).withColumn("tile", F.col("id").cast("int"))
    at = lambda n: [tuple(r) for r in tiles.orderBy("tile").select(*A.tile_geometry(F.col("tile"), n)).collect()]
    assert at(120)[:2] == [(1, 1), (2, 1)] and at(120)[60:62] == [(60, 2), (59, 2)]
    assert at(100)[49:52] == [(50, 1), (50, 2), (49, 2)] and at(300)[99:102] == [(100, 1), (100, 2), (99, 2)]
    assert at(68)[:3] == [(1, 1), (2, 1), (3, 1)] and at(68)[20:22] == [(1, 2), (2, 2)]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert at(110)[49:52] == [(50, 1), (50, 2), (49, 2)] and seen


def test_aligned_order(spark):
    df = aligned(spark, [("b", "-", 1, "A"), ("a", "+", 2, "C"), (None, None, None, "A"), ("a", "+", 2, "A"), ("b", "+", 1, "A")])
    assert [r.row_ix for r in O.aligned_order(df).orderBy("place").collect()] == [4, 2, 5, 1, 3]
    assert [r.row_ix for r in O.aligned_order(df, chromosomes=["b", "a"]).orderBy("place").collect()] == [5, 1, 4, 2, 3]
    assert {r.row_ix: r["rank"] for r in O.aligned_rank(df, with_read=False).collect()} == {4: 1, 2: 1, 5: 3, 1: 4, 3: 5}
    assert [r.row_ix for r in O.sorted_alignments(df).collect()] == [4, 2, 5, 1, 3]
    assert [r.row_ix for r in O.aligned_duplicated(df, with_read=False).where("duplicated").collect()] == [4]
    with pytest.raises(ArgumentMismatch):
        O.aligned_rank(df, with_read=None)


def test_sample(spark):
    df = spark.range(1, 5001).withColumnRenamed("id", "row_ix").withColumn("lane", F.col("row_ix") % 3)
    out = X.exact_sample(df, 100, ("lane",), seed=1)
    assert [r["count"] for r in out.groupBy("lane").count().collect()] == [100] * 3
    assert places(out) == places(X.exact_sample(df.repartition(7), 100, ("lane",), seed=1)) != places(X.exact_sample(df, 100, ("lane",), seed=2))
    assert X.exact_sample(df, 10_000).count() == 5000 and X.exact_sample(df, 17).count() == 17
    assert X.exact_sample(df.where("false"), 5).count() == 0


def test_tables(spark):
    df = spark.createDataFrame([(1, "A"), (2, "C"), (3, "A")], "row_ix bigint, sread string")
    assert [r.row_ix for r in X.append(df, df, df).orderBy("row_ix").collect()] == list(range(1, 10))
    with pytest.raises(IncompatibleTypes):
        X.append(df, df.drop("sread"))
    with pytest.raises(ValidityError):
        X.zip_rows(df, df.where("row_ix < 3"), ("row_ix",))
    assert places(X.rows_at(df, [1, 3])) == [1, 3] and places(X.rows_at(df, [-1])) == [2, 3]
    assert [r.sread for r in X.replace_rows(df, spark.createDataFrame([(2, "T")], df.schema)).orderBy("row_ix").collect()] == ["A", "T", "A"]
    with pytest.raises(ArgumentMismatch):
        X.record_ranges(df, [(1, 5), (5, 6)])
    assert [tuple(r) for r in A.top_sequences(df, 1).collect()] == [("A", 2)]
    assert sorted(map(tuple, A.occurrence_distribution(df).collect())) == [(1, 1), (2, 1)]


def test_summaries_of_empty_reads(spark):
    df = spark.createDataFrame([(1, "", ""), (2, "AC", "I!")], "row_ix bigint, sread string, qual string")
    assert sorted(map(tuple, A.letters_by_cycle(df).collect())) == [(1, "A", 1), (2, "C", 1)]
    assert A.pairs_by_cycle(df).count() == 2
    assert sorted(map(tuple, A.letters_by_cycle(df, alphabet="AC", dense=True).collect())) == [(1, "A", 1), (1, "C", 0), (2, "A", 0), (2, "C", 1)]
    assert A.quality_density(df).collect()[0].density is None
    assert A.letters_by_cycle(df.where("false")).count() == 0


def test_density_is_one(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([(i, "A" * 8, "".join(chr(33 + rnd.randint(5, 40)) for _ in range(8))) for i in range(400)], "row_ix bigint, sread string, qual string")
    d = A.quality_density(df).orderBy("quality").collect()
    area = sum((b.quality - a.quality) * (a.density + b.density) / 2 for a, b in zip(d, d[1:]))
    assert len(d) == 512 and abs(area - 1) < 0.01


def test_intensities(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]])], "row_ix bigint, intensity array<array<double>>")
    assert X.intensity_cycles(df, 2, 2).first().intensity == [[5.0, 6.0, 7.0, 8.0]]
    assert sorted(map(tuple, X.intensity_long(df).collect()))[5] == (1, 2, "C", 6.0)


def test_views(spark):
    from strandmill.operators.viewer import RangeView, view_feature

    df = aligned(spark, [("c", "+", 105, "AAA"), ("c", "-", 106, "AA")])
    view = RangeView({"f": df}, "c", 101, 200)
    assert view.function.name == "fine_coverage" and view.data().count() == 5
    assert (view.zoom(2).start, view.zoom(2).end) == (126, 175) and view.pan(-2).start == 1 and view.zoom(0.001).function.name == "coarse_coverage"
    assert {r.depth for r in view.toggle_strand().data().collect()} == {1.0, 2.0}
    features = spark.createDataFrame([("g", "c", 90, 120), ("g", "c", 150, 170)], "name string, chromosome string, start int, end int")
    assert (view_feature(features, "g", {"f": df}).start, view_feature(features, "g", {"f": df}).end) == (90, 170)
    with pytest.raises(ArgumentMismatch):
        RangeView({"f": df}, "c", 1, 10)
    with pytest.raises(ArgumentMismatch):
        view_feature(features, "h", {"f": df})
