"""Counts by cycle, letter, sequence, tile and lane."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import warn
from ..functions.quality import mean_quality, offset, quality_sum
from ..functions.sequence import letter_frequency, letters, other_count


def letters_by_cycle(reads: DataFrame, column: str = "sread", alphabet: str | None = None, by: tuple[str, ...] = (), dense: bool = False) -> DataFrame:
    """Counts (cycle, letter, n) of letters at each place; with `dense`, zeros too for the alphabet's letters."""
    each = reads.select(*by, F.posexplode(letters(column)).alias("at", "letter"))
    if alphabet is not None:
        each = each.where(F.col("letter").isin(list(alphabet)))
    counts = each.groupBy(*by, (F.col("at") + 1).alias("cycle"), "letter").agg(F.count("*").alias("n"))
    if not dense or alphabet is None:
        return counts
    # At most alphabet x cycles rows for each group, which the counts have already.
    span = reads.groupBy(*by).agg(F.max(F.length(column)).alias("most")).where("most > 0")
    cells = span.select(*by, F.explode(F.sequence(F.lit(1), "most")).alias("cycle"), F.array([F.lit(x) for x in alphabet]).alias("a")).select(*by, "cycle", F.explode("a").alias("letter"))
    return cells.join(counts, [*by, "cycle", "letter"], "left").fillna(0, ["n"])


def pairs_by_cycle(reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts (cycle, base, quality, n) of bases with their quality characters at each place."""
    both = F.arrays_zip(letters("sread").alias("base"), letters("qual").alias("quality"))
    each = reads.select(*by, F.posexplode(both).alias("at", "x"))
    return each.groupBy(*by, (F.col("at") + 1).alias("cycle"), F.col("x.base").alias("base"), F.col("x.quality").alias("quality")).agg(F.count("*").alias("n"))


def base_calls(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Bases by cycle, from pairs_by_cycle()."""
    return pairs.groupBy(*by, "cycle", "base").agg(F.sum("n").alias("n"))


def cycle_qualities(pairs: DataFrame, encoding: str = "phred33", by: tuple[str, ...] = ()) -> DataFrame:
    """Qualities by cycle with their scores, from pairs_by_cycle()."""
    return pairs.groupBy(*by, "cycle", "quality").agg(F.sum("n").alias("n")).withColumn("score", F.ascii("quality") - offset(encoding))


def cycle_quality_stats(reads: DataFrame, encoding: str = "phred33", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and quartiles of the scores at each cycle, over the reads that reach it."""
    counts = cycle_qualities(pairs_by_cycle(reads, by), encoding, by)
    mean = F.sum(F.col("score") * F.col("n")) / F.sum("n")
    quartile = lambda p: F.percentile("score", F.lit(p), F.col("n"))
    return counts.groupBy(*by, "cycle").agg(mean.alias("mean"), quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75"))


def letter_totals(reads: DataFrame, column: str = "sread", alphabet: str = "ACGT", by: tuple[str, ...] = ()) -> DataFrame:
    """Letters in all reads, and all others together."""
    counts = reads.select(*by, *letter_frequency(column, alphabet))
    return counts.groupBy(*by).agg(*[F.sum(x).cast("bigint").alias(x) for x in [*alphabet, "other"]])


def quality_use(reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How often each quality character occurs in all."""
    return reads.select(*by, F.explode(letters("qual")).alias("quality")).groupBy(*by, "quality").agg(F.count("*").alias("n"))


def quality_cumulative(use: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of the bases with at most each quality, from quality_use()."""
    upto = Window.partitionBy(*by or [F.lit(1)]).orderBy("quality").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*by or [F.lit(1)])
    return use.withColumn("share", F.sum("n").over(upto) / F.sum("n").over(every))


def sequence_counts(reads: DataFrame, by: tuple[str, ...] = (), column: str = "sread") -> DataFrame:
    return reads.groupBy(*by, column).agg(F.count("*").alias("n"))


def top_sequences(reads: DataFrame, n: int = 50, by: tuple[str, ...] = (), column: str = "sread") -> DataFrame:
    """The n commonest sequences (of each group); ties in order of the sequence."""
    counts = sequence_counts(reads, by, column)
    if not by:
        return counts.orderBy(F.desc("n"), column).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), column))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def occurrence_distribution(reads: DataFrame, by: tuple[str, ...] = (), column: str = "sread") -> DataFrame:
    """How many distinct sequences occur once, twice, ..."""
    return sequence_counts(reads, by, column).groupBy(*by, F.col("n").alias("n_occurrences")).agg(F.count("*").alias("n_reads"))


def tables(reads: DataFrame, n: int = 50) -> dict[str, DataFrame]:
    return {"top": top_sequences(reads, n), "distribution": occurrence_distribution(reads)}


def occurrence_curve(distribution: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative share of reads by how often their sequence occurs, from occurrence_distribution()."""
    over = Window.partitionBy(*by or [F.lit(1)])
    upto = over.orderBy("n_occurrences").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = distribution.withColumn("run", F.sum(F.col("n_occurrences") * F.col("n_reads")).over(upto))
    least, most = F.min("run").over(over), F.max("run").over(over)
    return run.select(*by, "n_occurrences", ((F.col("run") - least + 1) / (most - least + 1)).alias("share"))


def mean_counts(reads: DataFrame, encoding: str = "phred33", by: tuple[str, ...] = ()) -> DataFrame:
    """How many reads have each mean score (m, n).  Means of reads of more than 1,000 letters are rounded to four places, so
    there are few of them however many reads there are."""
    mean = mean_quality("qual", encoding)
    m = F.when(F.length("qual") > 1000, F.round(mean, 4)).otherwise(mean)
    return reads.select(*by, m.alias("m")).where("m is not null").groupBy(*by, "m").agg(F.count("*").alias("n"))


def quality_density(reads: DataFrame, encoding: str = "phred33", by: tuple[str, ...] = (), points: int = 512, bins: int = 4096) -> DataFrame:
    """Gaussian kernel density of the reads' mean scores at `points` places: quality, density.

    The bandwidth is 0.9 times the lesser of standard deviation and normalised quartile range, by the fifth root of n.
    Reads are counted by mean score first, so a task sees the different means of a group, and of more than 16 for each of
    `bins` the bins; the grid reaches three bandwidths beyond the data.  Fewer than two reads give one row of nulls.
    """
    return density_of(mean_counts(reads, encoding, by), by, points, bins)


def density_of(counts: DataFrame, by: tuple[str, ...] = (), points: int = 512, bins: int = 4096) -> DataFrame:
    """quality_density() of mean_counts()."""
    kinds = dict(counts.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "quality double", "density double"])

    def density(g: pd.DataFrame) -> pd.DataFrame:
        head = {c: g[c].iloc[0] for c in by}
        g = g.sort_values("m")
        at, n = g["m"].to_numpy(dtype=float), g["n"].to_numpy(dtype=float)
        size = int(n.sum())
        if size < 2:
            return pd.DataFrame([{**head, "quality": None, "density": None}])
        sd = float(np.sqrt((n * (at - (n * at).sum() / size) ** 2).sum() / (size - 1)))
        q25, q75 = at[np.searchsorted(np.cumsum(n), np.array([0.25, 0.75]) * size)]
        iqr = float(q75 - q25) / 1.34
        low = min(x for x in (sd, iqr) if x > 0) if sd > 0 or iqr > 0 else abs(float(at[0])) or 1.0
        width = 0.9 * low * size**-0.2
        x = np.linspace(at[0] - 3 * width, at[-1] + 3 * width, points)
        if len(at) > 16 * bins:
            place = np.minimum(((at - at[0]) / (at[-1] - at[0]) * bins).astype(int), bins - 1)
            total, sums = np.bincount(place, n, bins), np.bincount(place, n * at, bins)
            at, n = sums[total > 0] / total[total > 0], total[total > 0]
        y = np.zeros(points)
        for i in range(0, len(at), 512):
            y += (np.exp(-0.5 * ((x[:, None] - at[None, i : i + 512]) / width) ** 2) * n[None, i : i + 512]).sum(axis=1)
        return pd.DataFrame({**head, "quality": x, "density": y / (size * width * np.sqrt(2 * np.pi))})

    return counts.groupBy(*by).applyInPandas(density, schema)


def tile_counts(reads: DataFrame, kept: Column | None = None, aligned: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Reads of each tile in all, those that pass and those that align; and medians of their mean scores."""
    kept, aligned = (F.lit(False) if c is None else F.coalesce(c, F.lit(False)) for c in (kept, aligned))
    q = mean_quality("qual")
    some = lambda c: F.sum(c.cast("bigint"))
    mid = lambda c: F.percentile(F.when(c, q), F.lit(0.5))
    every = F.lit(True)
    return reads.groupBy(*by, "tile").agg(F.count("*").alias("n_read"), some(kept).alias("n_filtered"), some(aligned).alias("n_aligned"), mid(every).alias("median_read"), mid(kept).alias("median_filtered"), mid(aligned).alias("median_aligned"))


def dense_tiles(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """tile_counts() with a row for each tile from 1 to the largest of all; tiles without reads have counts of 0."""
    most = counts.agg(F.max("tile").alias("most"))
    groups = counts.select(*by).distinct().crossJoin(F.broadcast(most)) if by else most
    tiles = groups.select(*by, F.explode(F.sequence(F.lit(1), F.col("most"))).alias("tile"))
    return tiles.join(counts, [*by, "tile"], "left").fillna(0, ["n_read", "n_filtered", "n_aligned"])


def tile_stats(reads: DataFrame, lane: str = "lane", tile: str = "tile") -> DataFrame:
    """Reads and clean reads of each numbered lane and tile, and where they lie: three columns of a hundred tiles to a lane,
    run through up and down."""
    counts = reads.groupBy(F.col(lane).cast("int").alias("lane"), F.col(tile).cast("int").alias("tile")).agg(F.count("*").alias("n_reads"), F.count_if(other_count("sread") == 0).alias("n_clean"))
    x, y = F.col("lane"), F.col("tile")
    across = ((x - 1) * 3 + F.floor((y - 1) / 100) + 1).cast("int")
    along = (1 + F.least(F.pmod(y - 1, F.lit(200)), F.pmod(200 - y, F.lit(200)))).cast("int")
    return counts.select("lane", "tile", across.alias("slane"), along.alias("stile"), "n_reads", "n_clean")


def value_counts(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """How often each value occurs, null included."""
    return df.groupBy(*by, column).agg(F.count("*").alias("n"))


def proportions(df: DataFrame, first: str, *others: str) -> DataFrame:
    """Columns as shares of the first, rounded to thousandths; a null first counts as one."""
    return df.withColumns({c: F.round(F.col(c) / F.coalesce(F.col(first), F.lit(1)), 3) for c in others})


def count_reads(reads: DataFrame, by: str = "file") -> DataFrame:
    """Records, nucleotides and scores of each file."""
    return reads.groupBy(by).agg(F.count("*").alias("records"), F.sum(F.length("sread")).cast("bigint").alias("nucleotides"), F.sum(F.length("qual")).cast("bigint").alias("scores"))


def quality_sums(reads: DataFrame, encoding: str = "phred33") -> DataFrame:
    return reads.select("row_ix", quality_sum("qual", encoding).alias("score"))


def tile_geometry(tile: Column, tiles: int) -> tuple[Column, Column]:
    """Row and column of a tile on a lane of so many tiles; other numbers than the known ones have 50 rows.  Columns run up
    and down in turn, but on lanes of 8 rows a tile's number tells both."""
    #: Tiles in one column of a lane, by tiles of the lane.
    rows = {68: 8, 100: 50, 120: 60, 300: 100}
    if tiles not in rows:
        warn(f"{tiles} tiles; assuming 50 tiles in a row", "ArgumentWarning")
    n = rows.get(tiles, 50)
    if n == 8:
        return (tile % F.lit(20)).cast("int"), (F.floor(tile / 20) % 4 + 1).cast("int")
    column = F.floor((tile - 1) / n) + 1
    row = (tile - 1) % F.lit(n) + 1
    return F.when(column % 2 == 0, n + 1 - row).otherwise(row).cast("int"), column.cast("int")
