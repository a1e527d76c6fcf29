"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal vectors are first merged into one row with a count.  Centroids are fitted on a bounded sample; every vector has a
home, its nearest cell, and also visits each lower-numbered cell where a neighbour could live: for a vector with
cosine c to its home, one at cosine t to it has a home cosine of about t*c at least, and seen from here that cell has
t*t*c at least, less the spread of the part that is orthogonal, sqrt((1 - t*t) / e), of which `spread` times is allowed.
Here e is the effective dimension of what the sample's vectors have besides their centroid (the dimension if they vary
alike in all directions, less if they do not).
Nothing else is cut: there is no limit on cells visited, on visitors or on links.  A cell's residents and visitors are
split into blocks of bounded size, and each pair of blocks is one matrix product in double precision, so a crowded cell
becomes many bounded tasks.  Blocks return counts of links and the stars of their linked groups, never pairs.

Defined results: a vector that is null, zero, or has null or non-finite parts, or another length than most, links with
nothing (another length: only with its like); equal vectors link with each other; rows that repeat a vec_id count as one
vector more each; an empty table gives an empty table; columns other than those that are named are ignored.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import durable

SAMPLE = 20_000
CELL = 1024
MOST_CELLS = 16_384
RESIDENTS, VISITORS = 1024, 4096


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows: k unit centroids; a cell that loses all its rows keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def effective_dimension(x: np.ndarray, c: np.ndarray) -> float:
    """Of the parts of unit rows that are orthogonal to their nearest centroid: the number of directions, all alike, that
    would have their spread; 1 at least."""
    near = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
    rest = x - np.einsum("ij,ij->i", x, c[near])[:, None] * c[near]
    share = np.maximum(np.linalg.eigvalsh(rest.T @ rest), 0)
    return float(share.sum() ** 2 / (share**2).sum()) if (share**2).sum() > 0 else 1.0


def unit_rows(vectors) -> np.ndarray:
    x = vectors if isinstance(vectors, np.ndarray) and vectors.ndim == 2 else np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def local_groups(hit: np.ndarray) -> np.ndarray:
    """Number of the linked group of each row and column of a boolean matrix (rows, then columns)."""
    rows, cols = hit.shape
    label = np.arange(rows + cols)
    while True:
        low = np.where(hit, label[rows:][None, :], rows + cols).min(axis=1, initial=rows + cols)
        new = np.minimum(label[:rows], low)
        high = np.minimum(label[rows:], np.where(hit, new[:, None], rows + cols).min(axis=0, initial=rows + cols))
        if (new == label[:rows]).all() and (high == label[rows:]).all():
            return label
        label = np.concatenate([new, high])


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, spread: float = 4.0, cell: int = CELL, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links (other vectors of cosine >= threshold), component_id (least id reachable), kept (it is its own)."""
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.transform(F.col(vec_col), lambda v: v.cast("double")).alias("vec"))
    fine = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    good = F.coalesce((F.size("vec") > 0) & ~F.exists("vec", fine) & F.exists("vec", lambda v: v != 0), F.lit(False))
    # -0.0 and 0.0 are one number: adding 0.0 makes their keys agree.
    key = F.when(good, F.sha2(F.array_join(F.transform("vec", lambda v: (v + F.lit(0.0)).cast("string")), ","), 256))
    every = durable(every.select("id", key.alias("key"), F.when(good, F.col("vec")).alias("vec")))
    reps = durable(every.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")))
    n_reps, dims = reps.agg(F.count("*"), F.collect_set(F.size("vec"))).first()
    edges = spark.createDataFrame([], "u bigint, v bigint")
    links = spark.createDataFrame([], "rep bigint, links bigint")
    for d in sorted(dims):
        same = reps.where(F.size("vec") == d)
        found = durable(_blocks(same, d, n_reps, threshold, spread, cell, sample))
        edges = edges.unionByName(found.where("u is not null").select("u", "v"))
        links = links.unionByName(found.where("rep is not null").select("rep", "links"))
    group = components(edges)
    links = links.groupBy("rep").agg(F.sum("links").alias("links"))
    merged = reps.select("key", "rep", "copies").join(links, "rep", "left").join(group, F.col("rep") == F.col("node"), "left")
    merged = merged.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = every.select("id", "key").join(merged, "key", "left")
    least = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), least.alias("component_id"), F.coalesce(F.col("id") == least, F.lit(False)).alias("kept"))


def _blocks(reps: DataFrame, d: int, n: int, threshold: float, spread: float, cell: int, sample: int) -> DataFrame:
    """Link counts (rep, links) and star edges (u, v) between merged vectors of one length."""
    spark = reps.sparkSession
    k = max(1, min(MOST_CELLS, math.ceil(n / cell)))
    some = reps.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(max(sample, k)).toArrow().column("vec")
    some = unit_rows(np.concatenate([c.flatten().to_numpy() for c in some.chunks]).reshape(-1, d))
    fitted = fit_centroids(some, min(k, len(some)))
    centers = spark.sparkContext.broadcast(fitted)
    slack = spread * math.sqrt(max(0.0, 1 - threshold**2) / effective_dimension(some, fitted))

    def place(frames):
        c = centers.value
        for f in frames:
            for at in range(0, len(f), 4096):
                part = f.iloc[at : at + 4096]
                x = unit_rows(part["vec"])
                dots = x @ c.T
                home = dots.argmax(axis=1)
                best = dots[np.arange(len(x)), home]
                visit = (dots >= (threshold**2 * best - slack)[:, None]) & (np.arange(len(c))[None, :] < home[:, None])
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "copies": part["copies"].to_numpy(), "unit": [r.tobytes() for r in x], "home": home, "visits": [np.flatnonzero(v).tolist() for v in visit]})

    placed = durable(reps.select("rep", "copies", "vec").mapInPandas(place, "rep bigint, copies bigint, unit binary, home int, visits array<int>"))
    lived = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("lives"))
    visited = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("comes"))
    sizes = lived.join(visited, "cell", "left").select("cell", F.ceil(F.col("lives") / RESIDENTS).cast("int").alias("blocks"), F.ceil((F.coalesce("comes", F.lit(0)) + F.col("lives")) / VISITORS).cast("int").alias("parts"))
    share = lambda salt, m: F.pmod(F.hash("rep", F.lit(salt)), F.col(m))
    upto = lambda m: F.sequence(F.lit(0), F.col(m) - 1)
    row = ["rep", "copies", "unit"]
    home = placed.withColumn("cell", F.col("home")).join(sizes, "cell").withColumn("block", share(1, "blocks")).withColumn("own", share(2, "parts"))
    # A resident meets each part of the visitors of its block; as a visitor it goes, in its own part, to all lower blocks.
    # Within its block it meets the other residents in part 0 only.
    lives = home.select(*row, "cell", "block", F.explode(upto("parts")).alias("part"), F.lit(True).alias("lives"))
    moves = home.where("block > 0").select(*row, "cell", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("block"), F.col("own").alias("part"), F.lit(False).alias("lives"))
    comes = placed.select(*row, F.explode("visits").alias("cell")).join(sizes, "cell").withColumn("part", share(2, "parts"))
    comes = comes.select(*row, "cell", F.explode(upto("blocks")).alias("block"), "part", F.lit(False).alias("lives"))

    def compare(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rep", kind="stable")
        lives = f["lives"].to_numpy()
        ids, copies = f["rep"].to_numpy(), f["copies"].to_numpy()
        x = np.frombuffer(b"".join(f["unit"]), dtype=np.float64).reshape(len(f), d)
        own, ours = np.flatnonzero(lives), x[lives]
        total = np.zeros(len(f), dtype=np.int64)
        u, v = [], []
        sides = [(own, True)] if key[2] == 0 else []
        away = np.flatnonzero(~lives)
        sides += [(away[i : i + 1024], False) for i in range(0, len(away), 1024)]
        for others, inside in sides:
            hit = ours @ x[others].T >= threshold
            if inside:
                np.fill_diagonal(hit, False)
            rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
            if not len(rows):
                continue
            hit = hit[np.ix_(rows, cols)]
            total[own[rows]] += hit @ copies[others[cols]]
            if not inside:
                total[others[cols]] += hit.T @ copies[own[rows]]
            label = local_groups(hit)
            nodes = np.concatenate([ids[own[rows]], ids[others[cols]]])
            order = np.lexsort((nodes, label))
            first = np.r_[True, label[order][1:] != label[order][:-1]]
            hub = nodes[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            u.append(nodes[order][hub != nodes[order]])
            v.append(hub[hub != nodes[order]])
        seen = np.flatnonzero(total)
        edges = pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)}).drop_duplicates() if u else pd.DataFrame({"u": [], "v": []})
        out = pd.DataFrame({"rep": pd.array([*ids[seen], *[None] * len(edges)], dtype="Int64"), "links": pd.array([*total[seen], *[None] * len(edges)], dtype="Int64"), "u": pd.array([*[None] * len(seen), *edges["u"]], dtype="Int64"), "v": pd.array([*[None] * len(seen), *edges["v"]], dtype="Int64")})
        return out

    groups = lives.unionByName(moves).unionByName(comes).groupBy("cell", "block", "part")
    return groups.applyInPandas(compare, "rep bigint, links bigint, u bigint, v bigint")
