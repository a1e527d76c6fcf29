"""Exact Jaccard join on word shingles in the metric of Jaccard distance.

1. Equal sets become one node.
2. A cheap cut comes first.  Sets of similarity t share one of their first |s| - ceil(t|s|) + 1 shingles under any common
   order; the order puts shingles last that occur in many documents, so common passages make few candidates.  Nodes of
   like size that share enough of them are candidates; where many share one, they are tied to its node of least hash.
   What candidates connect is an area.  No link crosses areas; the order affects cost, never results.
3. Each area is a region of the metric join (`regions`): pivots, nearest-pivot regions, boundary members copied by the
   triangle inequality, windows on the distance to the pivot, and the same again within each region.  A region up to a
   number of nodes and bytes is joined within one task.  A larger one is split by a distributed step: members are dealt
   to tasks that hold the region's pivots, and the regions that this gives are joined alike.
4. A region that pivots do not split (all its members are far from all others) is compared in slabs of the distance to
   its pivot, as wide as the threshold, and blocks of bounded size.

Defined results: a null text, or one without words, has an empty set and links with nothing; equal texts link; rows
that repeat an id are one document of the component, also with different texts; a null id has a null component; an empty
table gives an empty table; columns other than those that are named are ignored.  Ids must be whole numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .regions import UNLINKED, Region, distances, region_labels, windows  # noqa: F401
from .shared import discard, durable, text_slices, texts_of
from .shingles import shingle_sets

#: Up to so many nodes of a shingle are compared pairwise.
FEW = 16
#: Shingles whose frequency the order knows, at most: the most frequent ones, 16 bytes each.
KNOWN = 500_000
#: A shingle in so many documents among three million successive low shingles is reported as frequent.  Low ones have a
#: hash in this first part of the range: sets' first shingles lie there, even where some are put last.
OFTEN, WINDOW, LOW = 2, 3_000_000, np.uint64(int(0.35 * 2**64))
#: Nodes and bytes of a region that is joined within one task, and bytes of all regions that share a task.
SMALL, SMALL_BYTES, TASK_BYTES = 4096, 16_000_000, 8_000_000
#: Of a region that is split: pivots, members and bytes for each task, and how often it is split before it is cut in blocks.
PIVOTS, DEALT, DEALT_BYTES, LEVELS = 64, 1024, 4_000_000, 6
#: Hash buckets by which a text's need is known before texts are shuffled: bounds what is broadcast.
BUCKETS = 1 << 18
OTHERS = 2048
_MEMBER = "region bigint, node bigint, mine bigint, main bigint, far double, before bigint, bag binary"


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """Rows (id, n, digest) for documents, and rows (key, freq) for shingles that are frequent nearby."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Low shingles are gathered in one place, which is sorted there; it grows if one slice has very many.
        held, many = np.empty(WINDOW + WINDOW // 4, np.uint64), 0

        def frequent(low: np.ndarray) -> pa.RecordBatch:
            low.sort()
            # Only what occurs again is counted: nearly all shingles occur once.
            keys, again = np.unique(low[1:][low[1:] == low[:-1]], return_counts=True)
            keys, freq = keys[again + 1 >= OFTEN], again[again + 1 >= OFTEN] + 1
            none = lambda t: pa.nulls(len(keys), t)
            return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.binary()), pa.array(keys.view(np.int64)), pa.array(freq, pa.int64())], ["id", "n", "digest", "key", "freq"])

        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingle_sets(texts_of(part, "text"), width)
                lows = [s[: np.searchsorted(s, LOW)] for s in sets]
                more = sum(map(len, lows))
                if many + more > len(held):
                    held = np.r_[held[:many], np.empty(more, np.uint64)]
                for low in lows:
                    held[many : many + len(low)] = low
                    many += len(low)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                n = len(sets)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["id", "n", "digest", "key", "freq"])
                if many > WINDOW:
                    yield frequent(held[:many])
                    many = 0
        yield frequent(held[:many])

    return docs.mapInArrow(run, "id bigint, n bigint, digest binary, key bigint, freq bigint")


def _prefixes(docs: DataFrame, width: int, percent: int, known) -> DataFrame:
    """Rows (id, digest, n, keys, last) of documents with words: the first shingles of each set, known frequent ones
    last, and the place of the last of them in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, freq = known.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingle_sets(texts_of(part, "text"), width)
                digest, keys, last = [], [], []
                for s in sets:
                    if not len(s):
                        continue
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        rank = np.where(frequent[at] == s, freq[at], 0)
                    else:
                        rank = np.zeros(len(s), dtype=np.int64)
                    chosen = np.argsort(rank, kind="stable")[: prefix_size(len(s), percent)]
                    first = s[chosen]
                    last.append({"rank": int(rank[chosen[-1]]), "hash": int(first[-1] >> np.uint64(1))})
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(first.view(np.int64))
                some = np.array([len(s) > 0 for s in sets], dtype=bool)
                offsets = pa.array(np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32))
                flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id").filter(pa.array(some)), pa.array(digest, pa.binary()), pa.array([len(s) for s in sets if len(s)], pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.array(last, pa.struct([("rank", pa.int64()), ("hash", pa.int64())]))], ["id", "digest", "n", "keys", "last"])

    return docs.mapInArrow(run, "id bigint, digest binary, n bigint, keys array<bigint>, last struct<rank:bigint,hash:bigint>")


def _sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """Rows (id, region, bag) with the whole sets of the nodes in needed (id, digest, region)."""
    bucket = F.pmod(F.hash("id"), F.lit(BUCKETS))
    buckets = F.broadcast(needed.select(bucket.alias("bucket")).distinct())
    texts = docs.join(buckets, bucket == F.col("bucket"), "left_semi").join(needed, "id").select("id", "digest", "region", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                bags = [s.tobytes() for s in shingle_sets(texts_of(part, "text"), width)]
                same = pa.array([hashlib.blake2b(b, digest_size=16).digest() == d for b, d in zip(bags, part.column("digest").to_pylist())])
                yield pa.RecordBatch.from_arrays([*(part.column(c).filter(same) for c in ("id", "region")), pa.array(bags, pa.binary()).filter(same)], ["id", "region", "bag"])

    return texts.mapInArrow(run, "id bigint, region bigint, bag binary")


def _promising(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, c) that share c rare first shingles those that can be similar enough.

    What two sets have in common lies among the first shingles of both, or behind those of the set whose first ones end
    earlier in the order.  Shared frequent shingles are not counted, so each node's number of them is allowed for.
    """
    size = F.size("keys")
    side = lambda x: nodes.select(F.col("node").alias(x), F.struct("n", (F.col("n") - size).alias("rest"), "last", "hot").alias(f"{x}_"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.col("a_.n") + F.col("b_.n")
    need = F.ceil(both * percent / (100 + percent) - 1e-9)
    rest = F.when(F.col("a_.last") < F.col("b_.last"), F.col("a_.rest")).when(F.col("b_.last") < F.col("a_.last"), F.col("b_.rest")).otherwise(F.greatest("a_.rest", "b_.rest"))
    near = F.least("a_.n", "b_.n") * 100 >= F.greatest("a_.n", "b_.n") * percent
    return rows.where(near & (F.col("c") + F.least("a_.hot", "b_.hot") + rest >= need)).select("a", "b")


def _bags(g: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint64) for b in g["bag"]]


def _within_tasks(members: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Links (u, v) that make the components of regions of bounded size, several to a task; u > v within a region."""

    def join(f: pd.DataFrame) -> pd.DataFrame:
        u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for _, g in f.sort_values("node", kind="stable").groupby("region", sort=False):
            node, mine = g["node"].to_numpy(), g["mine"].to_numpy()
            region = Region(_bags(g), percent)
            for known in (node, mine):  # rows of one document, and members that earlier steps have tied
                _, first, at = np.unique(known, return_index=True, return_inverse=True)
                region.tie(np.arange(len(g)), first[at])
            far = g["far"].to_numpy()
            label = region.join(None if np.isnan(far).any() else far)
            u.append(node)
            v.append(node[label])
        u, v = np.concatenate(u), np.concatenate(v)
        return pd.DataFrame({"u": u[u != v], "v": v[u != v]})

    return members.groupBy(F.pmod(F.hash("region"), F.lit(tasks)).alias("task")).applyInPandas(join, "u bigint, v bigint")


def _split(members: DataFrame, sizes: DataFrame, percent: int, scratch: list[str]) -> DataFrame:
    """One step over regions (sizes: region, nodes, bytes, loose): rows of _MEMBER of the regions that their pivots make,
    and links (node, mine) without a region.

    Pivots are loose members of least hash.  Members are dealt to tasks of bounded size, each with all pivots of its region.
    """
    threshold = 1 - percent / 100
    tasks = F.ceil(F.greatest(F.col("nodes") / DEALT, F.col("bytes") / DEALT_BYTES)).cast("int")
    pivots = F.least(F.lit(PIVOTS), 1 + F.ceil(F.greatest(F.col("nodes") * 4 / SMALL, F.col("bytes") * 4 / SMALL_BYTES))).cast("int")
    sizes = durable(sizes.select("region", tasks.alias("tasks"), pivots.alias("pivots"), "loose", F.col("nodes").alias("before_")), scratch)
    order = F.xxhash64("node", "region")
    full = members.join(sizes, "region").withColumn("order", order)
    # Only members that can be among the first are ranked: about twice as many as pivots, and the very first.
    first = full.where(_LOOSE).groupBy("region").agg(F.min("order").alias("order")).withColumn("first", F.lit(True))
    some = full.where(_LOOSE).join(first, ["region", "order"], "left")
    some = some.where(F.coalesce("first", F.lit(False)) | (F.shiftrightunsigned("order", 11) < (F.lit(2.0) * F.col("pivots") + 8) / F.col("loose") * float(1 << 53)))
    rank = F.row_number().over(Window.partitionBy("region").orderBy("order", "node"))
    some = some.withColumn("rank", rank).where(F.col("rank") <= F.col("pivots"))
    dealt = lambda task, rank: [F.col("region"), task.alias("task"), rank.alias("rank"), F.col("node"), F.col("mine"), F.col("main"), F.col("before_").alias("before"), F.col("bag")]
    pivot_rows = some.select(*dealt(F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)), F.col("rank")))
    member_rows = full.select(*dealt(F.pmod(F.hash("node"), "tasks"), F.lit(0)))

    def step(f: pa.Table) -> pa.Table:
        rank = f.column("rank").to_numpy()
        order = np.argsort(rank, kind="stable")
        p, m = f.take(order[int((rank == 0).sum()) :]), f.filter(pa.array(rank == 0))
        ints, none = (lambda x: pa.array(x, pa.int64())), (lambda n, t: pa.nulls(n, t))
        if not m.num_rows or not p.num_rows:
            return pa.table({"region": none(0, pa.int64()), "node": ints([]), "mine": ints([]), "main": ints([]), "far": pa.array([], pa.float64()), "before": ints([]), "bag": none(0, pa.binary())})
        bags = lambda t: [np.frombuffer(b, dtype=np.uint64) for b in t.column("bag").to_pylist()]
        far, link = distances(bags(p), bags(m), percent)
        home, close, copied = windows(far, threshold)
        nodes, pivots = m.column("node").to_numpy(), p.column("node").to_numpy()
        x, q = np.nonzero(link)
        x, q = x[nodes[x] != pivots[q]], q[nodes[x] != pivots[q]]
        out = [pa.table({"region": none(len(x), pa.int64()), "node": ints(nodes[x]), "mine": ints(pivots[q]), "main": none(len(x), pa.int64()), "far": none(len(x), pa.float64()), "before": none(len(x), pa.int64()), "bag": none(len(x), pa.binary())})]
        tied = np.where(link.any(axis=1), pivots[link.argmax(axis=1)], m.column("mine").to_numpy())
        region = f.column("region")[0].as_py()
        for k in range(len(pivots) + 1):
            outer = k == len(pivots)
            inside = np.flatnonzero(~close if outer else close & (home == k) | copied[:, k])
            n, part = len(inside), m.take(inside)
            main, dist = (none(n, pa.int64()), none(n, pa.float64())) if outer else (ints(np.full(n, pivots[k])), pa.array(far[inside, k]))
            out.append(pa.table({"region": ints(np.full(n, _child(region, -1 if outer else k))), "node": part.column("node"), "mine": ints(tied[inside]), "main": main, "far": dist, "before": part.column("before"), "bag": part.column("bag")}))
        return pa.concat_tables(out)

    return pivot_rows.unionByName(member_rows).groupBy("region", "task").applyInArrow(step, _MEMBER)


#: Members that are not tied to the pivot of their region.
_LOOSE = "main is null or mine <> main"


def _child(region: int, k: int) -> int:
    """Number of the region of a region's k-th pivot."""
    return int.from_bytes(hashlib.blake2b(b"%d %d" % (region, k), digest_size=8).digest(), "big", signed=True)


def _blocks(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of regions that pivots do not split, between loose members and all, by slabs and blocks."""
    threshold = 1 - percent / 100
    blocks = sizes.select("region", F.ceil(F.col("loose") / UNLINKED).cast("int").alias("us"), F.ceil(F.greatest(F.col("nodes") / OTHERS, F.col("bytes") / SMALL_BYTES)).cast("int").alias("ns"))
    slab = F.coalesce(F.floor(F.col("far") / (threshold * (1 + 1e-9))).cast("int"), F.lit(0))
    full = members.join(blocks, "region").select("region", "node", "mine", "bag", "us", "ns", slab.alias("slab"), F.expr(_LOOSE).alias("loose"))
    share = lambda m: F.pmod(F.hash("node"), F.col(m))
    upto = lambda m: F.sequence(F.lit(0), F.col(m) - 1)
    near = F.explode(F.array(F.col("slab") - 1, F.col("slab"), F.col("slab") + 1)).alias("slab")
    u = full.where("loose").select("region", "slab", share("us").alias("ub"), F.explode(upto("ns")).alias("nb"), "node", "mine", "bag", F.lit(True).alias("is_u"))
    n = full.select("region", near, "us", share("ns").alias("nb"), "node", "mine", "bag")
    n = n.join(full.where("loose").select("region", "slab").distinct(), ["region", "slab"], "left_semi")
    n = n.select("region", "slab", F.explode(upto("us")).alias("ub"), "nb", "node", "mine", "bag", F.lit(False).alias("is_u"))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        us, ns = f[f["is_u"]], f[~f["is_u"]]
        if not len(us) or not len(ns):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        j, i = np.nonzero(distances(_bags(us), _bags(ns), percent)[1])
        a, b = us.iloc[i].reset_index(drop=True), ns.iloc[j].reset_index(drop=True)
        new = a["mine"] != b["mine"]
        return pd.DataFrame({"u": a.loc[new, "node"], "v": b.loc[new, "mine"]}).drop_duplicates()

    return u.unionByName(n).groupBy("region", "slab", "ub", "nb").applyInPandas(compare, "u bigint, v bigint")


def metric_links(members: DataFrame, percent: int, scratch: list[str]) -> tuple[DataFrame, bool]:
    """Links (u, v) that make the components of regions (rows of _MEMBER), and whether they are other than stars about each
    component's least node."""
    spark, links, stars = members.sparkSession, [], True
    for level in range(LEVELS + 1):
        sizes = members.groupBy("region").agg(F.count("*").alias("nodes"), F.sum(F.length("bag")).alias("bytes"), F.count_if(F.expr(_LOOSE)).alias("loose"), F.max("before").alias("before"))
        large = (F.col("nodes") > SMALL) | (F.col("bytes") > SMALL_BYTES)
        # A level that leaves nearly all of a region together does not help; blocks take it as it is.
        stuck = F.lit(level == LEVELS) | (F.col("before") > 0) & (F.col("nodes") > 0.9 * F.col("before"))
        how = F.when(~large, "task").when(stuck, "blocks").otherwise("split").alias("how")
        sizes = durable(sizes.where("loose > 0 and nodes > 1").select("*", how), scratch)
        work = F.coalesce(F.sum(F.col("loose").cast("double") * F.col("nodes")), F.lit(0.0)).alias("pairs")
        found = {r.how: r for r in sizes.groupBy("how").agg(F.sum("bytes").alias("bytes"), work).collect()}
        of = lambda how: members.join(sizes.where(F.col("how") == how).select("region"), "region", "left_semi")
        if "task" in found:
            links.append(durable(_within_tasks(of("task"), percent, max(1, found["task"].bytes // TASK_BYTES)), scratch))
        if "blocks" in found:
            links.append(durable(_blocks(of("blocks"), sizes.where("how = 'blocks'"), percent), scratch))
            stars = False
        if "split" not in found:
            break
        stars = False
        made = durable(_split(of("split"), sizes.where("how = 'split'"), percent, scratch), scratch)
        links.append(made.where("region is null").select(F.col("node").alias("u"), F.col("mine").alias("v")))
        parts = made.where("region is not null").groupBy("region").agg(F.count("*").alias("nodes"), F.count_if(F.expr(_LOOSE)).alias("loose")).agg(work).first()
        if parts.pairs > 0.75 * found["split"].pairs:
            # With their copies the parts are nearly as much work as the regions: these are compared as they are.
            links.append(durable(_blocks(of("split"), sizes.where("how = 'split'"), percent), scratch))
            break
        members = made.where("region is not null")
    out = spark.createDataFrame([], "u bigint, v bigint")
    for more in links:
        out = out.unionByName(more)
    return out, not stars


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (least id reachable by links of 100 * common >= percent * total shingles)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    scanned = durable(_scan(docs, width))
    frequent = scanned.where("key is not null").groupBy("key").agg(F.sum("freq").alias("freq")).orderBy(F.desc("freq"), "key").limit(KNOWN).toArrow()
    keys = frequent.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], frequent.column("freq").to_numpy().astype(np.int64)[order]))

    scratch: list[str] = []
    firsts = _prefixes(docs.where("id is not null"), width, percent, known)
    nodes = durable(firsts.groupBy("digest").agg(F.min("id").alias("node"), *[F.first(c).alias(c) for c in ("n", "keys", "last")]), scratch)
    posts = nodes.select("node", F.explode("keys").alias("key"))
    # What is known of a shingle is written before it is joined, so a frequent one is a skewed join that can be dealt anew.
    stats = durable(posts.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), scratch)
    shared = durable(posts.join(stats, "key"), scratch)
    # Where many share a shingle, only those of like size can be linked: bands of sizes are as wide as the similarity
    # allows, and each node is in the groups of its band and the next, so a pair of like size has a group in common.
    band = F.floor(F.log(F.col("n").cast("double")) / (max(-math.log(percent / 100), 1e-6) * 1.000001)).cast("int")
    banded = shared.where(F.col("many") > FEW).select("key", "node").join(nodes.select("node", band.alias("band")).distinct(), "node")
    banded = durable(banded.select("key", "node", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("part")), scratch)
    parts = durable(banded.groupBy("key", "part").agg(F.count("*").alias("many"), F.min(F.struct(F.hash("node"), "node"))["node"].alias("pivot")).where("many > 1"), scratch)
    banded = durable(banded.join(parts, ["key", "part"]), scratch)
    few = shared.where(F.col("many") <= FEW).select("key", F.lit(-1).alias("part"), "node").unionByName(banded.where(F.col("many") <= FEW).select("key", "part", "node"))
    met = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), ["key", "part"]).where("a < b").select("key", "a", "b").distinct()
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("c"))
    hot = banded.where(F.col("many") > FEW)
    often = hot.groupBy("node").agg(F.count_distinct("key").alias("hot"))
    pairs = _promising(pairs, nodes.join(often, "node", "left").fillna(0, ["hot"]), percent)
    stars = hot.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()

    area = components(pairs.unionByName(stars).select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    needed = nodes.join(area, "node").select(F.col("node").alias("id"), "digest", F.col("component_id").alias("region"))
    members = _sets(docs, needed, width).select("region", F.col("id").alias("node"), F.col("id").alias("mine"), F.lit(None).cast("bigint").alias("main"), F.lit(None).cast("double").alias("far"), F.lit(0).cast("bigint").alias("before"), "bag")
    links, split = metric_links(durable(members, scratch), percent, scratch)
    # Where no area was split the links are stars about each component's least node already.
    final = components(links, scratch) if split else links.select(F.col("u").alias("node"), F.col("v").alias("component_id")).distinct()
    named = durable(nodes.select("digest", "node").join(final, "node", "left").select("digest", F.coalesce("component_id", "node").alias("component_id")))
    discard(spark, scratch)
    rows = scanned.where("key is null")
    out = rows.where("digest is not null").join(named, "digest", "left").unionByName(rows.where("digest is null").withColumn("component_id", F.lit(None).cast("bigint")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
