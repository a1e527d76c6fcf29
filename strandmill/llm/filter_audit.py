"""What each of five filters removes, in every order in which they can be applied.

Each document has a mask of the filters that it fails, and all orders follow from how many documents have each mask.

* E (an exact copy of a document of smaller id) is decided on an RDD that is partitioned by the xxhash of the text.  Each
  partition keeps chains: the different texts of one fingerprint in full, each with its least id; all other ids are copies.
  A map task does the same among its own rows first and sends a text on once, so a text that a third of all rows repeat
  arrives once a task; ids that are copies for certain travel without text, spread over all partitions.
* Documents meet their labels by id, without texts.
* combineByKey adds a vector of counts by mask for each part; a part's rows for all orders come from its vector.

Defined results: a null text is an empty one; a null id is larger than all others, and rows that share an id are not copies
of each other; a null part is the empty string; several labels of an id count as one that is 1 if any is; documents without
labels are neither good nor toxic; an empty table gives an empty table; columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Bytes of text that a map task holds before it sends them on, and of a partition of fingerprints.
HELD, PART = 32_000_000, 64_000_000
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_ODD = b"#$%&*|"
_OUT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"

Entry = tuple[bytes, "int | None", list]


def failed(text: str) -> int:
    """The mask of filters A to D that a text fails: few words, few different words, capitals, odd characters."""
    raw = text.encode()
    words = raw.split()
    few = len(words) < 100
    repeated = 100 * len(set(words)) < 80 * len(words)
    capitals = 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 10 * len(text)
    odd = len(raw.translate(None, _ODD)) < len(raw)
    return few | repeated << 1 | capitals << 2 | odd << 3


class Chains:
    """Texts by fingerprint, in full, with their least id and the rows of that id; add() gives rows that turn out copies."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, raw: bytes, id: int | None, rows: list) -> list:
        chain = self.chains.setdefault(key, [])
        for entry in chain:
            if entry[0] == raw:
                if id == entry[1]:
                    entry[2] += rows
                    return []
                if entry[1] is None or (id is not None and id < entry[1]):
                    lost, entry[1], entry[2] = [(entry[1], *r) for r in entry[2]], id, rows
                    return lost
                return [(id, *r) for r in rows]
        chain.append([raw, id, rows])
        self.bytes += len(raw)
        return []

    def drain(self) -> Iterator[tuple[int, Entry]]:
        for key, chain in self.chains.items():
            for raw, id, rows in chain:
                yield key, (raw, id, rows)
        self.__init__()


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part and mask of every row: filters A to E as bits 0 to 4."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(part_col), F.lit("")).alias("part"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    copy = 1 << FILTERS.index("E")

    def own(rows: Iterable) -> Iterator[tuple]:
        chains = Chains()
        for id, text, part in rows:
            text = text or ""
            raw = text.encode()
            for lost in chains.add(xxhash.xxh64_intdigest(raw), raw, id, [(part, failed(text))]):
                yield xxhash.xxh64_intdigest(repr(lost[0])), (None, lost[0], [lost[1:]])
            if chains.bytes > HELD:
                yield from chains.drain()
        yield from chains.drain()

    def routed(rows: Iterable) -> Iterator[tuple]:
        chains = Chains()
        for key, (raw, id, rows_of) in rows:
            for one, part, mask in [(id, *r) for r in rows_of] if raw is None else chains.add(key, raw, id, rows_of):
                yield one, part, mask | copy
        for _, (_, id, rows_of) in chains.drain():
            for part, mask in rows_of:
                yield id, part, mask

    found = docs.rdd.mapPartitions(own).partitionBy(parts, lambda key: key).mapPartitions(routed)
    kind = docs.schema["id"].dataType.simpleString()
    return spark.createDataFrame(found, f"id {kind}, part string, mask int", verifySchema=False)


def counts(rows: Iterable[tuple[int, bool, bool]]) -> np.ndarray:
    out = np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)
    for row in rows:
        tally(out, row)
    return out


def tally(vector: np.ndarray, row: tuple[int, bool, bool]) -> np.ndarray:
    mask, good, toxic = row
    vector[0, mask] += 1
    vector[1, mask] += good
    vector[2, mask] += toxic
    return vector


def orders(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """The rows of a part: each step of each order of filters."""
    every = np.arange(1 << len(FILTERS))
    bits = {f: every >> k & 1 == 1 for k, f in enumerate(FILTERS)}
    out, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        gone = np.zeros(len(every), dtype=bool)
        for step, f in enumerate(order, 1):
            here = bits[f] & ~gone
            redundant = int(vector[0, bits[f] & gone].sum())
            gone = gone | bits[f]
            removed, good, toxic = (int(v[here].sum()) for v in vector)
            shapley[f] += removed
            out.append((f, ("".join(order), step, int(vector[0, ~gone].sum()), removed, redundant, int(vector[0, 1 << FILTERS.index(f)]), good, toxic)))
    for f, row in out:
        yield (part, *row, shapley[f])


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row for each part, order of the filters and step of it: documents kept, removed, redundant (failed it but were
    gone), unique_fails (fail it alone), good_lost and toxic_lost (removed here), shapley (removed, over all orders)."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    labels = labels.groupBy(F.col(id_col).alias("id")).agg(is_one(good_col).alias("good"), is_one(toxic_col).alias("toxic"))
    rows = masks(docs, id_col, text_col, part_col).join(labels, "id", "left")
    rows = rows.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    vectors = rows.rdd.map(lambda r: (r[0], r[1:])).combineByKey(lambda row: counts([row]), tally, lambda a, b: a + b)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda kv: orders(*kv)), _OUT, verifySchema=False)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
     doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails FROM d LEFT JOIN l USING (doc_id)),
v AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f AS a, f AS b, f AS c, f AS d, f AS e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, [ascii(x) - 64 FOR x IN string_split(filter_order[1:step - 1], '') IF x <> ''] AS before, ascii(filter_order[step:step]) - 64 AS own FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS hit, len([k FOR k IN before IF fails[k]]) > 0 AS gone, len([x FOR x IN fails IF x]) AS failing FROM v, s),
g AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, any_value(own) AS own,
    CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (hit AND failing = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost
    FROM r GROUP BY part, filter_order, step)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
"""
