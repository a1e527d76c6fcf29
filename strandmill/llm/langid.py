"""Language identification in two levels: a language family first, then the languages of that family pair by pair.

Texts become relative frequencies of hashed byte 2- and 3-grams of their lower-cased letters.  Linear support vector
machines (squared hinge loss) separate the families, one against one, and within each family its languages, one against
one.  A text's margin is the mean of its n-grams' weights, so prediction is one table look-up per n-gram over the whole
text.  At most `per_language` different labelled rows of each language are learned from, those with the least hash of
id and text.  Each machine is a group that one task fits, from a bounded number of these rows; the driver gets weights
only, and they are broadcast for prediction.  A family of more than FAMILY languages is taken in parts of so many, each a
family of its own, so machines grow with a sixteenth of the pairs of families and not with all pairs of languages: 1,000
unlisted languages make 9,400 machines of 16 KB.  More than MODEL bytes of weights are an error before anything is fitted.

Defined results: a null text, or one without a letter, is `und` with score 0, as is everything if no labelled document
exists; equal texts get equal results; repeated rows give repeated rows, and are learned from once; columns other than
those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, text_slices, texts_of

BUCKETS = 4096
#: Languages of a family, and bytes of all weights, at most.
FAMILY, MODEL = 16, 1 << 30
PER_LANGUAGE = 500
#: Rows of one side of a machine, at most; a family's languages share them.
PER_SIDE = 1000
#: Families of languages by ISO 639-1 code; a code that is not listed is a member of the family "other".
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca es fr gl it la lad oc pt ro rm sc",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "uralic": "et fi hu se",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "semitic": "am ar he mt",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "bn gu hi mr ne pa sd si ur",
}
_LETTER = regex.compile(r"\p{L}")
_BLANK = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_SLICE = 1_000_000


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams, and where each text's begin; blanks around texts keep each from its neighbours."""
    raw = [b"  " + t.lower().encode().translate(_BLANK) + b" " for t in texts]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    b = np.frombuffer(b"".join([*raw, b"  "]), dtype=np.uint8).astype(np.uint32)
    two = b[:-2] * np.uint32(2654435761) + b[1:-1] * np.uint32(2246822519)
    three = two * np.uint32(3266489917) + b[2:] * np.uint32(668265263)
    out = np.empty(2 * len(two), dtype=np.int32)
    out[0::2] = (two ^ two >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(20)
    out[1::2] = (three ^ three >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(20)
    starts = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    return out, 2 * starts


def features(texts: list[str]) -> np.ndarray:
    """Relative frequencies of the buckets, a row for each text."""
    ids, starts = grams(texts)
    out = np.empty((len(texts), BUCKETS), dtype=np.float32)
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
        out[i] = np.bincount(ids[a:b], minlength=BUCKETS) / (b - a)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine: accelerated gradient steps on squared hinge loss, both classes weighing the same."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    rate = 1 / (2 * float((share * (np.einsum("ij,ij->i", x, x) + 1)).sum()) + strength)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v[:-1].astype(x.dtype) + v[-1])) * y * share
        step = np.append(2 * (slack.astype(x.dtype) @ x), 2 * slack.sum()) - strength * np.append(v[:-1], 0)
        new = v + rate * step
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit_machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """fit_svm() on features scaled to like spread; the weights are for features as they are."""
    scale = 1 / (np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + 1e-4) / np.sqrt(x.shape[1])
    w, bias = fit_svm(x * scale.astype(np.float32), y)
    return w * scale, bias


class LanguageModel:
    """Machines for pairs of families and for pairs of languages within a family."""

    def __init__(self, languages: list[str]):
        of = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
        self.families: dict[str, list[str]] = {}
        for lang in sorted(languages):
            self.families.setdefault(of.get(lang.lower().split("-")[0], "other"), []).append(lang)
        for name, members in list(self.families.items()):
            if len(members) > FAMILY:
                del self.families[name]
                self.families |= {f"{name} {k // FAMILY:04d}": members[k : k + FAMILY] for k in range(0, len(members), FAMILY)}
        names = sorted(self.families)
        self.pairs = [(None, a, b) for a, b in combinations(names, 2)]
        self.pairs += [(f, a, b) for f in names for a, b in combinations(self.families[f], 2)]
        if 4 * BUCKETS * len(self.pairs) > MODEL:
            raise ValueError(f"{len(languages)} languages need {len(self.pairs)} machines, more than {MODEL} bytes of weights")
        #: A column for each machine, stored together.
        self.weights = np.zeros((BUCKETS, len(self.pairs)), dtype=np.float32, order="F")
        self.bias = np.zeros(len(self.pairs))
        self.machines: dict[str | None, list[int]] = {}
        for k, (within, _, _) in enumerate(self.pairs):
            self.machines.setdefault(within, []).append(k)

    def sides(self, per_side: int = PER_SIDE) -> list[tuple[str, int, int, int]]:
        """Per language and machine that learns from it: language, machine, side (1 or -1), and how many rows it takes."""
        out = []
        for k, (within, a, b) in enumerate(self.pairs):
            for name, side in ((a, 1), (b, -1)):
                members = self.families[name] if within is None else [name]
                out += [(lang, k, side, max(1, per_side // len(members))) for lang in members]
        return out

    def _best(self, within: str | None, names: list[str], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts, given by their n-grams: number of the name with most votes in its pairs (then the largest sum of margins),
        and a score from 0 to 1."""
        sizes = np.diff(np.append(starts, len(ids)))
        votes, sums, sure = (np.zeros((len(starts), len(names))) for _ in range(3))
        at = {n: i for i, n in enumerate(names)}
        for k in self.machines.get(within, []):
            m = np.add.reduceat(self.weights[:, k][ids], starts, dtype=np.float64) / sizes + self.bias[k]
            for name, sign in zip(self.pairs[k][1:], (1, -1)):
                votes[:, at[name]] += sign * m > 0
                sums[:, at[name]] += np.clip(sign * m, -9, 9)
                sure[:, at[name]] += np.log1p(np.exp(-np.clip(3 * sign * m, -30, 30)))
        best = np.argmax(votes + sums / (20 * len(names)), axis=1)
        return best, np.exp(-sure[np.arange(len(starts)), best])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Family by family: a text meets the machines of its own family only."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if self.families and _LETTER.search(t)]
        if not some:
            return langs, scores
        ids, starts = grams([texts[i] for i in some])
        ends = np.append(starts[1:], len(ids))
        names = sorted(self.families)
        family, p = self._best(None, names, ids, starts)
        for f, name in enumerate(names):
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            members, own = self.families[name], ends[rows] - starts[rows]
            first = np.cumsum(own) - own
            mine = ids if len(rows) == len(some) else ids[np.repeat(starts[rows] - first, own) + np.arange(own.sum())]
            best, q = self._best(name, members, mine, first)
            for r, b, s in zip(rows, best, p[rows] * q):
                langs[some[r]], scores[some[r]] = members[b], float(min(1.0, s))
        return langs, scores


def held_out(id_col: str):
    """Whether a document is kept from learning: crc32 of its id's text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learning_rows(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows (lang, text, rank): of each language at most per_language different labelled rows that are not held out.

    The number of a language's different rows tells below which hash about twice as many lie; only these move and are
    ranked, so neither a frequent language nor an often repeated row makes a large task.  There is one such number for
    each language, as there are machines for each pair of them, so these are broadcast.
    """
    spark = docs.sparkSession
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    named = named.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"))
    sizes = [tuple(r) for r in named.groupBy("lang").agg(F.approx_count_distinct("h").alias("many")).collect()]
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language + 100) / F.greatest("many", F.lit(1)))
    # Shifted by 11 bits a hash is a whole number below 2**53, which a double holds exactly.
    few = named.join(F.broadcast(spark.createDataFrame(sizes, "lang string, many bigint")), "lang").where(F.shiftrightunsigned("h", 11) < share * float(1 << 53))
    few = few.groupBy("lang", "h").agg(F.min("text").alias("text"))
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= per_language).select("lang", "text", "rank")


def fit_language_model(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on at most per_language labelled rows of each language that are not held out."""
    spark = docs.sparkSession
    rows = learning_rows(docs, per_language, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", _SLICE):
                for at in range(0, part.num_rows, 500):
                    some = part.slice(at, 500)
                    x = pa.array([r.tobytes() for r in features(texts_of(some, "text"))], pa.binary())
                    yield pa.RecordBatch.from_arrays([some.column("lang"), some.column("rank"), x], ["lang", "rank", "x"])

    learned = durable(rows.mapInArrow(run, "lang string, rank int, x binary"))
    model = LanguageModel([r.lang for r in learned.select("lang").distinct().collect()])
    if not model.pairs:
        return model
    sides = spark.createDataFrame(model.sides(), "lang string, machine int, side int, most int")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "lang", "rank"])
        w, bias = fit_machine(np.vstack([np.frombuffer(x, dtype=np.float32) for x in rows["x"]]), rows["side"].to_numpy(dtype=np.float32))
        return pd.DataFrame({"machine": rows["machine"].iloc[:1], "weights": [w.astype(np.float32).tobytes()], "bias": [bias]})

    taken = learned.join(F.broadcast(sides), "lang").where("rank <= most")
    for r in taken.groupBy("machine").applyInPandas(fit, "machine int, weights binary, bias double").toLocalIterator():
        model.weights[:, r.machine] = np.frombuffer(r.weights, dtype=np.float32)
        model.bias[r.machine] = r.bias
    return model


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns of `keep`, held_out, lang_pred and score."""
    carried = [id_col, *keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried) + ", held_out boolean, lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in text_slices(batch, text_col, _SLICE):
                langs, scores = known.predict(texts_of(part, text_col))
                yield pa.RecordBatch.from_arrays([*map(part.column, carried), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*carried, "held_out", "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*carried, text_col]), held_out(id_col).alias("held_out")).mapInArrow(run, schema)
