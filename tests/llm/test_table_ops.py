"""Media, vectors, mixing, joins, languages and the pipeline, against brute force."""

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import graph, jaccard, jpeg, langid, media, mixing, near_vectors, regions, shared, shingles

WORD = re.compile("[^\x20\x09-\x0d]+")


class Sets:
    """Least member of each linked group."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def tie(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# --- media ------------------------------------------------------------------------------------------------------------


def payloads():
    rnd = random.Random(3)
    return [media.padded(bytes(rnd.randrange(256) for _ in range(n))) for n in (0, 1, 191, 192, 193, 384, 385, 1000, 5000)]


def test_payloads_come_back():
    ps = payloads()
    files = jpeg.encode_payloads(ps)
    pictures, coef = jpeg.decode(files)
    assert [jpeg.payload_of(p, coef) for p in pictures] == ps
    assert [jpeg.encode_payloads([p])[0] for p in ps] == files
    for f, p in zip(files, ps):
        (one,), c = jpeg.decode([f])
        assert jpeg.payload_of(one, c) == p


def slow_blocks(coefs):
    """The inverse transform by its formula."""
    out = np.zeros((8, 8))
    grid = np.zeros(64)
    grid[jpeg.ZIGZAG] = coefs
    for y in range(8):
        for x in range(8):
            s = 0.0
            for v in range(8):
                for u in range(8):
                    cu, cv = (2**-0.5 if k == 0 else 1 for k in (u, v))
                    s += cu * cv / 4 * grid[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
            out[y, x] = s
    return out


def test_inverse_transform():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))
    rnd = np.random.default_rng(1)
    c = rnd.integers(-40, 40, (3, 64))
    got = jpeg.samples(c).reshape(3, 8, 8).astype(int)
    for k in range(3):
        assert np.abs(got[k] - np.clip(slow_blocks(c[k]) + 128, 0, 255)).max() <= 0.51


def write_scan(bits, table, tokens):
    """Huffman codes and raw bits of (symbol or None, value, bits)."""
    for symbol, value, n in tokens:
        if symbol is not None:
            code, size = table[symbol]
            bits.append((code, size))
        if n:
            bits.append((value, n))


def packed(bits):
    text = "".join(format(v, f"0{n}b") for v, n in bits if n)
    text += "1" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def test_general_scans():
    """A grey file with zeros, negative coefficients, runs over blocks and coefficients that appear in a refinement."""
    rnd = random.Random(5)
    blocks = [[rnd.choice([0] * 12 + [1, -1, 2, -3, 5]) if k else rnd.randint(-60, 60) for k in range(64)] for _ in range(6)]
    blocks[2][1:] = blocks[3][1:] = [0] * 63
    size = lambda v: abs(v).bit_length()
    raw = lambda v: v if v > 0 else v + (1 << size(v)) - 1
    dc, first, fine = (jpeg.TABLES[k][0] for k in ((0, 0), (1, 0), (1, 1)))
    scan_dc, before = [], 0
    for b in blocks:
        d = b[0] - before
        before = b[0]
        write_scan(scan_dc, dc, [(size(d), raw(d) if d else 0, size(d))])
    high = lambda v: (abs(v) >> 1) * (1 if v > 0 else -1)
    scan_first, run = [], 0

    def flush():
        nonlocal run
        if run:
            e = run.bit_length() - 1
            write_scan(scan_first, first, [(e << 4, run - (1 << e), e)])
            run = 0

    for b in blocks:
        zeros = 0
        last = max((k for k in range(1, 64) if high(b[k])), default=0)
        if last:
            flush()
        for k in range(1, last + 1):
            v = high(b[k])
            if not v:
                zeros += 1
                continue
            while zeros > 15:
                write_scan(scan_first, first, [(0xF0, 0, 0)])
                zeros -= 16
            write_scan(scan_first, first, [(zeros << 4 | size(v), raw(v), size(v))])
            zeros = 0
        if last < 63:
            run += 1
    flush()
    scan_fine = []
    for b in blocks:
        zeros, waiting = 0, []
        last = max((k for k in range(1, 64) if abs(b[k]) == 1), default=0)
        for k in range(1, last + 1):
            v = b[k]
            if abs(v) > 1:
                waiting.append((abs(v) & 1, 1))
            elif v == 0:
                zeros += 1
                if zeros == 16:
                    write_scan(scan_fine, fine, [(0xF0, 0, 0)])
                    scan_fine += waiting
                    zeros, waiting = 0, []
            else:
                write_scan(scan_fine, fine, [(zeros << 4 | 1, int(v > 0), 1)])
                scan_fine += waiting
                zeros, waiting = 0, []
        if last < 63:
            write_scan(scan_fine, fine, [(0, 0, 0)])
            scan_fine += waiting + [(abs(v) & 1, 1) for v in b[last + 1 :] if abs(v) > 1]
    frame = b"\x08" + (16).to_bytes(2, "big") + (20).to_bytes(2, "big") + b"\x01\x07\x11\x00"
    sos = lambda table, ss, se, a: jpeg._segment(0xDA, bytes([1, 7, table, ss, se, a]))
    data = b"\xff\xd8" + jpeg._DQT + jpeg._segment(0xC2, frame) + jpeg._DHT + sos(0, 0, 0, 0) + packed(scan_dc) + sos(0, 1, 63, 1) + packed(scan_first) + sos(1, 1, 63, 0x10) + packed(scan_fine) + b"\xff\xd9"
    (picture,), coef = jpeg.decode([data])
    assert coef.tolist() == blocks and jpeg.rgb(picture, coef).shape == (16, 20, 3)
    with pytest.raises(ValueError):
        jpeg.decode([b"GIF"])


def test_media_tables(spark):
    texts = ["", "abc", "é" * 500, None, "same", "same", "long " * 40_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, feature string")
    stored = media.store_payloads(df)
    out = {r.doc_id: r for r in media.read_payloads(stored).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = media.padded(raw)
        assert (out[i].n_bytes, out[i].payload_bytes, out[i].payload_sha256, out[i].tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert out[0].payload_bytes == 192 and out[0][2:] == out[3][2:] and out[4][2:] == out[5][2:]
    t = media.decode_tensors(stored.unionByName(spark.createDataFrame([(9, None, None)], stored.schema))).orderBy("doc_id").collect()
    assert all(len(r.rgb) == r.height * r.width * 3 for r in t[:-1]) and t[-1].rgb is None
    assert media.read_payloads(media.store_payloads(df.where("false"))).count() == 0


# --- vectors ----------------------------------------------------------------------------------------------------------


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "RESIDENTS", 16)
    monkeypatch.setattr(near_vectors, "VISITORS", 32)
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(160, 12))
    x[100:150] = x[:50] + rnd.normal(size=(50, 12)) * 0.12
    x[150:] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [None] * 12), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, n_links int")
    out = near_vectors.near_duplicate_vectors(df, cell=20).collect()
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i < 900 or i > 904]
    links, sets = Counter(), Sets([i for i, _ in rows])
    for a in range(len(good)):
        for b in range(a):
            (i, u), (j, v) = good[a], good[b]
            if len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9:
                links[i] += 1
                links[j] += 1
                sets.tie(i, j)
    for r in out:
        n = links[r.vec_id] // (2 if r.vec_id == 5 else 1) if r.vec_id == 5 else links[r.vec_id]
        assert (r.n_links, r.component_id, r.kept) == (n, sets.find(r.vec_id), sets.find(r.vec_id) == r.vec_id), r
    assert len(out) == len(rows) and near_vectors.near_duplicate_vectors(df.where("false")).count() == 0


def test_recall_at_the_threshold():
    """Pairs of cosine 0.9 exactly, the hardest: the visits of one find the other's home."""
    rnd = np.random.default_rng(3)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x = unit(rnd.normal(size=(4000, 64)))
    z = rnd.normal(size=x.shape)
    z = unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * z
    c = near_vectors.fit_centroids(x, 60)
    slack = 4 * np.sqrt((1 - 0.81) / 64)
    homes, visits = [], []
    for m in (x, y):
        d = m @ c.T
        homes.append(d.argmax(axis=1))
        visits.append(d >= 0.81 * d.max(axis=1, keepdims=True) - slack)
    lower = np.where(homes[0] < homes[1], visits[1][np.arange(4000), homes[0]], visits[0][np.arange(4000), homes[1]])
    assert (lower | (homes[0] == homes[1])).mean() > 0.999


def test_recall_in_few_directions():
    """The same for vectors that lie in 8 of 64 directions: the allowance follows what the sample shows."""
    rnd = np.random.default_rng(6)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    plane = np.linalg.qr(rnd.normal(size=(64, 8)))[0].T
    x = unit(rnd.normal(size=(4000, 8)))
    z = rnd.normal(size=x.shape)
    z = unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    x, y = x @ plane, (0.9 * x + np.sqrt(1 - 0.81) * z) @ plane
    c = near_vectors.fit_centroids(x, 60)
    e = near_vectors.effective_dimension(x, c)
    assert 4 < e < 9
    slack = 4 * np.sqrt((1 - 0.81) / e)
    homes, visits = zip(*((d.argmax(axis=1), d >= 0.81 * d.max(axis=1, keepdims=True) - slack) for d in (x @ c.T, y @ c.T)))
    lower = np.where(homes[0] < homes[1], visits[1][np.arange(4000), homes[0]], visits[0][np.arange(4000), homes[1]])
    assert (lower | (homes[0] == homes[1])).mean() > 0.999


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    sets = Sets(range(500))
    for a, b in edges:
        sets.tie(a, b)
    out = {r.node: r.component_id for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert out == {i: sets.find(i) for e in edges for i in e if e[0] != e[1]}


def plain_rgb(picture, coef):
    """Decoding by the formulas, in floating point and pixel by pixel where chroma is upsampled."""
    f = np.arange(8)
    basis = np.where(f == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * f[None, :] + 1) * f[:, None] * np.pi / 16)
    order, y, x = [], 0, 0
    for _ in range(64):  # the zigzag walk
        order.append((y, x))
        if (y + x) % 2 == 0:
            y, x = (y + 1, x) if x == 7 else (y, x + 1) if y == 0 else (y - 1, x + 1)
        else:
            y, x = (y, x + 1) if y == 7 else (y + 1, x) if x == 0 else (y + 1, x - 1)
    planes = []
    for c in picture.comps:
        plane = np.zeros((c.rows * 8, c.stride * 8))
        for b in range(c.rows * c.stride):
            grid = np.zeros((8, 8))
            for k, (gy, gx) in enumerate(order):
                grid[gy, gx] = coef[c.start + b][k] * c.quant.reshape(-1)[k]
            r, q = divmod(b, c.stride)
            plane[8 * r : 8 * r + 8, 8 * q : 8 * q + 8] = np.clip(np.round(basis.T @ grid @ basis + 128), 0, 255)
        planes.append(plane)
    h, v = max(c.h for c in picture.comps), max(c.v for c in picture.comps)
    out = np.zeros((picture.height, picture.width, 3))
    for i in range(picture.height):
        for j in range(picture.width):
            lum, cb, cr = (p[i * c.v // v, j * c.h // h] for p, c in zip(planes, picture.comps))
            out[i, j] = lum + 1.402 * (cr - 128), lum - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), lum + 1.772 * (cb - 128)
    return np.clip(np.round(out), 0, 255)


def test_tensors_by_formula(spark):
    """Tensors, and the features made of them, agree with a decoder that follows the formulas."""
    texts = ["word " * 150, "é" * 100, "", "".join(chr(33 + i % 90) for i in range(700))]
    rows = media.read_payloads(media.store_payloads(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))).collect()
    for r in rows:
        (picture,), coef = jpeg.decode(jpeg.encode_payloads([media.padded(texts[r.doc_id].encode())]))
        want = plain_rgb(picture, coef)
        got = np.frombuffer(r.rgb, dtype=np.uint8).reshape(r.height, r.width, 3)
        assert got.shape == want.shape and np.abs(got.astype(int) - want).max() <= 2
        size, means, crc = r.feature.split(":")
        assert size == f"{r.width}x{r.height}" and crc == f"{zlib.crc32(r.rgb):08x}"
        assert [int(m) for m in means.split(",")] == [int(got[..., k].sum(dtype=np.int64)) * 1000 // (r.height * r.width) for k in range(3)]


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rnd = random.Random(5)
    docs = [(i, "w " * rnd.randint(0, 30), rnd.choice(["a", "b", "c", None] + ["hot"] * 6)) for i in range(400)]
    docs += [(1000, None, "a"), (1001, "x", "tiny"), (1002, " \t\n", "empty"), (7, docs[7][1], docs[7][2]), (None, "a b", "b")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, size int")
    out = mixing.mix_sources(df).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += size(t)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rate > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * rate for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    source = {i: s for i, _, s in docs}
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 61 for s in names) and 0 <= sum(sizes.values()) - sum(taken.values()) <= 31
    again = mixing.mix_sources(df.repartition(5)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert mixing.mix_sources(df.where("false")).count() == 0 and mixing.mix_sources(df.where("source = 'empty'")).first().taken == 0


# --- Jaccard ----------------------------------------------------------------------------------------------------------


def plain_sets(text, width):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def plain_components(docs, width, percent):
    bags = [(i, plain_sets(t, width)) for i, t in docs]
    sets = Sets([i for i, _ in docs])
    for a in range(len(bags)):
        for b in range(a):
            common = len(bags[a][1] & bags[b][1])
            if common and common * 100 >= percent * (len(bags[a][1]) + len(bags[b][1]) - common):
                sets.tie(bags[a][0], bags[b][0])
    return {i: (len(s), sets.find(i)) for i, s in bags}


def copies(n=40, seed=6):
    rnd = random.Random(seed)
    words = [f"W{i}" for i in range(50)]
    base = [[rnd.choice(words) + str(rnd.randrange(30)) for _ in range(rnd.randint(30, 90))] for _ in range(n)]
    docs = []
    for b in base:
        for _ in range(rnd.choice([1, 1, 2, 12])):
            d = list(b)
            for _ in range(rnd.randint(0, 3)):
                d[rnd.randrange(len(d))] = f"new{rnd.randrange(999)}"
            docs.append("\t ".join(d) + ("\u00a0É" if rnd.random() < 0.2 else ""))
    return list(enumerate([*docs, "", None, " \n", "one", "ONE", "one two", "a b c d", "A b c\td"]))


@pytest.mark.parametrize("small, few", [(4096, 16), (4, 2)])
def test_jaccard(spark, monkeypatch, small, few):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "UNLINKED", 3)
    monkeypatch.setattr(jaccard, "OTHERS", 5)
    docs = copies()
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, n_shingles int")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert out == plain_components(docs, 4, 85)
    if small == 4096:
        assert jaccard.jaccard_components(df.where("false")).count() == 0
        twice = df.where("doc_id < 3").unionByName(df.where("doc_id < 3"))
        assert jaccard.jaccard_components(twice).count() == 6


def drifting(n=30, seed=9):
    """Chains in which each text is the one before and some words more, so that only neighbours are similar; ids at random."""
    rnd = random.Random(seed)
    texts = []
    for k in range(n):
        words = [f"c{k}w{i}" for i in range(200)]
        size = rnd.randint(30, 40)
        for _ in range(5):
            texts.append(" ".join(words[:size]))
            size += -(-size * rnd.randint(10, 14) // 100)
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_region_labels():
    """All orders of a chain of five: a tie moves what earlier ones have tied as a whole."""
    chain = [np.arange(n, dtype=np.uint64) for n in (40, 45, 51, 57, 64)]
    for order in itertools.permutations(range(5)):
        assert jaccard.region_labels([chain[k] for k in order], 85).tolist() == [0] * 5, order


@pytest.mark.parametrize("small", [4096, 4])
def test_drifting_chains(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    docs = drifting()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = plain_components(docs, 4, 85)
    assert max(Counter(c for _, c in want.values()).values()) == 5
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()} == want


def crowd(seed=3):
    """Near copies of a few texts, in many small steps, all with one long passage in common: one area with far members."""
    rnd = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    docs = []
    for k in range(12):
        base = [f"k{k}w{i}" for i in range(rnd.randint(40, 60))]
        for _ in range(rnd.choice([2, 6, 25])):
            d = list(base)
            for _ in range(rnd.randint(0, 6)):
                d[rnd.randrange(len(d))] = f"new{rnd.randrange(99999)}"
            docs.append(" ".join(passage + d))
    rnd.shuffle(docs)
    return list(enumerate(docs))


def test_metric_regions():
    """At default parameters regions are split by pivots again and again, with copies and windows, and nothing is lost."""
    texts = [t for _, t in copies(200) if t]
    sets = [s for s in shingles.shingle_sets(texts, 4) if len(s)]
    region = regions.Region(sets, 85)
    label = region.join()
    want = Sets(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if common * 100 >= 85 * (len(sets[a]) + len(sets[b]) - common):
                want.tie(a, b)
    assert label.tolist() == [want.find(i) for i in range(len(sets))]
    assert region.done["regions"] > 3 and region.done["deepest"] > 1 and region.done["copies"] > 0 and region.done["left out"] > 0


@pytest.mark.parametrize("small, levels, splits", [(40, 6, 1), (4, 2, 2), (4, 0, 0)])
def test_split_regions(spark, monkeypatch, small, levels, splits):
    """Distributed steps: regions split over several levels, and blocks where levels end."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    monkeypatch.setattr(jaccard, "DEALT", 20)
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(jaccard, "OTHERS", 16)
    docs = crowd()
    calls = Counter()
    for name in ("_split", "_blocks", "_within_tasks"):
        monkeypatch.setattr(jaccard, name, lambda *a, f=getattr(jaccard, name), n=name: calls.update([n]) or f(*a))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert out == plain_components(docs, 4, 85)
    assert calls["_split"] >= splits and bool(calls["_blocks"]) >= (levels == 0)


def test_one_id_two_texts(spark):
    """Rows that repeat an id with other texts are one document: it ties what either text is similar to."""
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    docs = [(5, " ".join(a)), (5, " ".join(b)), (2, " ".join([*a, "x"])), (9, " ".join([*b, "y"])), (None, " ".join(a)), (7, "z z")]
    out = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string")).select("doc_id", "component_id").collect()), key=repr)
    assert [c for i, c in out if i in (2, 5, 9)] == [2] * 4 and (7, 7) in out


def test_shingle_counts():
    texts = [t or "" for _, t in copies()] + ["x" * 100_000 + " y", "ab cd\x0bef\x0cgh"]
    assert [len(s) for s in shingles.shingle_sets(texts, 4)] == [len(plain_sets(t, 4)) for t in texts]
    a, b = shingles.shingle_sets(["A b c d e"], 4)[0], shingles.shingle_sets(["zz a B c\nd e", ""], 4)[0]
    assert len(np.intersect1d(a, b)) == 2


# --- languages --------------------------------------------------------------------------------------------------------


def test_learning_rows(spark):
    """An id that repeats a thousand times, with equal and with other texts, gives no more rows than are asked for."""
    docs = [(4, "the same text", "en")] * 1000 + [(4, f"text {i}", "en") for i in range(1000)] + [(i, f"ein Text {i}", "de") for i in range(30)]
    docs += [(1, None, "en"), (3, "kein Name", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(4)
    rows = langid.learning_rows(df, 50, "doc_id", "text", "lang").collect()
    allowed = [i for i in range(30) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert zlib.crc32(b"4") % 4 != 2
    assert Counter(r.lang for r in rows) == {"en": 50, "de": len(allowed)}
    assert len({(r.lang, r.text) for r in rows}) == len(rows) and sorted(r["rank"] for r in rows if r.lang == "en") == list(range(1, 51))


def test_predictions_by_hand(spark):
    """Fitting in groups gives the machines that one fit gives, and prediction what a loop over n-grams gives."""
    words = {"en": "the and of house", "de": "das und von haus", "es": "los y de casa", "fr": "les et du maison"}
    rnd = random.Random(8)
    text = lambda lang: " ".join(rnd.choice(words[lang].split()) for _ in range(12))
    docs = [(i, text(lang), lang) for i, lang in enumerate(list(words) * 12)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(3)
    model = langid.fit_language_model(df)
    assert model.pairs == [(None, "germanic", "romance"), ("germanic", "de", "en"), ("romance", "es", "fr")]
    rows = sorted(langid.learning_rows(df, 500, "doc_id", "text", "lang").collect(), key=lambda r: (r.lang, r["rank"]))
    for k, (_, a, b) in enumerate(model.pairs):
        side = {lang: s for lang, m, s, _ in model.sides() if m == k}
        mine = sorted((r for r in rows if r.lang in side), key=lambda r: (side[r.lang], r.lang, r["rank"]))
        w, bias = langid.fit_machine(langid.features([r.text for r in mine]), np.array([side[r.lang] for r in mine], dtype=np.float32))
        assert np.allclose(w, model.weights[:, k], atol=1e-5) and abs(bias - model.bias[k]) < 1e-9
    some = ["", "...", "12", "Das Haus, und das Haus!", "LES MAISON\n\net", "x", "é" * 5000, text("es"), text("en") * 300]
    for t, lang, score in zip(some, *model.predict(some)):
        if not any(c.isalpha() for c in t):
            assert (lang, score) == ("und", 0.0)
            continue
        ids = langid.grams([t])[0]
        margin = [sum(model.weights[i, k] for i in ids) / len(ids) + model.bias[k] for k in range(3)]
        family = 1 if margin[0] >= 0 else 2
        want = model.pairs[family][1] if margin[family] >= 0 else model.pairs[family][2]
        assert lang == want and 0 <= score <= 1


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_language_model(docs)
    out = langid.identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.where("lang = lang_pred").count() / held.count() > 0.97
    assert out.where("score < 0 or score > 1").count() == 0
    odd = spark.createDataFrame([(1, None, 1), (2, "12 !?", 1), (3, "", 1), (4, "中文", 1), (5, "the " * 50_000, 1), (6, "the " * 50_000, 1)], "doc_id bigint, text string, score int")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in {"de", "en", "es", "fr"} and got[5] == got[6]
    none = langid.fit_language_model(docs.where("false"))
    assert langid.identify_languages(odd, none).where("lang_pred <> 'und'").count() == 0
    want = {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert {r.doc_id for r in held.collect()} == want


# --- the pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(90_001, "12 34", None, None, 5), (90_002, None, "en", "src0", 0), (90_003, "password = abcdefghijklmnop and some words", "en", "src0", 43)], docs.schema)
    docs = docs.unionByName(odd)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        kept[name] = docs.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    first = {r.doc_id for r in kept["language"]}
    assert not first & {90_001, 90_002} and 90_003 in first
    comps = plain_components([(r.doc_id, r.text) for r in kept["language"]], 5, 80)
    assert {r.doc_id for r in kept["near_duplicates"]} == {i for i, (_, c) in comps.items() if i == c}
    assert len(kept["secrets"]) == len(kept["near_duplicates"]) and {r.doc_id: r.text for r in kept["secrets"]}[90_003] == "[secret] and some words"
    sizes = {r.doc_id: len(WORD.findall(r.text)) for r in kept["secrets"]}
    times = Counter(r.doc_id for r in kept["mixture"])
    assert max(times.values()) <= 3 and abs(sum(sizes[i] * n for i, n in times.items()) - sum(sizes.values())) < max(sizes.values())
    assert len(kept["tokens"]) == len(kept["mixture"]) and all(hashlib.sha256(r.text.encode()).hexdigest() in {t.decoded_sha256 for t in kept["tokens"]} for r in kept["mixture"][:5])
    assert F is not None


def test_pipeline_keeps_rows_of_null_and_repeated_ids(spark, sf_dir):
    """Each row is decided by itself, whatever its id is."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(11)
    prose = lambda: " ".join(rnd.choice("the river runs under old stone bridges while children play near quiet water".split()) + rnd.choice("abcdefgh") for _ in range(40))
    key = "password = abcdefghijklmnop"
    rows = [(i, prose(), lang) for i, lang in enumerate(["en", "de"] * 6)]
    near = prose()
    rows += [(None, prose(), None), (None, f"{prose()} {key}", "en"), (50, prose(), "en"), (50, prose(), "en"), (50, f"{prose()} {key}", None)]
    lost = [(None, "12 34", "en"), (50, "56 !", "en"), (None, None, None)]
    copies = [(None, f"{near} end", "en"), (61, near, "en"), (60, f"{near} last", "en"), (50, rows[14][1], "en")]
    same = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df)
    expect = lambda kept: sorted((i is None, i or 0, t) for i, t, *_ in kept)
    docs = spark.createDataFrame([(i, t, lang, "src0", len(t or "")) for i, t, lang in rows + lost + copies], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        steps[name] = out.collect()
        docs = spark.createDataFrame(steps[name], out.schema)
    assert same(steps["language"]) == expect(rows + copies) and all(r.lang for r in steps["language"])
    kept = rows + copies[2:3]
    assert same(steps["near_duplicates"]) == expect(kept)
    clean = [(i, t.replace(key, "[secret]")) for i, t, _ in kept]
    assert same(steps["secrets"]) == same(steps["mixture"]) == expect(clean)
    assert all(r.n_chars == len(r.text) for r in steps["secrets"])
    assert sorted(r.decoded_sha256 for r in steps["tokens"]) == sorted(hashlib.sha256(t.encode()).hexdigest() for _, t in clean)


def test_pipeline_edges(spark, sf_dir):
    """Empty tables stay empty in each stage; null sources, extra columns with the names of results and very long texts pass."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, component_id bigint, spans string, taken bigint, n_tokens bigint, row bigint"
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
    rnd = random.Random(13)
    prose = lambda n: " ".join(rnd.choice("ein und der water stone bridge über".split()) + rnd.choice("abcdefgh") for _ in range(n))
    rows = [(i, prose(40), lang, None, 9, "x", 1, "y", 2, 3, 4) for i, lang in enumerate(["en", "de"] * 5)] + [(77, prose(60_000), "en", None, 9, "x", 1, "y", 2, 3, 4)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        assert {r.doc_id for r in got} == {r[0] for r in rows}, name
        if name != "tokens":
            assert out.columns == corpus_pipeline.COLUMNS and all(r.source is None for r in got)
            docs = spark.createDataFrame(got, out.schema).withColumns({c: F.lit(1) for c in ("lang_pred", "component_id", "spans", "taken", "n_tokens", "row")})


def test_written_tables_leave_no_shuffle_files(spark):
    """A query that writes a table deletes its shuffle files when it ends, and what the session sets stays."""
    import time

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before, until = files(), time.time() + 20
    found = shared.durable(spark.range(10_000).repartition(7).groupBy((F.col("id") % 100).alias("k")).count(), kept := [])
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(key) == "false"
    assert found.count() == 100
    shared.discard(spark, kept)


def test_pipeline_numbers_rows_of_files_without_a_copy(spark, sf_dir, tmp_path, monkeypatch):
    """Rows of Parquet files are known by their places; files that are given twice, and other plans, are written first."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    written = []
    monkeypatch.setattr(corpus_pipeline, "durable", lambda df, *a: written.append(1) or shared.durable(df, *a))
    path, more = f"{sf_dir}/documents.parquet", str(tmp_path / "more documents %41")
    docs = spark.read.parquet(path)
    docs.repartition(3).write.parquet(more)
    every = sorted(map(tuple, docs.select(*corpus_pipeline.COLUMNS).collect()), key=repr)
    for given, times, copies in ((docs, 1, 0), (spark.read.parquet(path, more), 2, 0), (spark.read.parquet(path, path), 2, 1), (docs.unionByName(docs), 2, 1), (docs.crossJoin(spark.range(2)), 2, 1)):
        written.clear()
        got = corpus_pipeline._numbered(given).collect()
        assert len({r.row for r in got}) == len(got) and len(written) == copies
        assert sorted((tuple(r)[1:] for r in got), key=repr) == sorted(every * times, key=repr)


def test_language_edges(spark):
    """An empty table gives none, repeated rows repeat, and clashing columns are ignored."""
    schema = "doc_id bigint, text string, lang string, lang_pred string, score int, held_out string"
    docs = [(i, t, lang, "x", 1, "y") for i, (t, lang) in enumerate([("the and of house", "en"), ("das und von haus", "de")] * 8)]
    df = spark.createDataFrame(docs + docs[:2], schema)
    model = langid.fit_language_model(df)
    out = Counter(map(tuple, langid.identify_languages(df, model).collect()))
    assert sum(out.values()) == 18 and max(out.values()) == 2 and {r[2] for r in out} == {"en", "de"}
    assert langid.identify_languages(df.where("false"), model).count() == 0


def test_sets_and_distances_take_little_memory(monkeypatch):
    """Peaks of Python's and numpy's memory, for texts of 2 MB together and for long sets that are not linked."""
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**7, 2500).tolist())) for _ in range(100)]
    sets = [np.sort(rng.integers(0, 2**63, 20_000).astype(np.uint64)) for _ in range(40)]

    def peak(f):
        tracemalloc.start()
        out = f()
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, found

    cut, small = peak(lambda: shingles.shingle_sets(texts, 5))
    assert small < 30_000_000
    monkeypatch.setattr(shingles, "STEP", 10**9)
    assert all((a == b).all() for a, b in zip(cut, shingles.shingle_sets(texts, 5), strict=True))
    (far, link), small = peak(lambda: regions.distances(sets, sets[:3], 80))
    assert small < 60_000_000 and link.sum() == 3 and (far[link] == 0).all()
    monkeypatch.setattr(regions, "CELLS", 10**12)
    assert (far == regions.distances(sets, sets[:3], 80)[0]).all()
