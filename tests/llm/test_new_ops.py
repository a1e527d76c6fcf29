"""Repeated word sequences, the audit of filters and fill-in-middle, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from strandmill.llm import filter_audit, middle, substrings


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_repeats(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for k in range(i, i + width)}
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def repeat_texts(n, seed=3):
    """Few words, so that windows meet by chance; passages, copies, runs of one word and odd white space."""
    rnd = random.Random(seed)
    passage = " ".join(rnd.choice("abcdef") for _ in range(30))
    texts = [None, "", " \t\n", "one two", "x " * 40, "é\x0bü\x1c \xa0a b", passage]
    for _ in range(n):
        t = "".join(rnd.choice(["a", "b", "ab", "ü", "A"]) + rnd.choice([" ", "\n", "\t ", "\r\n"]) for _ in range(rnd.randint(0, 30)))
        texts.append(t + passage + " " + t[::-1] if rnd.random() < 0.3 else t)
    return texts + texts[:20] + [passage] * 9


@pytest.mark.parametrize("width, cells", [(1, 1 << 20), (3, 64), (5, 1 << 20), (12, 1 << 20), (35, 1 << 20)])
def test_repeats(spark, width, cells):
    texts = repeat_texts(120)
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id bigint, text string, kept string, n_words int").repartition(3)
    out = {r.doc_id: r for r in substrings.remove_repeats(docs, width, keep=("kept", "n_words"), cells=cells).toDF("doc_id", "was", "number", "n_words", "n_removed", "kept", "removed").collect()}
    assert len(out) == len(texts)
    for i, want in enumerate(plain_repeats(texts, width)):
        r = out[i]
        assert (r.n_words, r.n_removed, r.kept) == want and (r.was, r.number) == ("x", 7)
        words = (texts[i] or "").encode().split()
        assert sum(n for _, n in r.removed) == r.n_removed
        assert r.kept == b" ".join(w for k, w in enumerate(words) if not any(a <= k < a + n for a, n in r.removed)).decode()


def test_repeats_of_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert substrings.remove_repeats(spark.createDataFrame([], schema), 3).count() == 0
    rows = [(None, "a b c d"), (None, "a b c d"), (1, "x a b c"), (1, "p q r s"), (1, "p q r s"), (2, "nothing like it here")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, schema), 3).collect()
    assert sorted((r.kept, r.n_removed) for r in got) == [("", 4)] * 4 + [("nothing like it here", 0), ("x", 3)]


def test_a_long_text_repeats_itself(spark):
    rnd = random.Random(1)
    words = [str(rnd.randint(0, 10**6)) for _ in range(400_000)]
    words[300_000:300_100] = words[5:105]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[200:234]))], "doc_id bigint, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert got[1].removed == [[5, 100], [300_000, 100]] and got[2].n_removed == 0


def test_windows_of_a_task():
    """Hashes that a task has several times ask no one: their places are sure, and one of them goes on."""
    h = np.array([5, 7, 5, 9, 5, 7], dtype=np.uint64)
    d = np.array([1, 1, 1, 1, 2, 2], dtype=np.int64)
    pos = np.array([0, 1, 2, 3, 0, 1], dtype=np.int32)
    rows = [r for b in substrings._settled([(h, h, d, d, pos)], True) for r in b.to_pylist()]
    sent = {r["h1"]: r["d2"] & 1 == 1 for r in rows if r["h1"] is not None}
    sure = {r["d1"]: np.frombuffer(r["sure"], dtype=np.int32).reshape(-1, 2).tolist() for r in rows if r["sure"] is not None}
    assert sent == {5: False, 7: False, 9: True} and sure == {1: [[0, 3]], 2: [[0, 2]]}


def test_sketch_never_counts_too_little():
    keys = np.random.default_rng(4).integers(0, 2**64, 3000, dtype=np.uint64)
    twice = keys[:500]
    for cells in (1 << 12, 1 << 21):
        sums = np.zeros(cells * substrings.ROWS + substrings.BLOCK, dtype=np.int64)
        for part in (keys, twice):
            for b in substrings._blocks(part, cells):
                for r in b.to_pylist():
                    at = r["block"] * substrings.BLOCK
                    sums[at + np.frombuffer(r["once"], dtype=np.uint32)] += 1
                    sums[at + np.frombuffer(r["more"], dtype=np.uint32)] += 2
        blocks = [(k, zlib.compress(np.packbits(sums[k * substrings.BLOCK : (k + 1) * substrings.BLOCK] > 1).tobytes())) for k in range(len(sums) // substrings.BLOCK)]
        maybe = substrings.Sketch(blocks, cells).maybe(keys)
        assert maybe[:500].all()
    assert maybe.sum() < 520


def plain_audit(docs, labels):
    """docs: (id, text, lang)."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    least = {}
    big = lambda i: (i is None, i or 0)
    for i, t, _ in docs:
        least[t or ""] = min(least.get(t or "", big(i)), big(i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": big(i) > least[t]}
        rows.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = set()
    for part in {r[0] for r in rows}:
        mine, sums, steps = [r for r in rows if r[0] == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order, 1):
                left = [r for r in mine if not r[1] & set(order[: k - 1])]
                here = [r for r in left if f in r[1]]
                sums[f] += len(here)
                redundant = sum(f in r[1] for r in mine) - len(here)
                steps.append((part, order, k, len(left) - len(here), len(here), redundant, sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)))
        out |= {(*s, sums[s[1][s[2] - 1]]) for s in steps}
    return out


def audit_docs(n):
    rnd = random.Random(5)
    docs = []
    for i in range(n):
        w = [str(rnd.randint(0, rnd.choice([30, 10**6]))) for _ in range(rnd.choice([3, 90, 99, 100, 130]))]
        t = rnd.choice([" ", "\n", "\x0b"]).join(w) + rnd.choice(["", " $", "É" * 30, " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 4])
        docs.append((i, t, rnd.choice(["en", "de", "", None])))
    docs += [(n + k, docs[k % 7][1], "en") for k in range(40)] + [(None, docs[0][1], "de"), (None, docs[0][1], "de"), (None, "only here", None), (3, docs[3][1], "de"), (900, None, "en"), (901, "", "en")]
    return docs


def test_audit(spark):
    docs = audit_docs(60)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 90, 2)] + [(2, None, 1), (4, 1, None), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, lang string, quality int, part string").repartition(5)
    got = filter_audit.audit_filters(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    rows = [tuple(r) for r in got.collect()]
    labels = [x for x in labels if x[0] is not None]
    assert len(rows) == len(set(rows)) and set(rows) == plain_audit(docs, labels)
    none = filter_audit.audit_filters(frame.where("false"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert none.count() == 0 and none.columns == got.columns


def test_colliding_texts_stay_apart():
    """Two texts of one fingerprint form a chain of two; the least id of each is no copy."""
    chains = filter_audit.Chains()
    lost = [chains.add(1, raw, i, [("p", i or 0)]) for raw, i in [(b"a", 5), (b"b", 4), (b"a", 3), (b"b", 9), (b"a", None), (b"a", 3)]]
    assert lost == [[], [], [(5, "p", 5)], [(9, "p", 9)], [(None, "p", 0)], []]
    assert [(k, e[0], e[1], e[2]) for k, e in chains.drain()] == [(1, b"a", 3, [("p", 3), ("p", 3)]), (1, b"b", 4, [("p", 4)])]


def plain_middle(i, t, keep=90, spm=20):
    t = t or ""
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= keep:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def middle_texts():
    rnd = random.Random(6)
    bits = ["a", "é", "中", "😀", " ", "\n", "<", ">", "P", "S", "<P", "M>", "<P>", "́", "xyz"]
    texts = [None, "", "a", "<", "<P>", "<S", "M>", "😀", "a" * 300_000 + "中"]
    return texts + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(600)] + ["same", "same"]


@pytest.mark.parametrize("keep, spm", [(90, 20), (100, 100), (100, 0), (0, 50)])
def test_middle(spark, keep, spm):
    texts = middle_texts()
    rows = [(None if i == 5 else i, t, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h string, output string")
    got = middle.fill_in_middle(docs, keep=keep, spm=spm, keep_cols=("h",)).collect()
    assert len(got) == len(texts) and all(r.h == "x" for r in got)
    found = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got}
    for i, t, *_ in rows:
        assert found[i] == plain_middle(i, t, keep, spm)
    assert {r.doc_id: r.restored for r in got} == {i: t or "" for i, t, *_ in rows}
    assert middle.fill_in_middle(docs.where("false")).count() == 0


def test_middle_of_words(spark):
    """Cuts lie where words begin, or at the end."""
    texts = ["one two  three", " lead in", "\ttab\nnew ", "word", "   ", "é ü\x0bß"] * 5
    got = middle.fill_in_middle(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), keep=100, unit="word").collect()
    for r in got:
        t = texts[r.doc_id]
        assert r.restored == t and r.n == len(t.encode().split())
        cut = dict(zip("PSM", (r.output.split(f"<{m}>")[1].split("<")[0] for m in "PSM"))) if r.form != "plain" else None
        if cut:
            assert len(cut["M"].split()) == r.middle_chars and len((cut["P"]).split()) == r.prefix_chars
    with pytest.raises(ValueError):
        middle.fill_in_middle(spark.range(1), unit="line")


def test_slices_of_arrow_strings():
    texts = pa.array(["no", "é", None, "", "<P>x", "中<M>"]).slice(1)
    data, ends = middle.buffers(texts)
    assert data.tobytes().decode() == "é<P>x中<M>" and ends.tolist() == [0, 2, 2, 2, 6, 12]
    at, which, row = middle.marks(data, ends)
    assert (at.tolist(), which.tolist(), row.tolist()) == ([2, 9], [0, 2], [3, 4])
    # Two neighbouring rows do not make a mark together.
    assert len(middle.marks(*middle.buffers(pa.array(["<", "P>", "<S", ">"])))[0]) == 0


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op13_fill_in_middle"])
def test_queries_on_given_documents(spark, sf_dir, name):
    from strandmill.llm import registry

    docs = [(r.doc_id, r.text) for r in registry.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in registry.queries()[name](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    if name.startswith("op11"):
        for (i, _), (n, gone, kept) in zip(docs, plain_repeats([t for _, t in docs], 35)):
            assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, gone, sha(kept))
    else:
        for i, t in docs:
            n, form, a, b, out = plain_middle(i, t)
            assert (got[i].n, got[i].form, got[i].prefix_chars, got[i].middle_chars) == (n, form, a, b)
            assert (got[i].output_sha256, got[i].restored_sha256) == (sha(out), sha(t))


def test_audit_on_given_documents(spark, sf_dir):
    from strandmill.llm import registry

    docs = [tuple(r) for r in registry.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in registry.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").collect()]
    assert {tuple(r) for r in registry.op12_filter_audit(spark, sf_dir).collect()} == plain_audit(docs, labels)


def test_secrets_of_a_whole_scope():
    from strandmill.llm import credentials

    weak = "ASIAIOSFODNN7EXAMPLE"
    far = f"{weak}{' ' * 5000}secret = abcdefghijklmnop"
    assert [s[0] for s in credentials.all_spans(far, None)[1]] == ["weak_access", "assign"]
    assert [s[0] for s in credentials.all_spans(far.replace(" " * 5000, "\n\n"), None)[1]] == ["assign"]


def test_many_languages():
    """Families are split, so machines stay few; a text meets those of its own family."""
    from strandmill.llm.langid import BUCKETS, LanguageModel

    many = LanguageModel([f"x{k:03d}" for k in range(1000)])
    assert max(len(m) for m in many.families.values()) == 16 and len(many.pairs) == 63 * 62 // 2 + 62 * 120 + 28
    assert many.weights.nbytes == 4 * BUCKETS * len(many.pairs) < 160_000_000
    with pytest.raises(ValueError):
        LanguageModel([str(k) for k in range(10_000)])
    model = LanguageModel([f"x{k:02d}" for k in range(20)])
    rnd = np.random.default_rng(3)
    model.weights[:] = rnd.normal(size=model.weights.shape)
    texts = ["one text", "and another one", "third", "12"]
    langs, scores = model.predict(texts)
    for t, lang, s in zip(texts, langs, scores):
        alone = model.predict([t])
        assert alone == ([lang], [pytest.approx(s)]) and (lang == "und") == (t == "12")


def page_text(body):
    from strandmill.llm.main_text import main_text

    return main_text(f"<html><body><nav><a href=x>Home</a></nav>{body}<footer>(c)</footer></body></html>")


STORY = [f"The story goes on and on in its part {i}, with enough words to be a line of prose." for i in range(4)]


@pytest.mark.parametrize("block, text", [
    ("<p>He said <a href=x>a long linked sentence of many words, all of it in one link</a>.</p>", "He said a long linked sentence of many words, all of it in one link."),
    ("<ul><li><a href=a>First source</a><li><a href=b>Second source</a></ul>", "First source\nSecond source"),
    ("<p class=related>Related work is told of here.</p>", "Related work is told of here."),
    ("<blockquote class=reply>So he replied.</blockquote>", "So he replied."),
    ("<p class=ad>Buy it now</p>", None), ("<ul class=menu><li>One</ul>", None), ("<div class=comments><p>First!</p></div>", None),
])
def test_blocks_of_articles_stay(block, text):
    lines = [STORY[0], *([text] if text else []), *STORY[1:]]
    body = f"<p>{STORY[0]}</p>{block}" + "".join(f"<p>{s}</p>" for s in STORY[1:])
    assert page_text(f"<article><h1>Head</h1>{body}</article>") == "\n".join(["Head", *lines])


def test_comment_without_end():
    assert page_text(f"<article><p>{STORY[0]}</p></article><!-- never <p>closed</p>").startswith(STORY[0])
    assert "closed" not in page_text(f"<article><p>{STORY[0]}</p></article><!-- never <p>closed</p>")


@pytest.mark.parametrize("page", [
    "<div>" * 30_000 + "text", "".join(f"<div>line {k} of it" for k in range(20_000)), "<b>x</i></u>" * 60_000, "".join(f"<b><p>word {k}" for k in range(40_000)),
    "<ul>" + "<li><div><div>" * 20_000, "<table>" + "<tr><td><b>x" * 30_000, "<article>" * 20_000 + "<p>text", "<p>" * 200_000, "<a href=x>" * 50_000 + "text", "</div></p></li>" * 60_000,
])
def test_pages_take_linear_time(page):
    import time

    from strandmill.llm.main_text import main_text

    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 10
