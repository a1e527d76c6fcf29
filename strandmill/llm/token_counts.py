"""Exact token counts at every prefix of a text, for byte-level BPE vocabularies in the tokenizers JSON format.

The encoding of a pre-token's prefix ends in exactly one token that fits the encoding before it, so one pass over the
pre-token's bytes gives the last token and the count at each prefix (the count where that token begins, plus one).
Two adjacent tokens fit if the library's merges of their joined bytes give them back.  Counts of a text are then kept as int8 steps
per code point: their running sum is the count at each prefix, and truncation or budget questions need no encoding.  A
text with a step beyond that has four bytes for each, behind a mark that no int8 step has.

New words of a slice of texts are counted together, by numpy over all their bytes; each is kept with its steps, so that a
text's steps are those of its units, joined.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text count as one token, as
in the library's default; repeated rows give repeated rows; columns other than the two that are named are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_slices, texts_of

_SHORT = "'(?:s|t|re|ve|m|ll|d)"
_RUN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
#: Stretches whose prefixes can be counted without their surroundings: white space goes with what follows it.  Words, the
#: most frequent ones, are tried first.
_UNIT = regex.compile(rf" \p{{L}}+|\p{{L}}+|{_SHORT}|{_RUN}|\s++(?:(?<= )(?:{_RUN})|(?<! )(?:{_SHORT}|{_RUN}))|\s++")
_PARTS = regex.compile(r"(\s*)(.*)", regex.S)
#: Code points above this are classed by the library itself, whose Unicode tables may be older.
_KNOWN = 0x558
_RARE = regex.compile(rf"[\U{_KNOWN:08x}-\U0010ffff]")
_CACHE = 200_000
#: Code points below which a word is counted together with others (at most 4 tokens a point, so no step is too large for a
#: byte), and words of one step.
_WORD, _WORDS = 32, 20_000


def byte_alphabet() -> str:
    """The stand-in of each byte in byte-level vocabularies: visible Latin-1 itself, the others from U+0100 on in turn."""
    shown = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return "".join(chr(b if shown[b] else 256 + b - sum(shown[:b])) for b in range(256))


class PrefixCounter:
    """Counts at every prefix of pre-tokens, units and texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(stand_in)}
        special = {t["content"] for t in spec["added_tokens"]}
        whole = Tokenizer.from_file(path)
        self.model, self.pre = whole.model, whole.pre_tokenizer
        self.word = {i: w for w, i in spec["model"]["vocab"].items() if w not in special}
        #: A trie over the tokens' bytes: node << 8 | byte leads to a node, which may be a token.
        self.next: dict[int, int] = {}
        self.token = [-1]
        for i, w in self.word.items():
            if [t.id for t in self.model.tokenize(w)] != [i]:
                continue
            node = 0
            for c in w:
                node = self.next.setdefault(node << 8 | to_byte[c], len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = i
        #: The trie as a table with a row for each node that leads on; those come first.
        inner = sorted({k >> 8 for k in self.next})
        number = {node: k for k, node in enumerate([*inner, *sorted(set(range(len(self.token))) - set(inner))])}
        self.rows = len(inner)
        self.table = np.full(self.rows << 8, -1, dtype=np.int32)
        self.table[[number[k >> 8] << 8 | k & 255 for k in self.next]] = [number[node] for node in self.next.values()]
        self.tokens = np.empty(len(self.token), dtype=np.int64)
        self.tokens[[number[node] for node in range(len(self.token))]] = self.token
        self.fits: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.long: list[str] = []
        self.special = sorted(special, key=len, reverse=True)
        self.kinds: dict[int, str | None] = {}

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the library keeps these two tokens when it merges their joined bytes."""
        if len(self.fits) > 10 * _CACHE:
            self.fits.clear()
        ok = self.fits[a << 20 | b] = [t.id for t in self.model.tokenize(self.word[a] + self.word[b])] == [a, b]
        return ok

    def piece(self, w: bytes) -> list[int]:
        """Token counts of w[:0], w[:1], ... w as one pre-token each."""
        n = len(w)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        step, token, fits = self.next.get, self.token, self.fits
        for j in range(n):
            before, node = last[j], 0
            for i in range(j, n):
                node = step(node << 8 | w[i])
                if node is None:
                    break
                t = token[node]
                if t >= 0 > last[i + 1]:
                    if before >= 0:
                        ok = fits.get(before << 20 | t)
                        if ok is None:
                            ok = self.adjacent(before, t)
                        if not ok:
                            continue
                    last[i + 1] = t
                    count[i + 1] = count[j] + 1
        if n and min(last[1:]) < 0:
            raise ValueError("the vocabulary has no token for a byte")
        return count

    def fitting(self, pairs: list[int]) -> list[bool]:
        """Whether each pair of tokens (a << 20 | b) fits."""
        found = list(map(self.fits.get, pairs))
        if None in found:
            for k, ok in enumerate(found):
                if ok is None:
                    ok = self.fits.get(pairs[k])
                    found[k] = self.adjacent(pairs[k] >> 20, pairs[k] & (1 << 20) - 1) if ok is None else ok
        return found

    def together(self, words: list[str]) -> list[bytes]:
        """Steps at the code points of words of fewer than _WORD ones, each a pre-token: piece() on all in step."""
        raw = [w.encode() for w in words]
        b = np.frombuffer(b"".join(raw), dtype=np.uint8)
        size = np.array([len(r) for r in raw])
        stop = np.cumsum(size)
        n, end, first = len(b), np.repeat(stop, size), np.repeat(stop - size, size)
        # Tokens that begin at each byte, by walking the trie from all at once; those that end at a byte, the longest first.
        at, node, found = np.arange(n), np.zeros(n, dtype=np.int32), []
        for d in range(int(size.max())):
            node = self.table[(node << 8) + b[at + d]]
            at, node = at[node >= 0], node[node >= 0]
            token = self.tokens[node]
            found.append((at[token >= 0], np.full(int((token >= 0).sum()), d), token[token >= 0]))
            on = (node < self.rows) & (at + d + 1 < end[at])
            at, node = at[on], node[on]
        begin, length, token = (np.concatenate(x) for x in zip(*reversed(found)))
        order = np.argsort(begin + length, kind="stable")
        upto = np.cumsum(np.bincount(begin + length, minlength=n))
        begin, token = begin[order], token[order]
        last, count = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        place = np.arange(n) - first
        for here in np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place))[:-1]):
            k = np.where(here > 0, upto[here - 1], 0)
            while len(here):
                if (k >= upto[here]).any():
                    raise ValueError("the vocabulary has no token for a byte")
                s, t = begin[k], token[k]
                after = s > first[here]
                fit = ~after
                fit[after] = self.fitting((last[s[after] - 1] << 20 | t[after]).tolist())
                done = here[fit]
                last[done] = t[fit]
                count[done] = 1 + np.where(after, count[s - 1], 0)[fit]
                here, k = here[~fit], k[~fit] + 1
        ends = np.r_[b[1:] & 0xC0 != 0x80, True]
        points = count[ends]
        cuts = np.cumsum([len(w) for w in words])
        before = np.r_[0, points[:-1]]
        before[cuts[:-1]] = 0
        steps = (points - before).astype(np.int8).tobytes()
        return [steps[a:z] for a, z in zip([0, *cuts.tolist()], cuts.tolist())]

    def at_points(self, s: str, before: str = "") -> list[int]:
        """Counts after each code point of s, as one pre-token that begins with `before`."""
        count = self.piece((before + s).encode())
        if s.isascii() and len(before) < 2:
            return count[len(before) + 1 :]
        out, at = [], len(before.encode())
        for c in s:
            at += len(c.encode())
            out.append(count[at])
        return out

    def unit(self, u: str) -> bytes:
        """The packed steps of a unit's count at each of its code points."""
        return packed(np.diff(np.array([0, *self.mixed(u)])))

    def mixed(self, u: str) -> list[int]:
        """Counts at each code point of a unit of any kind."""
        space, core = _PARTS.fullmatch(u).groups() if u[0].isspace() or not u[0].isalnum() else ("", u)
        counts = self.at_points(space) if space else []
        if core:
            base, before = 0, ""
            if space:
                base, before = (counts[-2] if len(space) > 1 else 0), space[-1]
                if before != " ":
                    base, before = base + self.at_points(before)[-1], ""
            if core[0] == "'" and len(core) > 1 and not before and regex.fullmatch(_SHORT, core):
                quote = self.at_points("'")[0]
                counts += [base + quote, *(base + quote + x for x in self.at_points(core[1:-1])), base + self.at_points(core)[-1]]
            else:
                counts += [base + x for x in self.at_points(core, before)]
        return counts

    def kind(self, c: int) -> str | None:
        """A stand-in of the class that the library gives a code point; None if ours is the same."""
        n = lambda s: len(self.pre.pre_tokenize_str(s))
        ch = chr(c)
        if ch.isspace():
            return None
        return "a" if n("a" + ch) == 1 else "1" if n("1" + ch) == 1 else "!"

    def split(self, text: str) -> list[str]:
        if text.isascii() or not _RARE.search(text):
            return _UNIT.findall(text)
        rare = {ord(c) for c in _RARE.findall(text)}
        for c in rare - self.kinds.keys():
            self.kinds[c] = self.kind(c)
        seen = text.translate({c: k for c in rare if (k := self.kinds[c])})
        return [text[m.start() : m.end()] for m in _UNIT.finditer(seen)]

    def learn(self, parts: list[list[str]]) -> None:
        """Make sure that the steps of all units are known."""
        new = set(chain.from_iterable(parts)).difference(self.units)
        known = new.intersection(self.older)
        self.units.update(zip(known, map(self.older.__getitem__, known)))
        words = []
        for u in new.difference(known):
            if len(u) < _WORD and (u[1:2] if u[0] == " " else u[0]).isalnum():
                words.append(u)
            else:
                self.units[u] = self.unit(u)
                if len(u) > 40:
                    self.long.append(u)
        for k in range(0, len(words), _WORDS):
            some = words[k : k + _WORDS]
            self.units.update(zip(some, self.together(some)))

    def forget(self) -> None:
        """Of what is known keep a bounded part."""
        for u in self.long:
            del self.units[u]
        self.long.clear()
        if len(self.units) >= _CACHE:
            self.units, self.older = {}, self.units

    def joined(self, parts: list[str]) -> bytes:
        return _joined(list(map(self.units.__getitem__, parts)))

    def count(self, text: str) -> int:
        parts = self.split(text)
        self.learn([parts])
        return int(steps_of(self.joined(parts)).sum(dtype=np.int64))

    def steps(self, text: str) -> bytes:
        """Packed steps of the count at each code point of the text; their sum is the text's count."""
        return self.steps_all([text])[0]

    def steps_all(self, texts: list[str]) -> list[bytes]:
        """steps() of several texts, whose new words are counted together."""
        plain = [not any(s in text for s in self.special) for text in texts]
        parts = [self.split(text) if p else [] for text, p in zip(texts, plain)]
        self.learn(parts)
        out = [self.joined(part) if p else self.with_special(text) for text, part, p in zip(texts, parts, plain)]
        self.forget()
        return out

    def with_special(self, text: str) -> bytes:
        """Steps of a text that special strings are in."""
        out = []
        for part in regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text):
            if part in self.special:
                tail = "".join(self.split(before)[-2:])
                base = self.count(before) - self.count(tail)
                counts = [base + self.count(tail + part[:j]) for j in range(1, len(part))] + [self.count(before) + 1]
                out.append(packed(np.diff(np.array([self.count(before), *counts]))))
            else:
                before, parts = part, self.split(part)
                self.learn([parts])
                out.append(self.joined(parts))
        return _joined(out)


#: First byte of steps of four bytes each; int8 steps are -127 to 127.
_WIDE = b"\x80"


def packed(steps: np.ndarray) -> bytes:
    """Steps as int8, or as int32 behind a mark if one of them is too large."""
    if not len(steps) or np.abs(steps).max() < 128:
        return steps.astype(np.int8).tobytes()
    return _WIDE + steps.astype("<i4").tobytes()


def steps_of(packed_steps: bytes) -> np.ndarray:
    return np.frombuffer(packed_steps, dtype="<i4", offset=1) if packed_steps[:1] == _WIDE else np.frombuffer(packed_steps, dtype=np.int8)


def _joined(parts: list[bytes]) -> bytes:
    whole = b"".join(parts)
    if _WIDE in whole and any(p[:1] == _WIDE for p in parts):
        return packed(np.concatenate([steps_of(p).astype(np.int64) for p in parts]))
    return whole


@lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def counts_of(steps: bytes) -> np.ndarray:
    """Token counts after 1, 2, ... code points."""
    return np.cumsum(steps_of(steps), dtype=np.int64)


def tokens_within(steps: bytes, n_points: int) -> int:
    """Tokens of the text's first n_points code points."""
    return int(steps_of(steps)[: max(0, n_points)].sum(dtype=np.int64))


def points_within(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix that has at most `budget` tokens."""
    fits = np.flatnonzero(counts_of(steps) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, store: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit), fit_points (code points of the longest prefix of
    at most `limit` tokens) and, with `store`, prefix_steps for counts_of(), tokens_within() and points_within()."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_points bigint" + ", prefix_steps binary" * store

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            for part in text_slices(batch, text_col):
                size, tokens, fit, kept = [], [], [], []
                texts = texts_of(part, text_col)
                for text, steps in zip(texts, counter.steps_all(texts)):
                    counts = counts_of(steps)
                    n = int(counts[-1]) if len(counts) else 0
                    below = np.flatnonzero(counts[::-1] <= limit)
                    size.append(len(text.encode()))
                    tokens.append(n)
                    fit.append(len(counts) - int(below[0]) if len(below) else 0)
                    kept.append(steps if store else None)
                cols = [part.column(id_col), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([x > limit for x in tokens]), pa.array(fit, pa.int64())]
                names = [id_col, "n_bytes", "n_tokens", "over_limit", "fit_points"]
                if store:
                    cols.append(pa.array(kept, pa.binary()))
                    names.append("prefix_steps")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
