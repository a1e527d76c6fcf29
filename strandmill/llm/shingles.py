"""Distinct word shingles of texts as sorted arrays of 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Code points of texts that are hashed at a time (a longer text is a step of its own): arrays take some 70 bytes for each.
STEP = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at ASCII white space), and the number of words of each text."""
    raw = [t.encode().translate(_LOWER) if lower else t.encode() for t in texts]
    b = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    inside = ~_SPACE[b]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    size = np.diff(np.r_[first, len(at)])
    power = np.full(int(size.max()), 0x5851F42D4C957F2D, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    place = np.arange(len(at)) - np.repeat(first, size)
    h = np.add.reduceat((b[at].astype(np.uint64) + np.uint64(1)) * power[place], first)
    ends = np.cumsum([len(r) + 1 for r in raw])
    words = np.diff(np.r_[0, np.searchsorted(at[first], ends)])
    return mixed(h ^ (size.astype(np.uint64) << np.uint64(40))), words


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words; fewer words make one shingle."""
    out, at = [], 0
    while at < len(texts):
        end, points = at + 1, len(texts[at])
        while end < len(texts) and points + len(texts[end]) <= STEP:
            points += len(texts[end])
            end += 1
        out += _sets(texts[at:end], width)
        at = end
    return out


def _sets(texts: list[str], width: int) -> list[np.ndarray]:
    h, words = word_hashes(texts)
    n = max(0, len(h) - width + 1)
    s = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        s = mixed(s * _ODD + h[k : k + n])
    out, at = [], 0
    for w in words.tolist():
        if w >= width:
            out.append(np.unique(s[at : at + w - width + 1]))
        else:
            one = np.full(min(w, 1), w, dtype=np.uint64)
            for k in range(w):
                one = mixed(one * _ODD + h[at + k])
            out.append(one)
        at += w
    return out
