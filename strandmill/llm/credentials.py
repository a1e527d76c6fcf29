"""Secrets in texts: patterns that stand alone, and parts of a credential that count only together.

Three kinds are reported wherever they occur (assign, access, hex).  Further parts are weak: an access identifier that is short or of a kind that does not
count by itself, a mixed token of the shape that signing keys have, an endpoint.  Within a scope (a paragraph, bounded by
empty lines) each weak part is widened to an interval and joined with the intervals of complementary parts, strong or weak;
it is reported, as kind:start:end, only if they meet.  `reach` is how far it is widened; without one (None, as in the query
and the pipeline) the interval is the scope.  Both sides are sorted and searched, so a scope with many parts takes little
more than linear time and no list of pairs.

Defined results: a null text counts as empty and has no spans; equal texts have equal spans; repeated rows give repeated
rows; columns other than the two that are named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import text_slices, texts_of

KINDS = ["assign", "access", "hex", "weak_access", "weak_token", "weak_endpoint"]
#: Code points between the parts of one credential, at most, where the caller gives no other number, or None for the scope.
REACH = 400
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A match always takes the whole run, so a least length within the pattern finds the same matches as a test after it.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WEAK_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AGPA|AIDA)[A-Z0-9]{6,}(?![A-Za-z0-9])")
#: A token begins behind whatever is not of its run, `=` included (NAME=token), so each run is searched once.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._:@-]{4,}|(?<![A-Za-z0-9.-])(?:[a-z0-9-]{1,63}\.)+(?:amazonaws|googleapis|azure|internal)\.[a-z]{2,8}")
_BREAK = re.compile(r"\n[ \t\r]*\n")
#: What a part completes: an identifier needs a secret, a secret an identifier or an endpoint, an endpoint both kinds of key.
_COMPLEMENTS = {
    "weak_access": {"assign", "hex", "weak_token"},
    "weak_token": {"access", "weak_access", "weak_endpoint"},
    "weak_endpoint": {"assign", "access", "hex", "weak_access"},
}
_ROLE = {k: i for i, k in enumerate(KINDS)}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The spans that count by themselves, by start and then kind."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], _ROLE[s[0]], s[2]))


def weak_parts(text: str) -> list[Span]:
    """Candidates that need a complement."""
    found = []
    if "A" in text:
        found += [("weak_access", *m.span()) for m in _WEAK_ACCESS.finditer(text)]
    # A long identifier has the shape of a token too; it is no secret of another one.
    names = {(a, b) for _, a, b in found}
    found += [("weak_token", *m.span()) for m in _TOKEN.finditer(text) if m.span() not in names]
    if "://" in text or "." in text:
        found += [("weak_endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    return sorted(found, key=lambda s: (s[1], _ROLE[s[0]], s[2]))


def linked(parts: list[Span], scopes: list[int], reach: int | None = REACH) -> list[Span]:
    """The weak parts that, widened by `reach`, meet a complementary part of the same scope.  scopes: where scopes begin.

    Within a scope the complements' starts and ends are sorted, so each weak part is two searches: for a complement that
    ends before it near enough, and for one that starts behind it.  One that overlaps the weak part is no complement.
    """
    out = []
    reach = 1 << 60 if reach is None else reach
    scope = [bisect_right(scopes, s) for _, s, _ in parts]
    for weak, needs in _COMPLEMENTS.items():
        starts: dict[int, list[int]] = {}
        ends: dict[int, list[int]] = {}
        for (kind, a, b), where in zip(parts, scope):
            if kind in needs:
                starts.setdefault(where, []).append(a)
                ends.setdefault(where, []).append(b)
        for found in (*starts.values(), *ends.values()):
            found.sort()
        for part, where in zip(parts, scope):
            if part[0] != weak or where not in starts:
                continue
            _, a, b = part
            before, behind = bisect_left(ends[where], a - reach), bisect_left(starts[where], b)
            if before < len(ends[where]) and ends[where][before] <= a or behind < len(starts[where]) and starts[where][behind] <= b + reach:
                out.append(part)
    return out


def all_spans(text: str, reach: int | None = REACH) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with the linked weak parts."""
    base, weak = base_spans(text), weak_parts(text)
    if not weak or len(base) + len(weak) < 2:
        return base, base
    # A weak part within a base span is known: of the spans that start before it, one reaches as far as the farthest.
    starts, farthest = [a for _, a, _ in base], [-1, *accumulate((b for _, _, b in base), max)]
    weak = [s for s in weak if farthest[bisect_right(starts, s[1])] < s[2]]
    key = lambda s: (s[1], _ROLE[s[0]], s[2])
    scopes = [m.end() for m in _BREAK.finditer(text)]
    return base, sorted(base + linked(sorted(base + weak, key=key), scopes, reach), key=key)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with each span, or run of overlapping spans, replaced."""
    out, at, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= max(end, 0) and (end < 0 or a > end or a == end):
            out += [text[at:a], mark]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, reach: int | None = REACH, redact: bool = False, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns of `keep`, n_assign, n_access, n_hex, n_linked, base_sha256, spans and, with `redact`, the text without the spans
    (null for null)."""
    carried = [id_col, *keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried) + ", n_assign bigint, n_access bigint, n_hex bigint, n_linked bigint, base_sha256 string, spans string" + ", redacted string" * redact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                counts: list[list[int]] = [[], [], [], []]
                hashes, spans, clean = [], [], []
                for given in part.column(text_col).to_pylist():
                    base, found = all_spans(given or "", reach)
                    for i, k in enumerate(KINDS[:3]):
                        counts[i].append(sum(s[0] == k for s in base))
                    counts[3].append(len(found) - len(base))
                    hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(found))
                    clean.append(given if not found else redacted(given, found)) if redact else None
                cols = [*map(part.column, carried), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes), pa.array(spans)]
                names = [*carried, "n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"]
                if redact:
                    cols.append(pa.array(clean, pa.string()))
                    names.append("redacted")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(*dict.fromkeys([*carried, text_col])).mapInArrow(run, schema)
