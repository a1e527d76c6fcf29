"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

Pages are fed to the standard library's parser in pieces.  Its events give lines, one for each block of text, with the
number of tags and of linked characters in it and the containers that it stands in.  Over all lines of the page the
text-to-tag ratio (of characters outside links) is smoothed with a Gaussian.  Lines above the threshold, the standard
deviation, are the content cluster; where they lie decides which container is the content region: the deepest one with
most of the cluster, by lines and by smoothed ratio.  Within the region, lines of the cluster stay, and short ones beside them.

Tags, roles and the words of class and id names weigh in: a line's smoothed ratio is multiplied by a small weight where
it stands in a menu, footer, form, advert or the like, and short lines of the region that have such a weight go.  What
weighs is what lies below the region, so a form, or an oddly named element, around the whole article changes nothing; the
names of paragraphs, quotations and headings weigh only if they tell of adverts and notices.
An `article` or `main` element is the region if it has at least half of the cluster, of several the one with most of it,
where one with a main heading counts three times.  In such a region no line goes for its links or its ratio alone.

Open elements are known by their container and what weighs since then, containers by their parents, so a page takes time
in proportion to its length, however its elements are nested or left open.

Defined results: null html counts as empty; a page without text gives an empty text; what follows a comment that does not
end belongs to it; repeated rows give repeated rows;
columns other than those that are named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import text_slices, texts_of

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never shown as text.
LEFT_OUT = frozenset(
    "audio button canvas datalist embed iframe input label legend map noembed noframes noscript object optgroup option output progress script select style svg template textarea title video".split()
)
#: Elements that are seldom part of an article, and how much lines in them weigh.
WEAK = frozenset("aside dialog fieldset footer form menu nav".split())
FAINT, DOUBTFUL = 0.05, 0.15
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article body center div fieldset form main section table td".split())
ROLES = frozenset("alert alertdialog banner button complementary contentinfo dialog form menu menubar navigation search status tablist toolbar tooltip".split())
#: Words of class and id names that mark what is no article, and those that mark an article.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus"
    " dropdown feedback footer footnav gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup popular promo"
    " promoted promotion reactions recommended related remarks replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud tags teaser"
    " toolbar topbar trending widget".split()
)
GOOD = frozenset("article articlebody body content entry main page post story text".split())
#: Elements that hold text themselves, and the marks that weigh in their names.
TEXTUAL = frozenset("blockquote h1 h2 h3 h4 h5 h6 p pre".split())
NOTICES = frozenset("ad ads advert adverts advertisement advertising byline cookie cookies consent copyright disclaimer notice paywall promo promoted promotion sponsor sponsored".split())
#: Marks of what readers wrote, which is prose of its own.
READERS = frozenset("comment comments commentlist discussion disqus reactions remarks replies respond responses".split())
#: An element of these kinds starts by ending an open one of the same group in the same list or table.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol menu dl table select body".split())
_BOUNDS = BLOCKS | _SCOPE | {"option"}
_ENDS_P = BLOCKS - {"body", "caption", "head", "html", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
#: Words before or after a mark that make a name tell something else.
_ABOUT, _LACKING = frozenset("has hide no with without".split()), frozenset("free less".split())
_WORDS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPLIT_CAPS = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Line:
    __slots__ = ("linked", "at", "least", "tags", "text", "heading")

    def __init__(self, text: str, tags: int, linked: int, at: int, least: float, heading: int):
        #: at: the innermost container; least: the least weight of the elements within it that the line stands in.
        self.text, self.tags, self.linked, self.at, self.least, self.heading = text, tags, linked, at, least, heading


def name_weight(value: str, among: frozenset[str] = MARKS) -> float:
    """What the words of a class or id name say: marks and good words are set off against each other."""
    words = _WORDS.findall(_SPLIT_CAPS.sub(" ", value).lower())
    marks = [w for w, before, after in zip(words, ["", *words], [*words[1:], ""]) if w in among and before not in _ABOUT and after not in _LACKING]
    if any(w in READERS for w in marks):
        return FAINT
    return DOUBTFUL if len(marks) > sum(w in GOOD for w in words) else 1.0


class LineParser(HTMLParser):
    """Turns parser events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        #: Containers that are article or main elements.
        self.roots: set[int] = set()
        #: Of each container its parent, and the least weight of the elements from it up to there; 0 is the page.
        self.parents, self.weights = [-1], [1.0]
        #: Open elements: tag, whether its text is left out, innermost container, least weight since then, heading.
        self.open: list[tuple[str, bool, int, float, int]] = [("", False, 0, 1.0, 0)]
        self.counts: Counter[str] = Counter()
        #: Places in `open` of blocks and of what bounds the ends that they imply.
        self.bounds: list[int] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.out = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, _, container, least, heading = self.open[-1]
                self.lines.append(Line(text, self.tags, self.linked, container, least, heading))
            self.parts = []
        self.tags = self.linked = 0

    def push(self, tag: str, out: bool, weight: float) -> int:
        """Open an element; the number of the container that it is, or 0."""
        _, _, container, least, heading = self.open[-1]
        if tag in HEADINGS:
            heading = heading or int(tag[1])
        number = 0
        if tag in CONTAINERS:
            number = len(self.parents)
            self.parents.append(container)
            self.weights.append(min(least, weight))
            container, least = number, 1.0
        else:
            least = min(least, weight)
        if tag in _BOUNDS:
            self.bounds.append(len(self.open))
        self.open.append((tag, out, container, least, heading))
        self.counts[tag] += 1
        self.out += out
        self.links += tag == "a"
        return number

    def pop(self) -> None:
        tag, out, _, _, _ = self.open.pop()
        self.counts[tag] -= 1
        if self.bounds and self.bounds[-1] == len(self.open):
            self.bounds.pop()
        self.out -= out
        self.links -= tag == "a"

    def close_from(self, place: int) -> None:
        while len(self.open) > place:
            self.pop()

    def inside(self, *tags: str) -> bool:
        return any(self.counts[t] for t in tags)

    def weigh(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, float]:
        """Whether an element's text is left out, and its weight."""
        out, weight = tag in LEFT_OUT, FAINT if tag in WEAK else 1.0
        if tag == "header" and not self.inside("article", "main") or tag == "article" and self.inside("article"):
            weight = FAINT  # the site's header; an article within another one is a remark on it
        for key, value in attrs if tag not in ("html", "body") else ():
            value = value or ""
            if key in ("class", "id"):
                named = name_weight(value, NOTICES if tag in TEXTUAL else MARKS)
                if tag in ("article", "main") and named > FAINT or tag == "header" and weight == 1.0:
                    continue
                weight = min(weight, named)
            elif key == "role" and value.lower() in ROLES:
                weight = FAINT
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value.lower()):
                out = True
        return out, weight

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            self.imply_ends(tag)
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        number = self.push(tag, *self.weigh(tag, attrs))
        if number and (tag in ("article", "main") or ("role", "main") in attrs or ("itemprop", "articleBody") in attrs):
            self.roots.add(number)

    def imply_ends(self, tag: str) -> None:
        if tag in _ENDS_P and self.counts["p"]:
            last = next((k for k in reversed(self.bounds) if self.open[k][0] in BLOCKS), None)
            if last is not None and self.open[last][0] == "p":
                self.close_from(last)
        if tag in _ENDS and self.inside(*_ENDS[tag]):
            for k in reversed(self.bounds[:]):
                if self.open[k][0] in _ENDS[tag]:
                    self.close_from(k)
                    if tag != "tr":
                        break
                elif self.open[k][0] in _SCOPE:
                    break

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        else:
            self.tags += 1
        if self.counts[tag]:
            while self.open[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def close(self) -> None:
        if self.rawdata.startswith("<!--"):
            self.rawdata = ""
        super().close()
        self.flush()


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; near the ends the kernel is renormalised over the lines that exist."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    whole = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return whole / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def region_of(parser: LineParser, score: np.ndarray) -> int:
    """The container that holds the content cluster, whose lines have a score; 0 is the page."""
    parents, n = parser.parents, len(parser.parents)
    total, mass, count, headed = float(score.sum()), [0.0] * n, [0] * n, [False] * n
    if total <= 0:
        return 0
    for x, s in zip(parser.lines, score.tolist()):
        mass[x.at] += s
        count[x.at] += s > 0
        headed[x.at] |= x.heading == 1 and x.least == 1.0
    # Containers are numbered as they open, so a parent comes before what it holds, and the last of those with enough is the deepest.
    for c in range(n - 1, 0, -1):
        mass[parents[c]] += mass[c]
        count[parents[c]] += count[c]
        headed[parents[c]] |= headed[c] and parser.weights[c] == 1.0
    outer = [0] * n
    for c in range(1, n):
        outer[c] = outer[parents[c]] or (c if c in parser.roots else 0)
    own = sorted({outer[x.at] for x in parser.lines if mass[outer[x.at]] > 0} - {0})
    if own and sum(mass[c] for c in own) >= 0.5 * total:
        best = max(own, key=lambda c: mass[c] * (3 if headed[c] else 1))
        inside = within(parents, best)
        return max(c for c in range(best, n) if inside[c] and c in parser.roots and mass[c] >= 0.75 * mass[best])
    least = 0.6 * int((score > 0).sum())
    return max((c for c in range(n) if mass[c] >= 0.75 * total and count[c] >= least), default=0)


def within(parents: list[int], region: int) -> list[bool]:
    """Which containers are a region or lie in it."""
    inside = [False] * len(parents)
    inside[region] = True
    for c in range(region + 1, len(parents)):
        inside[c] = inside[parents[c]]
    return inside


def weights_below(parser: LineParser, region: int) -> np.ndarray:
    """Of each line, the least weight of the elements below a region; for lines in it."""
    below = [1.0] * len(parser.parents)
    for c in range(region + 1, len(below)):
        if parser.parents[c] >= region:
            below[c] = min(below[parser.parents[c]], parser.weights[c])
    return np.array([min(x.least, below[x.at]) for x in parser.lines])


def select(parser: LineParser, sigma: float = 1.0) -> list[Line]:
    """The lines of the content region."""
    lines = parser.lines
    if not lines:
        return []
    size = np.array([len(x.text) for x in lines], dtype=float)
    linked = np.minimum(np.array([x.linked for x in lines]), size)
    ratio = smoothed((size - linked) / np.array([1 + x.tags for x in lines]), sigma)
    weight = weights_below(parser, 0)
    weighed = ratio * weight
    # A page that is one form, say, has one weight throughout: only differences count.
    cluster = (weighed >= weighed.std()) & (weighed > 0)
    region = region_of(parser, np.where(cluster, weighed, 0.0))
    threshold, whole = weighed.std() / weight.max(), region in parser.roots
    inside, out = within(parser.parents, region), []
    for x, r, share, below in zip(lines, ratio, linked / size, weights_below(parser, region)):
        if inside[x.at] and (r * below > threshold and (whole or share < 0.5) or below >= 0.5 and (whole or r > 0 and (x.heading or share < 0.66))):
            out.append(x)
    return out


def main_text(html: str, piece: int = 1 << 16) -> str:
    parser = LineParser()
    for at in range(0, len(html), piece):
        parser.feed(html[at : at + piece])
    parser.close()
    return "\n".join(x.text for x in select(parser))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (lines in page order, joined by line feeds) and n_chars (its code points)."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, html_col):
                texts = [main_text(x) for x in texts_of(part, html_col)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column(url_col), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
