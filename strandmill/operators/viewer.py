"""A view of coverage that can be zoomed and moved; what it draws is chosen by the width of its range."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentMismatch
from .intervals import coverage_frames, coverage_window

LEAST = 50


@dataclass
class ViewFunction:
    """A reader of a range for widths within limits: reader(alignments, chromosome, start, end)."""

    name: str
    reader: Callable[[DataFrame, str, int, int], DataFrame]
    limits: tuple[int, int]


FUNCTIONS = [
    ViewFunction("fine_coverage", lambda df, c, a, b: coverage_window(df, c, a, b, most_bases=b - a + 1), (LEAST, 10_000)),
    ViewFunction("coarse_coverage", lambda df, c, a, b: coverage_window(df, c, a, b, most_bases=0), (10_001, 1 << 31)),
]


@dataclass
class RangeView:
    """Files' alignments over a range; verbs give a new view."""

    files: dict[str, DataFrame]
    chromosome: str
    start: int
    end: int
    functions: list[ViewFunction] = field(default_factory=lambda: list(FUNCTIONS))
    groups: dict[str, str] | None = None
    ignore_strand: bool = False
    #: Features (name, chromosome, start, end) that are shown with the depth, and the name of a function chosen by hand.
    track: DataFrame | None = None
    chosen: str | None = None
    #: The views before this one, the first of all first.
    earlier: list[RangeView] = field(default_factory=list, repr=False)

    def __post_init__(self) -> None:
        if self.end - self.start + 1 < LEAST or self.start < 1:
            raise ArgumentMismatch(f"a view begins at 1 or later and is at least {LEAST} bases wide")

    @property
    def function(self) -> ViewFunction:
        width = self.end - self.start + 1
        for f in self.functions:
            if self.chosen is not None and f.name != self.chosen:
                continue
            if f.limits[0] <= width <= f.limits[1]:
                return f
        raise ArgumentMismatch(f"no function draws {width} bases")

    def over(self, start: int, end: int) -> RangeView:
        return replace(self, start=start, end=end, earlier=[*self.earlier, self])

    def back(self) -> RangeView:
        """The view before the last change; the first one stays."""
        return self.earlier[-1] if self.earlier else self

    def restore(self) -> RangeView:
        """The view that all began with."""
        return self.earlier[0] if self.earlier else self

    def switch(self, name: str | None) -> RangeView:
        """Drawn by a function of that name, or again by the one that the width chooses."""
        if name is not None and name not in {f.name for f in self.functions}:
            raise ArgumentMismatch(f"there is no function '{name}'")
        out = replace(self, chosen=name, earlier=[*self.earlier, self])
        assert out.function
        return out

    def features(self) -> DataFrame | None:
        """The track's features that meet the range, cut to it."""
        if self.track is None:
            return None
        near = self.track.where((F.col("chromosome") == self.chromosome) & (F.col("start") <= self.end) & (F.col("end") >= self.start))
        return near.withColumns({"start": F.greatest("start", F.lit(self.start)), "end": F.least("end", F.lit(self.end))})

    def zoom(self, factor: float) -> RangeView:
        """Half as wide by a factor of 2, about the middle; not below the least width, nor before base 1."""
        width = max(LEAST, round((self.end - self.start + 1) / factor))
        start = max(1, (self.start + self.end - width + 1) // 2)
        return self.over(start, start + width - 1)

    def pan(self, share: float) -> RangeView:
        """Moved by a share of the width, to the left if it is negative."""
        width = self.end - self.start + 1
        start = max(1, self.start + round(share * width))
        return self.over(start, start + width - 1)

    def toggle_strand(self) -> RangeView:
        return replace(self, ignore_strand=not self.ignore_strand, earlier=[*self.earlier, self])

    def data(self) -> DataFrame:
        """Mean depth over files (of each group) at each place and strand."""
        read = {f: self.function.reader(df, self.chromosome, self.start, self.end) for f, df in self.files.items()}
        return coverage_frames(read, self.groups, self.ignore_strand)


def view_feature(features: DataFrame, name: str, files: dict[str, DataFrame], **options) -> RangeView:
    """The view of a named feature (name, chromosome, start, end), which may have several ranges."""
    rows = features.where(features["name"] == name).collect()
    if not rows or len({r.chromosome for r in rows}) > 1:
        raise ArgumentMismatch(f"'{name}' names no feature of one chromosome")
    return RangeView(files, rows[0].chromosome, min(r.start for r in rows), max(r.end for r in rows), **options)
