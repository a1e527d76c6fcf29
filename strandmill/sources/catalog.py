"""Where the files of a sequencing run lie."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentMismatch, ValidityError
from .alignments import read_aligned
from .delimited import read_base_quality, read_prb, read_qseq
from .fasta import read_fasta, read_fasta_quality, read_quality
from .fastq import read_fastq


def _folders(base: list[str], pattern: str) -> list[str]:
    return sorted(os.path.join(b, d) for b in base if os.path.isdir(b) for d in os.listdir(b) if re.search(pattern, d) and os.path.isdir(os.path.join(b, d)))


@dataclass
class ExperimentPath:
    """A folder of an experiment."""

    base: str

    def __post_init__(self) -> None:
        if not os.path.isdir(self.base):
            raise ArgumentMismatch(f"'{self.base}' is no folder")


@dataclass
class InstrumentPath(ExperimentPath):
    """The layout data/intensities/base calls/alignments of an instrument's output."""

    data: list[str] = field(default_factory=list)
    scans: list[str] = field(default_factory=list)
    images: list[str] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)
    analyses: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__post_init__()
        self.data = self.data or _folders([self.base], "^Data$")
        self.scans = self.scans or _folders(self.data, "^GoldCrest")
        self.images = self.images or _folders(self.data, "^(C[0-9]|IPAR|Intensities)")
        self.calls = self.calls or _folders(self.images, "^(Bustard|BaseCalls)")
        self.analyses = self.analyses or _folders(self.calls, "^GERALD")

    def read_fastq(self, spark: SparkSession, pattern: str = r".*_sequence\.txt$", run: int = 0, **options) -> DataFrame:
        return read_fastq(spark, self.analyses[run], pattern, **options)

    def read_fasta(self, spark: SparkSession, pattern: str, run: int = 0, **options) -> DataFrame:
        return read_fasta(spark, self.analyses[run], pattern, **options)

    def read_prb(self, spark: SparkSession, pattern: str, run: int = 0, **options) -> DataFrame:
        return read_prb(spark, self.calls[run], pattern, **options)

    def read_qseq(self, spark: SparkSession, pattern: str = r"_qseq\.txt", run: int = 0, **options) -> DataFrame:
        return read_qseq(spark, self.calls[run], pattern, **options)

    def read_base_quality(self, spark: SparkSession, run: int = 0, **options) -> DataFrame:
        return read_base_quality(spark, self.calls[run], **options)

    def read_aligned(self, spark: SparkSession, pattern: str, run: int = 0, **options) -> DataFrame:
        return read_aligned(spark, self.analyses[run], pattern, **options)


@dataclass
class RunPath(ExperimentPath):
    """Folders of sequence files with their files of quality numbers."""

    runs: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__post_init__()
        self.runs = self.runs or _folders([self.base], "^run") or [self.base]

    @property
    def names(self) -> list[str]:
        return [os.path.basename(r) for r in self.runs]

    def read_fasta(self, spark: SparkSession, run: int = 0, pattern: str = r"\.fna$", **options) -> DataFrame:
        return read_fasta(spark, self.runs[run], pattern, **options)

    def read_quality(self, spark: SparkSession, run: int = 0, pattern: str = r"\.qual$", **options) -> DataFrame:
        return read_quality(spark, self.runs[run], pattern, **options)

    def read_fasta_quality(self, spark: SparkSession, run: int = 0) -> DataFrame:
        return read_fasta_quality(spark, self.runs[run], self.runs[run], r"\.fna$", r"\.qual$")


@dataclass
class LaneSet:
    """A run with a row of annotation for each of its eight lanes."""

    path: InstrumentPath
    lanes: list[dict]

    def __post_init__(self) -> None:
        if len(self.lanes) != 8:
            raise ValidityError("a run has eight lanes")

    @property
    def names(self) -> list[str]:
        return [str(x.get("lane", i + 1)) for i, x in enumerate(self.lanes)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([{k: str(v) for k, v in x.items()} for x in self.lanes])

    def _of(self, rows: DataFrame) -> DataFrame:
        """Rows with the lane that their file's name begins with (s_3_...), and that lane's annotation."""
        notes = self.table(rows.sparkSession)
        number = F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"^s_(\d)_", 1).cast("int")
        names = rows.sparkSession.createDataFrame([(k, n) for k, n in enumerate(self.names, 1)], "_number int, lane string")
        notes = names.join(notes, "lane", "left") if "lane" in notes.columns else names
        return rows.drop("lane").withColumn("_number", number).join(F.broadcast(notes), "_number", "left").drop("_number")

    def read_fastq(self, spark: SparkSession, lanes: list[int] | None = None, run: int = 0, **options) -> DataFrame:
        """Reads of some lanes (all by default) with their lanes' annotation."""
        return self._of(self.path.read_fastq(spark, self._pattern(lanes, r".*_sequence\.txt$"), run, **options))

    def read_aligned(self, spark: SparkSession, lanes: list[int] | None = None, run: int = 0, suffix: str = r".*_export\.txt$", **options) -> DataFrame:
        return self._of(self.path.read_aligned(spark, self._pattern(lanes, suffix), run, **options))

    @staticmethod
    def _pattern(lanes: list[int] | None, suffix: str) -> str:
        if lanes is not None and not all(1 <= n <= 8 for n in lanes):
            raise ArgumentMismatch("lanes are numbered from 1 to 8")
        return f"^s_[{''.join(map(str, lanes)) if lanes is not None else '1-8'}]_?{suffix}"
