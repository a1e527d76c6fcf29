"""Media columns: payloads stored as progressive JPEG files, and files decoded to full-resolution RGB tensors.

Defined results: a null text counts as empty, whose payload is 192 blanks; equal texts give equal files and features;
repeated rows give repeated rows; a null file decodes to nulls; columns other than those that are named are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .shared import text_slices

UNIT = 192
_SLICE = 1_000_000


def padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % UNIT or UNIT * (not raw))


@lru_cache(maxsize=1)
def _tables() -> dict:
    return {}


def feature(tensor: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and a checksum of all samples."""
    h, w, _ = tensor.shape
    means = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (h * w)
    return f"{w}x{h}:" + ",".join(map(str, means.tolist())) + f":{zlib.crc32(tensor.tobytes()):08x}"


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (of the text in UTF-8) and jpeg (the padded payload as a file)."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, jpeg binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col, _SLICE):
                raw = [(x or "").encode() for x in part.column(text_col).to_pylist()]
                files = jpeg.encode_payloads([padded(x) for x in raw])
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array([len(x) for x in raw], pa.int64()), pa.array(files, pa.binary())], [id_col, "n_bytes", "jpeg"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _decoded(files: list[bytes | None]) -> Iterator[tuple[jpeg.Picture, np.ndarray] | None]:
    """Pictures and the coefficients of all their blocks, in groups of bounded size."""
    at = 0
    while at < len(files):
        end, size = at, 0
        while end < len(files) and (end == at or size + len(files[end] or b"") <= _SLICE):
            size += len(files[end] or b"")
            end += 1
        some = [f for f in files[at:end] if f is not None]
        pictures, coef = jpeg.decode(some, _tables())
        found = iter(pictures)
        for f in files[at:end]:
            yield None if f is None else (next(found), coef)
        at = end


def decode_tensors(media: DataFrame, id_col: str = "doc_id", jpeg_col: str = "jpeg") -> DataFrame:
    """Per row: id, height, width and rgb (height x width x 3 bytes) of any progressive JPEG file."""
    schema = f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, height int, width int, rgb binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, jpeg_col, _SLICE):
                out = [None if x is None else jpeg.rgb(*x) for x in _decoded(part.column(jpeg_col).to_pylist())]
                size = lambda k: pa.array([None if x is None else x.shape[k] for x in out], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(id_col), size(0), size(1), pa.array([None if x is None else x.tobytes() for x in out], pa.binary())], [id_col, "height", "width", "rgb"])

    return media.select(id_col, jpeg_col).mapInArrow(run, schema)


def read_payloads(media: DataFrame, id_col: str = "doc_id", jpeg_col: str = "jpeg") -> DataFrame:
    """Per row of store_payloads(): id, n_bytes, and of what the file gives back payload_bytes, payload_sha256,
    tail_crc32 (of its last 16 bytes), media_bytes, media_sha256 (of the file), feature (of its RGB tensor), and the tensor:
    height, width and rgb."""
    schema = f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, height int, width int, rgb binary"
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, jpeg_col, _SLICE):
                files = part.column(jpeg_col).to_pylist()
                rows = []
                for f, (picture, coef) in zip(files, _decoded(files)):
                    back, tensor = jpeg.payload_of(picture, coef), jpeg.rgb(picture, coef)
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(f), hashlib.sha256(f).hexdigest(), feature(tensor), *tensor.shape[:2], tensor.tobytes()))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("n_bytes"), *cols], [id_col, "n_bytes", *names])

    return media.select(id_col, "n_bytes", jpeg_col).mapInArrow(run, schema)
