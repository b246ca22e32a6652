"""Shared pieces of the training-data operators: texts as bytes, words as hashes, stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from planloom.session import ensure_checkpoint_dir

ASCII_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TO_LOWER = bytes.maketrans(ASCII_UPPER, ASCII_UPPER.lower())
SPACES = b" \t\n\x0b\x0c\r"

# Text handled at once by code with several numbers per byte; a longer text stands alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder: read again, never computed again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, for wide rows of which later passes read some columns."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_buffer(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(1, np.int64), memoryview(b"")
    view = memoryview(data if data is not None else b"")[offsets[0] : offsets[-1]]
    return offsets - offsets[0], view


def lowered(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """Like :func:`text_buffer`, with A-Z in lower case."""
    offsets, data = text_buffer(column)
    return offsets, bytes(data).translate(TO_LOWER)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each, or one row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


def byte_class(*, excluded: bytes) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    inside = np.ones(256, bool)
    inside[list(excluded)] = False
    return inside


#: Words are runs without blanks and control blanks.
BLANK_WORDS = byte_class(excluded=SPACES)
#: Words are runs of lower-case letters, digits and bytes beyond ASCII.
ALNUM_WORDS = byte_class(
    excluded=bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
)


def word_spans(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the texts, and the number of words before each text."""
    flags = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, flags[:-1]
        after[-1], after[:-1] = False, flags[1:]
    starts = np.flatnonzero(flags & (~before | edge[:-1]))
    ends = np.flatnonzero(flags & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240501).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span lies."""
    forward, back = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * forward[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts])
