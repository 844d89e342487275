"""What the training-data operators share: batches of whole texts, word hashes, checkpoints.

Texts travel to Python as Arrow batches and are worked on in slices of bounded size; a text is
never cut, so one text that is longer than the bound makes a slice of its own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_folder

#: Code points that separate words: blank and U+0009 to U+000D, as `bytes.split()` has them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A little under 1 MiB, so that the tables of powers have 1 Mi entries.
SLICE_BYTES = 1_000_000
#: Rows of an Arrow batch: with whole texts, the default of 10,000 holds more than a task may need at once.
BATCH_ROWS = 1024

# Odd 64-bit multipliers of the word and window hashes.
_BASE = 0x9E3779B97F4A7C13
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BYTE_CODES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def bounded_batches(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose texts together hold about `most` bytes, a single longer text alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null is the empty text."""
    return column.fill_null("").cast(pa.binary()).to_pylist()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class ByteHash:
    """Hashes of byte ranges of one buffer, equal for equal content wherever it lies."""

    def __init__(self, data: np.ndarray):
        self._power, self._inverse = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * self._power[: len(data)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))


class Words:
    """Words of a slice of texts: joined by one blank in `data`, with their ends and their texts.

    `start`, `end`: byte range of each word in `data`; `text`: index of its text; `place`: its number
    in that text; `count`: words of each text. Ranges of neighbouring words of a text are one string.
    """

    def __init__(self, texts: list[bytes]):
        joined = [b" ".join(t.split()) for t in texts]
        self.count = np.array([t.count(b" ") + 1 if t else 0 for t in joined], np.int64)
        self.data = b"\n".join(t for t in joined if t)
        codes = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero((codes == 32) | (codes == 10))
        n = int(self.count.sum())
        self.start = np.concatenate([[0], gaps + 1])[:n]
        self.end = np.concatenate([gaps, [len(codes)]])[:n]
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.first = np.cumsum(self.count) - self.count
        self.place = np.arange(n) - np.repeat(self.first, self.count)
        self.codes = codes

    def hashes(self) -> np.ndarray:
        return ByteHash(self.codes).of(self.start, self.end)

    def has_window(self, width: int) -> np.ndarray:
        """For each word: do `width` words of its text begin there?"""
        return self.place + width <= self.count[self.text]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours (as many as there are runs)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(out)]
    return mixed(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    if len(values) < width:
        return values[:0]
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows from files in the cluster's shared checkpoint folder, which outlive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)




class CodePoints:
    """Code points before byte places of a UTF-8 text, and the byte spans of its words."""

    def __init__(self, text: bytes):
        self._codes = np.frombuffer(text, np.uint8)
        self._before = None if text.isascii() else np.append(0, np.cumsum((self._codes & 0xC0) != 0x80))

    def before(self, at: int) -> int:
        return at if self._before is None else int(self._before[at])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        solid = (self._codes != 32) & ((self._codes < 9) | (self._codes > 13))
        edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def disjoint(ranked: list[tuple], span=lambda hit: (hit[1], hit[2])) -> list[tuple]:
    """Of hits in order of preference those that overlap none before them."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for hit in ranked:
        a, b = span(hit)
        k = bisect_left(starts, a)
        if (k and ends[k - 1] > a) or (k < len(starts) and starts[k] < b):
            continue
        starts.insert(k, a)
        ends.insert(k, b)
        out.append(hit)
    return out
