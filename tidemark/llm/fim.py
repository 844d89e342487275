"""Fill-in-middle transformation of whole texts over seekable compressed frames.

A text is stored as independent zstandard frames, each of whole units (a word with the blanks before
it, or the blanks that end a text) and about FRAME_BYTES long; the frames carry the units, code points
and bytes up to their end. Two units are drawn from a hash of the document's id. Only the frames in
which they lie are decompressed, cut and compressed again; all others are moved as they are. The result
is a sequence of frames too, in the order of the form: joined they are one zstandard file that any
reader decodes, and digests read them one after the other.

Forms: plain, the text; psm, `<P>` prefix `<S>` suffix `<M>` middle; spm, `<S>` suffix `<P>` prefix
`<M>` middle. A text that holds a mark stays plain, so a form can always be undone.

Defined results: null and empty texts are plain, without frames and with n = 0; a null doc_id stays
plain; rows that repeat a doc_id are cut by the same draws, each in its own text; a unit longer than a
frame is a frame of its own; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, utf8

SEED = 42
#: Of 100 texts so many are transformed, and of 100 transformed so many are spm.
RATE, SPM = 50, 80
FRAME_BYTES = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Order of the parts (0 prefix, 1 middle, 2 suffix), each after its mark.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
_LEVEL = 3


def unit_ends(text: bytes) -> np.ndarray:
    """Byte ends of the units: those of the words, and that of the text if it ends with blanks."""
    codes = np.frombuffer(text, np.uint8)
    solid = (codes != 32) & ((codes < 9) | (codes > 13))
    ends = np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1
    return ends if not len(codes) or solid[-1] else np.append(ends, len(codes))


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=_LEVEL).compress(data)


class Frames:
    """A text as frames; `units`, `chars`: how many end with each frame, counted from the text's start."""

    def __init__(self, text: bytes, size: int = FRAME_BYTES):
        ends = unit_ends(text)
        cuts, at = [], 0
        while at < len(text):
            # The last unit that ends within `size` bytes, or else the one that goes on beyond them.
            k = max(int(np.searchsorted(ends, at + size, "right")) - 1, int(np.searchsorted(ends, at, "right")))
            cuts.append(k)
            at = int(ends[k])
        begin = [0, *(int(ends[k]) for k in cuts)]
        parts = [text[a:b] for a, b in zip(begin, begin[1:], strict=False)]
        self.data = [packed(p) for p in parts]
        self.units = np.array([k + 1 for k in cuts], np.int64)
        self.chars = np.cumsum([code_points(p) for p in parts], dtype=np.int64)
        self.n = len(ends)

    def split(self, unit: int) -> tuple[int, bytes, bytes, int]:
        """Where the first `unit` units end: number of whole frames before, the two parts of the frame cut there, code points before."""
        k = int(np.searchsorted(self.units, unit, "right"))
        before_units, before_chars = (int(self.units[k - 1]), int(self.chars[k - 1])) if k else (0, 0)
        if unit == before_units:
            return k, b"", b"", before_chars
        frame = zstandard.ZstdDecompressor().decompress(self.data[k])
        end = int(unit_ends(frame)[unit - before_units - 1])
        return k, frame[:end], frame[end:], before_chars + code_points(frame[:end])

    def cut(self, first: int, second: int) -> tuple[list[list[bytes]], int, int]:
        """Frames of the parts before, between and after two unit counts; code points of the first two."""
        i, head, rest, before = self.split(first)
        j, middle_end, tail, upto = self.split(second)
        own = lambda data: [packed(data)] if data else []
        prefix = self.data[:i] + own(head)
        if i == j and rest and middle_end:  # both cuts lie in one frame
            middle = own(middle_end[len(head):])
        else:
            middle = own(rest) + self.data[i + bool(head) : j] + own(middle_end)
        return [prefix, middle, own(tail) + self.data[j + bool(middle_end) :]], before, upto - before


def draws(doc_id: int, seed: int = SEED) -> list[int]:
    digest = hashlib.sha256(b"%d:%d" % (seed, doc_id)).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def _form(doc_id: int | None, text: bytes, seed: int, rate: int, spm: int) -> str:
    if not text or doc_id is None or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain"
    _, _, third, fourth = draws(doc_id, seed)
    return "plain" if third % 100 >= rate else "spm" if fourth % 100 < spm else "psm"


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                     ("middle_chars", pa.int64()), ("frames", pa.list_(pa.binary()))])


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, text) -> (doc_id, n, form, prefix_chars, middle_chars, frames): the transformed text as ordered zstandard frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = {mark: packed(mark) for mark in (PREFIX, SUFFIX, MIDDLE)}
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8(part.column("text")), strict=True):
                frames, form = Frames(text, frame_bytes), _form(doc_id, text, seed, rate, spm)
                if form == "plain":
                    rows.append((doc_id, frames.n, form, None, None, frames.data))
                    continue
                first, second = sorted(h % (frames.n + 1) for h in draws(doc_id, seed)[:2])
                parts, prefix_chars, middle_chars = frames.cut(first, second)
                out = [f for mark, k in ORDERS[form] for f in (marks[mark], *parts[k])]
                rows.append((doc_id, frames.n, form, prefix_chars, middle_chars, out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>")


def opened(frames: list[bytes]) -> Iterator[bytes]:
    reader = zstandard.ZstdDecompressor()
    return (reader.decompress(f) for f in frames)


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The text that a form was made of, in pieces: one frame is held at a time."""
    if form == "plain":
        yield from opened(frames)
        return
    # The marks are frames of their own, and no other frame equals one: the text holds no mark.
    parts: dict[int, list[bytes]] = {}
    part: list[bytes] = []
    order = dict(ORDERS[form])
    sizes = {len(packed(mark)) for mark in order}
    for frame in frames:
        mark = zstandard.ZstdDecompressor().decompress(frame) if len(frame) in sizes else b""
        if mark in order:
            part = parts.setdefault(order[mark], [])
        else:
            part.append(frame)
    for k in range(3):
        yield from opened(parts[k])


def _digest(pieces: Iterator[bytes]) -> str:
    total = hashlib.sha256()
    for piece in pieces:
        total.update(piece)
    return total.hexdigest()


def digests(transformed: DataFrame) -> DataFrame:
    """The counts of `transform` with digests of the output and of the text rebuilt from output and form."""
    columns = [c for c in transformed.columns if c != "frames"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column("frames").to_pylist(), batch.column("form").to_pylist(), strict=True))
            output = pa.array([_digest(opened(frames)) for frames, _ in rows], pa.string())
            back = pa.array([_digest(restored(frames, form)) for frames, form in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), output, back], [*columns, "output_sha256", "restored_sha256"])

    return transformed.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def texts(transformed: DataFrame) -> DataFrame:
    """The counts of `transform` with the output as plain text."""
    columns = [c for c in transformed.columns if c != "frames"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.array([b"".join(opened(f)) for f in batch.column("frames").to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), whole], [*columns, "output"])

    return transformed.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
