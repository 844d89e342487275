"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are folded (ASCII letters in lower case, every run of other ASCII
characters than letters and digits one blank), and each item is cut into overlapping segments, long
ones and, for excerpts, short ones at a dense stride: an unedited excerpt of an item is found at any
offset if it has EXCERPT folded characters. A region of a text within e edits of a segment of n characters shares at least n + 1 - q (e + 1)
q-grams with it, and all of them lie on e + 1 neighbouring diagonals. Shared q-grams are counted in
diagonal bands of twice that width that overlap by half, so one band holds them all; bands that
reach the bound are regions, and every region is verified by banded alignment.

The benchmark is read in blocks of bounded size, each sent with the tasks of one pass over the
texts, so nothing that is broadcast grows with either table. Characters are UTF-8 bytes here: an
edited letter outside ASCII counts as its bytes.

Defined results: null and empty texts and items match nothing; so do segments of fewer than q
characters; repeated rows and repeated items are matched alike; regions of one text and
item that overlap are reported as one, with the most edits of a segment in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import CodePoints, disjoint, mixed, slices, utf8

Q = 10
#: Edits allowed per character, and characters of a segment.
EDIT_RATE = 0.08
SEGMENT = 120
#: Short segments and the characters from one to the next; an excerpt of EXCERPT characters holds one of them whole.
SHORT, STRIDE = 60, 15
EXCERPT = SHORT + STRIDE - 1
#: q-grams that a region must share at least, whatever its length.
LEAST_SHARED = 5
#: Characters of benchmark text in one pass over the documents.
BLOCK_CHARS = 1 << 19
MATCH_TYPE = "doc_id long, item_id long, start int, end int, edits int"

_FOLD = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _FOLD[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_FILTER_BITS = 22


def folded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded texts in one buffer with 0 between them, the begin of each, and the place each byte came from."""
    raw = np.frombuffer(b"\0".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size - 1
    code = _FOLD[raw]
    code[begin[1:] - 1] = 0
    keep = code != 32
    keep[1:] |= (code[:-1] != 32) & (code[:-1] != 0)
    place = np.flatnonzero(keep)
    return code[place], np.searchsorted(place, begin), place


def qgram_hashes(code: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes from each place on (exact in its first step: Q bytes fit into 2 words)."""
    n = len(code) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    two = code[:-1].astype(np.uint64) | (code[1:].astype(np.uint64) << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    return mixed(eight[:n] * np.uint64(0x9E3779B97F4A7C15) + two[8 : 8 + n])


def edit_budget(n: int) -> int:
    """Edits allowed in a segment of n characters; -1 if it is too short to be looked for."""
    if n < Q:
        return -1
    return max(0, min(int(EDIT_RATE * n), (n + 1 - LEAST_SHARED) // Q - 1))


class Segments:
    """Folded segments of benchmark items with an index of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.item: list[int] = []
        self.code: list[np.ndarray] = []
        for item_id, raw in items:
            code, _, _ = folded([raw])
            code = code[: len(code) - 1] if len(code) and code[-1] == 32 else code
            for length, stride in ((SEGMENT, SEGMENT // 2), (SHORT, STRIDE)):
                if length == SHORT and len(code) <= SHORT:
                    break  # the item itself is a segment already
                last = max(0, len(code) - length)
                for at in sorted({*range(0, last, stride), last}):
                    part = code[at : at + length]
                    if edit_budget(len(part)) >= 0:
                        self.item.append(item_id)
                        self.code.append(part)
        self.size = np.array([len(c) for c in self.code], np.int64)
        self.budget = np.array([edit_budget(n) for n in self.size.tolist()], np.int64)
        self.bound = np.maximum(1, self.size + 1 - Q * (self.budget + 1))
        hashes = [qgram_hashes(c) for c in self.code]
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        segment = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(h)) for h in hashes]]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.segment, self.place = segment[order], place[order]
        self.grams, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.grams >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text place, segment, segment place) of every shared q-gram."""
        none = np.zeros(0, np.int64)
        if not len(self.grams):
            return none, none, none
        where = np.flatnonzero(self.filter[grams >> np.uint64(64 - _FILTER_BITS)])
        at = np.minimum(np.searchsorted(self.grams, grams[where]), len(self.grams) - 1)
        same = self.grams[at] == grams[where]
        where, at = where[same], at[same]
        times = self.times[at]
        ends = np.cumsum(times)
        entry = np.repeat(self.first[at] - (ends - times), times) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.repeat(where, times), self.segment[entry], self.place[entry]


def regions(segments: Segments, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, first diagonal of its band) of the bands that reach the bound."""
    where, segment, place = segments.hits(grams)
    width = segments.budget[segment] + 1
    diagonal = where - place + SEGMENT
    step = diagonal // width
    span = int(step.max(initial=0)) + 2
    # Band b covers diagonals b * width .. (b + 2) * width - 1: a hit lies in the bands step - 1 and step.
    key, count = np.unique(np.concatenate([segment * span + step, segment * span + step - 1]), return_counts=True)
    owner = key // span
    full = count >= segments.bound[owner]
    key, owner = key[full], owner[full]
    return owner, (key - owner * span) * (segments.budget[owner] + 1) - SEGMENT


def aligned(segment: np.ndarray, text: np.ndarray, first: int, band: int, budget: int) -> tuple[int, int, int] | None:
    """Best (edits, start, end) of the whole segment within `text`, kept on diagonals first .. first + band - 1.

    Cells of row i are the text places i + first + c; the start of the best path travels with it.
    """
    far = budget + 1
    column = np.arange(band)
    place = first + column
    cost = np.where((place >= 0) & (place <= len(text)), 0, far)
    start = place.copy()
    for i, letter in enumerate(segment.tolist()):
        # Row i + 1: place + i + 1 on each diagonal; a step down is the diagonal to the right.
        at = place + i
        inside = (at >= 0) & (at < len(text))
        differs = np.ones(band, np.int64)
        differs[inside] = text[at[inside]] != letter
        best = np.where(inside, cost + differs, far)
        origin = start.copy()
        down = np.append(cost[1:] + 1, far)
        less = down < best
        best[less] = down[less]
        origin[less] = np.append(start[1:], 0)[less]
        best[(at + 1 < 0) | (at + 1 > len(text))] = far
        # Steps to the right within the row cost one each.
        through = best - column
        low = np.minimum.accumulate(through)
        source = np.maximum.accumulate(np.where(through == low, column, 0))
        source = np.where(through == low, column, source)
        right = low + column
        cost = np.where((at + 1 < 0) | (at + 1 > len(text)), far, np.minimum(right, far))
        start = origin[source]
        if cost.min() > budget:
            return None
    k = int(cost.argmin())
    return int(cost[k]), int(start[k]), int(place[k] + len(segment))


def _matches(segments: Segments, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start byte, end byte, edits) for one slice of texts."""
    code, begin, origin = folded(texts)
    ends = np.append(begin[1:] - 1, len(code))
    grams = qgram_hashes(code)
    owner, first = regions(segments, grams)
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    raw_begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    for s, d in zip(owner.tolist(), first.tolist(), strict=True):
        budget, n = int(segments.budget[s]), int(segments.size[s])
        width = 2 * (budget + 1)
        # The region's middle names its text; texts are apart by a byte that no segment holds.
        t = int(np.searchsorted(begin, min(len(code) - 1, max(0, d + width // 2 + n // 2)), "right")) - 1
        for k in {max(0, t - 1), t, min(len(texts) - 1, t + 1)}:
            if begin[k] > d + width + n or ends[k] < d:
                continue
            hit = _verified(segments.code[s], code[begin[k] : ends[k]], d - int(begin[k]), width, budget)
            if hit:
                edits, a, b = hit
                found.setdefault((k, s), []).append((edits, int(begin[k]) + max(a, 0), int(begin[k]) + b))
    spans: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for (k, s), hits in found.items():
        for edits, a, b in disjoint(sorted(set(hits))):
            spans.setdefault((k, segments.item[s]), []).append((int(origin[a] - raw_begin[k]), int(origin[b - 1] + 1 - raw_begin[k]), edits))
    return [(k, item, *span) for (k, item), own in spans.items() for span in _united(own)]


def _united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping (start, end, edits) of neighbouring segments as one, with the most edits among them."""
    out: list[tuple[int, int, int]] = []
    for a, b, edits in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(edits, out[-1][2]))
        else:
            out.append((a, b, edits))
    return out


def _verified(segment: np.ndarray, text: np.ndarray, first: int, band: int, budget: int) -> tuple[int, int, int] | None:
    """As aligned(); a region that holds the segment itself needs no table."""
    low = max(0, first)
    at = text[low : max(low, first + band - 1 + len(segment))].tobytes().find(segment.tobytes())
    return (0, low + at, low + at + len(segment)) if at >= 0 else aligned(segment, text, first, band, budget)


def _blocks(benchmark: DataFrame) -> Iterator[Segments]:
    """The benchmark in blocks of at most BLOCK_CHARS characters (one longer item alone)."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    block: list[tuple[int, bytes]] = []
    size = 0
    for item_id, text in items.toLocalIterator():
        if block and size + len(text) > BLOCK_CHARS:
            yield Segments(block)
            block, size = [], 0
        block.append((item_id, text.encode()))
        size += len(text)
    yield Segments(block)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text) x (item_id, text) -> (doc_id, item_id, start, end, edits), code points of the whole text.

    One row per region of a document that is within the edit budget of a segment of the item.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passes = [texts.mapInArrow(_leak_rows(segments), MATCH_TYPE) for segments in _blocks(benchmark)]
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def _leak_rows(segments: Segments):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = utf8(part.column("text"))
            ids = part.column("doc_id").to_pylist()
            rows = []
            for k, hits in groupby(sorted(_matches(segments, texts)), key=lambda h: h[0]):
                points = CodePoints(texts[k])
                rows += [(ids[k], item, points.before(a), points.before(b), edits) for _, item, a, b, edits in hits]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["doc_id", "item_id", "start", "end", "edits"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no benchmark passage is found, with all their columns."""
    out = docs
    for segments in _blocks(benchmark):
        out = out.mapInArrow(_without_leaks(segments), docs.schema)
    return out


def _without_leaks(segments: Segments):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            stay = np.ones(part.num_rows, bool)
            stay[[k for k, *_ in _matches(segments, utf8(part.column("text")))]] = False
            yield part.filter(pa.array(stay))

    return run
