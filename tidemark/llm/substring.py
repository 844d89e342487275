"""Substring deduplication of whole texts by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least hash of its runs of GRAM words;
consecutive windows that share it travel as one packed string to the bucket of the minimiser, where
all windows are written out and sorted, so that equal windows are neighbours: windows are counted
exactly, equal hashes are confirmed by their bytes. A word goes if a window that covers it also
starts in a document with a smaller doc_id.

Skew. A packed string that its slice, or the task before, holds in a smaller document is decided where
it lies and does not travel, so a passage of a third of all documents is sent at most once a slice, in
whatever order the documents come. A row that repeats another is sent once a task and its ranges are
made distinct before they go back. A count of packed strings by bucket runs first; buckets of more
than OVERFULL times the mean (a phrase of a few words in ever other surroundings) are dealt out again
window by window, by the hash of the whole window. A bucket sorts its windows in parts of bounded size.

Defined results: null and empty texts have no words; a document with a null doc_id keeps all its
words and removes none elsewhere; rows that repeat a doc_id are documents of their own that remove
nothing from each other; texts of fewer than WINDOW words are kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ByteHash, Words, grams, slices, sliding_min, utf8

WINDOW = 13
GRAM = 2
#: Bytes of text for each bucket; windows that a bucket sorts at once.
BUCKET_BYTES = 8 << 20
OVERFULL = 3
SORTED = 1 << 20
#: Bytes of packed strings, and rows, that a task remembers to decide copies on the spot; emptied when full.
REMEMBERED_BYTES = 12 << 20
REMEMBERED_ROWS = 100_000
_CODEC = "zstd"
_LEVEL = 5
#: Bytes of text whose packed strings travel together: larger parts compress better. Bytes hashed at once.
SENT_BYTES = 4_000_000
_HASHED = 1_000_000


def _word_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """ByteHash of the words of a buffer, computed part by part: its tables take many times the bytes of a part."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        until = max(at + 1, int(np.searchsorted(end, start[at] + _HASHED, "right")))
        base, to = int(start[at]), int(end[until - 1])
        out[at:until] = ByteHash(codes[base:to]).of(start[at:until] - base, end[at:until] - base)
        at = until
    return out


class _Runs:
    """Super-k-mers of one slice of texts: first and last window (as word numbers) and bucket of each."""

    def __init__(self, texts: list[bytes], buckets: int, overfull: np.ndarray | None):
        self.words = words = Words(texts)
        hashes = _word_hashes(words.codes, words.start, words.end)
        least = sliding_min(grams(hashes, GRAM), WINDOW - GRAM + 1)
        window = np.flatnonzero(words.has_window(WINDOW)[: len(least)])
        least = least[window]
        if not len(window):
            self.first = self.last = self.bucket = np.zeros(0, np.int64)
            return
        begins = np.append(True, (np.diff(window) != 1) | (least[1:] != least[:-1]))
        at = np.flatnonzero(begins)
        self.first, self.last = window[at], window[np.append(at[1:], len(window)) - 1]
        self.bucket = _bucket(least[at], buckets)
        if overfull is not None and len(overfull):
            split = np.isin(self.bucket, overfull)
            size = (self.last - self.first + 1)[split]
            single = np.repeat(self.first[split] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            alone = grams(hashes, WINDOW)[single]
            self.first = np.concatenate([self.first[~split], single])
            self.last = np.concatenate([self.last[~split], single])
            self.bucket = np.concatenate([self.bucket[~split], _bucket(alone, buckets)])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _texts(part: pa.RecordBatch, known: set[tuple[int, int]]) -> list[bytes]:
    """Texts that take part: that of a null doc_id, and of a row that the task has had before, counts as empty."""
    if len(known) > REMEMBERED_ROWS:
        known.clear()
    rows = zip(part.column("doc_id").to_pylist(), part.column("sig").to_pylist(), strict=True)
    # set.add gives None: a name is taken once.
    fresh = [i is not None and (i, sig) not in known and known.add((i, sig)) is None for i, sig in rows]
    return [t if f else b"" for f, t in zip(fresh, utf8(part.column("text")), strict=True)]


def _overfull(named: DataFrame, buckets: int) -> np.ndarray:
    """Buckets with more than OVERFULL times the mean number of packed strings: at most 1 / OVERFULL of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        for part in slices(batches):
            bucket, n = np.unique(_Runs(_texts(part, known), buckets, None).bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n)], ["bucket", "n"])

    counts = named.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") > OVERFULL * (total / buckets) + 100).select("bucket").toLocalIterator()
    return np.array([r[0] for r in rows], np.int64)


def _packed(values: list[np.ndarray | bytes]) -> list[bytes]:
    codec = pa.Codec(_CODEC, compression_level=_LEVEL)
    return [codec.compress(v if isinstance(v, bytes) else v.tobytes(), asbytes=True) for v in values]


def _unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec=_CODEC, asbytes=True) if size else b""


_SENT = "bucket int, rows int, size int, texts binary, doc_ids binary, sigs binary, places binary, lengths binary"
_REMOVED = "doc_id long, sig long, place int, n int"


def _send(named: DataFrame, buckets: int, overfull: np.ndarray) -> DataFrame:
    """Packed strings by bucket, a row per slice and bucket; ranges decided on the spot, a row per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        held = 0
        known: set[tuple[int, int]] = set()
        for number, part in enumerate(slices(batches, most=SENT_BYTES)):
            runs = _Runs(_texts(part, known), buckets, overfull)
            words = runs.words
            if not len(runs.first):
                continue
            order = np.argsort(runs.bucket, kind="stable")
            first, last, bucket = runs.first[order], runs.last[order], runs.bucket[order]
            text = words.text[first]
            doc_id = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)[text]
            sig = part.column("sig").to_numpy()[text]
            place, length = words.place[first].astype(np.int32), (last - first + WINDOW).astype(np.int32)
            begin, end = words.start[first].tolist(), words.end[last + WINDOW - 1].tolist()
            strings = [words.data[a:b] for a, b in zip(begin, end, strict=True)]
            # The least document of every string, in this slice and in what the task remembers.
            docs = doc_id.tolist()
            for string, doc in zip(strings, docs, strict=True):
                least = seen.get(string)
                if least is None:
                    held += len(string)
                if least is None or doc < least:
                    seen[string] = doc
            travels = np.fromiter((seen[string] >= doc for string, doc in zip(strings, docs, strict=True)), bool, len(docs))
            if held > REMEMBERED_BYTES:
                seen.clear()
                held = 0
            rows = []
            own = np.flatnonzero(travels)
            name, at = np.unique(bucket[own], return_index=True)
            for b, i, j in zip(name.tolist(), at.tolist(), [*at[1:].tolist(), len(own)], strict=True):
                mine = own[i:j]
                joined = b"\n".join([strings[k] for k in mine.tolist()])
                rows.append((b, len(mine), len(joined), *_packed([joined, doc_id[mine], sig[mine], place[mine]]), None))
            done = np.flatnonzero(~travels)
            if len(done):
                # Any bucket may pass these on; each slice takes another one.
                b = int((int(doc_id[0]) * 31 + number) % buckets)
                rows.append((b, len(done), 0, None, *_packed([doc_id[done], sig[done], place[done], length[done]])))
            kinds = [pa.int32()] * 3 + [pa.binary()] * 5
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SENT.split(", ")])

    return named.mapInArrow(run, _SENT)


class _Bucket:
    """The packed strings of a bucket with all their windows written out."""

    def __init__(self, strings: bytes):
        self.codes = codes = np.frombuffer(strings, np.uint8)
        gaps = np.flatnonzero((codes == 32) | (codes == 10)).astype(np.int32)
        start, end = np.append(np.int32(0), gaps + np.int32(1)), np.append(gaps, np.int32(len(codes)))
        string = np.append(0, np.cumsum(codes[gaps] == 10)).astype(np.int32)
        window = np.flatnonzero(string[: len(string) - WINDOW + 1] == string[WINDOW - 1 :])
        self.name = grams(_word_hashes(codes, start, end), WINDOW)[window]
        self.string = string[window]
        self.start, self.end = start[window], end[window + WINDOW - 1]
        first = np.searchsorted(self.string, self.string, "left").astype(np.int32)
        self.offset = np.arange(len(window), dtype=np.int32) - first

    def gone(self, doc: np.ndarray) -> np.ndarray:
        """Windows that occur in a smaller document too, in order; equal windows lie in one part, parts are sorted one by one."""
        parts = len(self.name) // SORTED + 1
        share = (self.name >> np.uint64(5)) % np.uint64(parts) if parts > 1 else None
        out = []
        for k in range(parts):
            at = np.arange(len(self.name)) if share is None else np.flatnonzero(share == np.uint64(k))
            group = self.groups(at)
            least = np.full(int(group.max(initial=0)) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, doc[self.string[at]])
            out.append(at[doc[self.string[at]] > least[group]])
        return np.sort(np.concatenate(out))

    def groups(self, at: np.ndarray) -> np.ndarray:
        """A number for each of some windows, equal for equal windows only."""
        name = self.name[at]
        order = np.argsort(name, kind="stable")
        ordered = name[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])[: len(name)]
        group = np.empty(len(name), np.int64)
        group[order] = np.cumsum(fresh) - 1
        leader = order[np.flatnonzero(fresh)][group]
        wrong = group[~self._same(at, at[leader])]
        if len(wrong):  # other windows with the same hash: name these groups by their bytes
            known: dict[bytes, int] = {}
            data, base = self.codes.tobytes(), len(name)
            for k in np.flatnonzero(np.isin(group, wrong)).tolist():
                group[k] = base + known.setdefault(data[self.start[at[k]] : self.end[at[k]]], len(known))
        return group

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Are the bytes of windows a[i] and b[i] equal?"""
        size = self.end[a] - self.start[a]
        same = size == self.end[b] - self.start[b]
        look = np.flatnonzero(same & (a != b))
        for at in range(0, len(look), 50_000):
            k = look[at : at + 50_000]
            n = size[k]
            ramp = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            equal = self.codes[np.repeat(self.start[a[k]], n) + ramp] == self.codes[np.repeat(self.start[b[k]], n) + ramp]
            same[k] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return same


def _removed_here(strings: bytes, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first word in it, words) of the ranges whose windows start in a smaller document too."""
    bucket = _Bucket(strings)
    gone = bucket.gone(doc_id)
    if not len(gone):
        return gone, gone, gone
    string, offset = bucket.string[gone], bucket.offset[gone]
    begins = np.flatnonzero(np.append(True, (np.diff(string) != 0) | (np.diff(offset) != 1)))
    size = np.diff(np.append(begins, len(gone)))
    return string[begins], offset[begins], size + WINDOW - 1


def _meet(table: pa.Table) -> pa.Table:
    out = []
    strings, keys = [], []
    for row in table.to_pylist():
        n = row["rows"]
        doc_id = np.frombuffer(_unpacked(row["doc_ids"], 8 * n), np.int64)
        sig, place = np.frombuffer(_unpacked(row["sigs"], 8 * n), np.int64), np.frombuffer(_unpacked(row["places"], 4 * n), np.int32)
        if row["texts"] is None:
            out.append((doc_id, sig, place, np.frombuffer(_unpacked(row["lengths"], 4 * n), np.int32)))
        else:
            strings.append(_unpacked(row["texts"], row["size"]))
            keys.append((doc_id, sig, place))
    if strings:
        doc_id, sig, place = (np.concatenate(x) for x in zip(*keys, strict=True))
        string, first, n = _removed_here(b"\n".join(strings), doc_id)
        out.append((doc_id[string], sig[string], place[string] + first, n))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.table([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int32, np.int32), strict=True)], ["doc_id", "sig", "place", "n"])


def repeated_ranges(named: DataFrame) -> DataFrame:
    """(doc_id, sig, text) -> (doc_id, sig, place, n): ranges of words that a smaller document has too."""
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size // BUCKET_BYTES) + 1
    return _send(named, buckets, _overfull(named, buckets)).groupBy("bucket").applyInArrow(_meet, _REMOVED)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        kept, n_words, n_removed = [], [], []
        for text, ranges in zip(utf8(part.column("text")), part.column("ranges").to_pylist(), strict=True):
            words = text.split()
            n_words.append(len(words))
            if ranges:
                stay = np.ones(len(words), bool)
                for r in ranges:
                    stay[r["place"] : r["place"] + r["n"]] = False
                words = [words[k] for k in np.flatnonzero(stay).tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_words, n_removed, kept): the words that stay, joined by one blank.

    Rows are named by doc_id and a 64-bit hash of the text, so rows that repeat a doc_id keep their own ranges.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = named.withColumn("sig", F.xxhash64("text"))
    ranges = repeated_ranges(named).groupBy("doc_id", "sig").agg(F.collect_set(F.struct("place", "n")).alias("ranges"))
    joined = named.join(ranges, ["doc_id", "sig"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def digests(deduplicated: DataFrame) -> DataFrame:
    return deduplicated.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
