"""Phrase collocations by weighted acyclic automata.

A window is a word with up to SPAN - 1 words that follow it in its piece. Tasks gather shards of whole
texts and build of each shard's sorted windows a count transducer: an acyclic automaton whose first
transition is the language and whose further ones are words, with the number of windows that end in a
state as its weight, so that a phrase counts what all windows behind its state weigh. Transducers are cut
into prefix ranges, one range of each shard meets in a task, and their union sums the weights. Of the
union only phrases of MIN_COUNT or more remain, and those whose windows go on in the next range; the
range in which a phrase begins adds up its weight. Then every range asks for the parts of its candidates:
an acceptor of the parts is composed with the counts of the range that holds them.

Skew. Ranges are cut at windows drawn from all texts at equal distances, so a frequent word is spread
over as many ranges as its windows fill; equal windows of a shard are one path. The sample decides only
where ranges end, never what is counted. With more than FAN ranges the union runs in rounds: FAN shards meet in
a wide range before they are cut into narrower ones, so pieces do not thin out as the tables grow.

Everything is exact: words are compared as bytes, products are decimal or Python integers.

Defined results: null and empty texts have no words; a null lang is `und`; rows that repeat a doc_id are
texts of their own; a lang without candidates has no rows. Columns other than lang and text are not read.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, slices, utf8

SPAN = 4
MIN_COUNT = 30
SCORE = 2_000_000
#: A phrase goes if a longer candidate holds it and has this many percent of its count.
SHADOW_PERCENT = 80
MOST = 2000
#: Bytes of text of a shard and of a prefix range; windows drawn for each range; most ranges.
SHARD_BYTES = 6 << 20
RANGE_BYTES = 8 << 20
SAMPLES = 16
MOST_RANGES = 1 << 16
#: Most shards and ranges that meet in one round of unions; tasks whose shards are told apart, at most.
FAN = 256
MOST_TASKS = 1 << 20
#: Bytes of a text that are split into words at once.
SEGMENT = 1 << 20
_CODEC = "zstd"

#: A lang and SPAN words; an absent word is empty.
Prefix = tuple[bytes, ...]

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
# Each separator becomes the word "." (which no word holds), a tab a blank.
_FOLD = bytes(46 if c in _SEPARATORS else 32 if c == 9 else c for c in range(256))


def folded(text: bytes) -> bytes:
    return text.lower().translate(_FOLD).replace(b".", b" . ")


def segments(text: bytes, size: int = SEGMENT) -> Iterator[list[bytes]]:
    """The words of a text in order, pieces divided by ".", in lists of bounded bytes."""
    text = folded(text)
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            blank = text.rfind(b" ", at, end)
            end = blank if blank > at else text.find(b" ", end)
            end = len(text) if end < 0 else end
        words = text[at:end].split()
        if words:
            yield words
        at = end


class _Ids(dict):
    """Numbers of words as they come; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _packed(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return pa.compress(planes.tobytes(), codec=_CODEC, asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=width * n, codec=_CODEC, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


class Transducer:
    """Sorted paths of an acyclic automaton and their weights.

    `columns`: for every path the number of its lang, then of its words (1 for the first word, 0 where the path
    has ended); `langs`, `words`: the labels, sorted, so that numbers compare as labels do; `weight`: of each path.
    """

    def __init__(self, langs: list[bytes], words: list[bytes], columns: list[np.ndarray], weight: np.ndarray):
        self.langs, self.words, self.columns, self.weight = langs, words, columns, weight

    def __len__(self) -> int:
        return len(self.weight)

    @staticmethod
    def summed(langs: list[bytes], words: list[bytes], columns: list[np.ndarray], weight: np.ndarray) -> Transducer:
        """Of paths in any order: sorted, equal ones summed."""
        if not len(weight):
            return Transducer(langs, words, columns, weight)
        labels = len(words) + 1
        key = columns[0].astype(np.int64)
        for k in range(1, len(columns), 2):
            pair = columns[k].astype(np.int64) * labels + (columns[k + 1] if k + 1 < len(columns) else 0)
            name, rank = np.unique(pair, return_inverse=True)
            if int(key.max(initial=0) + 1) * len(name) >= 1 << 62:
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(name) + rank
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        at = order[first]
        return Transducer(langs, words, [c[at] for c in columns], np.add.reduceat(weight[order], first))

    def taken(self, rows: np.ndarray | slice) -> Transducer:
        return Transducer(self.langs, self.words, [c[rows] for c in self.columns], self.weight[rows])

    def place(self, prefix: Prefix) -> int:
        """Number of paths that lie before a prefix."""
        low, high = 0, len(self)
        for column, label, labels, first in zip(self.columns, prefix, [self.langs] + [self.words] * SPAN, [0] + [1] * SPAN, strict=True):
            if first and not label:
                return low  # a path that ends here comes before all that go on
            k = bisect_left(labels, label)
            if k == len(labels) or labels[k] != label:
                return low + int(np.searchsorted(column[low:high], k + first))
            low, high = low + int(np.searchsorted(column[low:high], k + first, "left")), low + int(np.searchsorted(column[low:high], k + first, "right"))
        return low

    def prefix(self, row: int) -> Prefix:
        return (self.langs[self.columns[0][row]], *(self.words[c[row] - 1] if c[row] else b"" for c in self.columns[1:]))

    def pieces(self, bounds: list[Prefix]) -> Iterator[tuple[int, Transducer]]:
        """The paths of each range that has some; range k begins at bounds[k - 1]."""
        at = [0, *(self.place(b) for b in bounds), len(self)]
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if a < b:
                yield k, self.taken(slice(a, b))

    def _new(self) -> list[np.ndarray]:
        """For each depth the paths that enter a new state there."""
        fresh = np.zeros(len(self), bool)
        if len(self):
            fresh[0] = True
        out = []
        for column in self.columns:
            fresh = fresh.copy()
            fresh[1:] |= column[1:] != column[:-1]
            out.append(fresh)
        return out

    def packed(self) -> bytes:
        """States by depth: labels, number of transitions, and the weight of paths that end in the state."""
        used = np.zeros(len(self.words) + 1, bool)
        for c in self.columns[1:]:
            used[c] = True
        used[0] = False
        name = np.cumsum(used).astype(np.uint32)
        words = b"\n".join([self.words[k - 1] for k in np.flatnonzero(used).tolist()])
        langs = b"".join(struct.pack("<i", len(x)) + x for x in self.langs)
        out = [langs, words]
        new = self._new()
        depth = len(self.columns)
        for k, column in enumerate(self.columns):
            there = np.ones(len(self), bool) if k == 0 else column > 0
            enters = np.flatnonzero(new[k] & there)
            state = np.cumsum(new[k] & there) - 1
            ends = there & (self.columns[k + 1] == 0) if k + 1 < depth else there
            weight = np.zeros(len(enters), np.int64)
            weight[state[ends]] = self.weight[ends]
            if k + 1 < depth:
                fan = np.bincount(state[new[k + 1] & (self.columns[k + 1] > 0)], minlength=len(enters)).astype(np.uint32)
            else:
                fan = np.zeros(0, np.uint32)
            labels = column[enters].astype(np.uint32) if k == 0 else name[column[enters]]
            out += [_packed(labels), _packed(fan), _packed(weight)]
        sizes = [len(langs), len(words), *(int(np.count_nonzero(new[k] & (self.columns[k] > 0 if k else True))) for k in range(depth))]
        out[1] = pa.compress(words, codec=_CODEC, asbytes=True)
        return struct.pack(f"<{len(sizes)}q", *sizes) + b"".join(struct.pack("<i", len(x)) + x for x in out)

    @staticmethod
    def unpacked(data: bytes) -> Transducer:
        depth = SPAN + 1
        sizes = struct.unpack_from(f"<{depth + 2}q", data)
        at, blocks = 8 * (depth + 2), []
        while at < len(data):
            n = struct.unpack_from("<i", data, at)[0]
            blocks.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        langs, at = [], 0
        while at < len(blocks[0]):
            n = struct.unpack_from("<i", blocks[0], at)[0]
            langs.append(blocks[0][at + 4 : at + 4 + n])
            at += 4 + n
        words = pa.decompress(blocks[1], decompressed_size=sizes[1], codec=_CODEC, asbytes=True).split(b"\n") if sizes[1] else []
        label, fan, weight = ([_unpacked(blocks[2 + 3 * k + j], sizes[2 + k] if j != 1 or k + 1 < depth else 0, t) for k in range(depth)]
                              for j, t in enumerate((np.uint32, np.uint32, np.int64)))
        # Paths end in a state (their weight says so) before those that go on from it.
        columns, weights = [np.zeros(0, np.int32)] * depth, np.zeros(0, np.int64)
        for k in range(depth - 1, -1, -1):
            ends = weight[k] > 0
            below = np.zeros(len(label[k]), np.int64)
            if k + 1 < depth:
                owner = np.repeat(np.arange(len(label[k])), fan[k])
                below = np.bincount(owner, paths, minlength=len(label[k])).astype(np.int64)
            total = below + ends
            begin = np.cumsum(total) - total
            merged = np.zeros(int(total.sum()), np.int64)
            inner = np.ones(len(merged), bool)
            inner[begin[ends]] = False
            merged[begin[ends]], merged[inner] = weight[k][ends], weights
            weights = merged
            for j in range(k + 1, depth):
                whole = np.zeros(len(merged), np.int32)
                whole[inner] = columns[j]
                columns[j] = whole
            columns[k] = np.repeat(label[k].astype(np.int32), total)
            paths = total
        return Transducer(langs, words, columns, weights)

    @staticmethod
    def union(parts: list[Transducer]) -> Transducer:
        if len(parts) == 1:
            return parts[0]
        langs = sorted({x for p in parts for x in p.langs})
        words = sorted({x for p in parts for x in p.words})
        of_lang, of_word = {x: k for k, x in enumerate(langs)}, {x: k + 1 for k, x in enumerate(words)}
        columns: list[list[np.ndarray]] = [[] for _ in range(SPAN + 1)]
        for p in parts:
            lang = np.array([of_lang[x] for x in p.langs], np.int32)
            word = np.array([0, *map(of_word.__getitem__, p.words)], np.int32)
            for k, c in enumerate(p.columns):
                columns[k].append((word if k else lang)[c])
        return Transducer.summed(langs, words, [np.concatenate(c) for c in columns], np.concatenate([p.weight for p in parts]))

    def phrases(self, least: int) -> tuple[Transducer, np.ndarray]:
        """Phrases and what the windows behind their states weigh: those of `least` or more and those of the first or
        last window, which other ranges may share; and which of them the first window begins with."""
        new = self._new()
        columns, weight, first = [], [], []
        for k in range(1, SPAN + 1):
            begin = np.flatnonzero(new[k])
            total = np.add.reduceat(self.weight, begin)
            keep = np.flatnonzero((self.columns[k][begin] > 0) & ((total >= least) | (begin == 0) | (np.append(begin[1:], len(self)) == len(self))))
            rows = begin[keep]
            columns.append([c[rows] if j <= k else np.zeros(len(rows), np.int32) for j, c in enumerate(self.columns)])
            weight.append(total[keep])
            first.append(rows == 0)
        joined = [np.concatenate(c) for c in zip(*columns, strict=True)]
        order = np.lexsort(joined[::-1])
        return Transducer(self.langs, self.words, [c[order] for c in joined], np.concatenate(weight)[order]), np.concatenate(first)[order]

    def composed(self, parts: Transducer) -> np.ndarray:
        """Weights of the paths that `parts` accepts, in its order; 0 for one that this automaton has not."""
        out = np.zeros(len(parts), np.int64)
        if not len(self):
            return out
        of_lang, of_word = {x: k for k, x in enumerate(self.langs)}, {x: k + 1 for k, x in enumerate(self.words)}
        lang = np.array([of_lang.get(x, -1) for x in parts.langs], np.int64)
        word = np.array([0, *(of_word.get(x, -1) for x in parts.words)], np.int64)
        new, width = self._new(), max(len(self.words) + 1, len(self.langs))
        state, alive, parent = np.zeros(len(parts), np.int64), np.ones(len(parts), bool), np.zeros(len(self), np.int64)
        for k, column in enumerate(self.columns):
            there = column > 0 if k else np.ones(len(self), bool)
            ends = there & (self.columns[k + 1] == 0) if k < SPAN else there
            enters = np.flatnonzero(new[k] & there)
            here = np.cumsum(new[k] & there) - 1
            weight = np.zeros(len(enters), np.int64)
            weight[here[ends]] = self.weight[ends]
            asked = (word if k else lang)[parts.columns[k]]
            wanted = state * width + asked
            transitions = parent[enters] * width + column[enters]
            at = np.searchsorted(transitions, wanted)
            alive = alive & (asked > 0 if k else asked >= 0) & (np.append(transitions, -1)[at] == wanted)
            stops = alive & (parts.columns[k + 1] == 0) if k < SPAN else alive
            out[stops] = weight[at[stops]]
            state, parent = np.where(alive, at, 0), here
        return out


def _shard(langs: list[bytes], ids: _Ids, lang: np.ndarray, word: np.ndarray, until: int) -> Transducer:
    """Windows that begin before position `until` of a sequence of words."""
    words = sorted(w for w in ids if w != b".")
    rank = np.zeros(len(ids), np.int32)
    rank[[ids[w] for w in words]] = np.arange(1, len(words) + 1)
    word = np.concatenate([rank[word], np.zeros(SPAN, np.int32)])
    begin = np.flatnonzero(word[:until])
    columns = [lang[begin], word[begin]]
    for k in range(1, SPAN):
        columns.append(np.where(columns[-1] > 0, word[begin + k], 0))
    order = sorted(range(len(langs)), key=langs.__getitem__)
    place = np.empty(len(langs), np.int32)
    place[order] = np.arange(len(langs))
    columns[0] = place[columns[0]]
    return Transducer.summed([langs[k] for k in order], words, columns, np.ones(len(begin), np.int64))


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Transducer]:
    """Count transducers of whole texts (lang, text), one for about `size` bytes."""
    langs: dict[bytes, int] = {}
    ids, lang, word, held = _Ids(), [], [], 0

    def flushed(last: bool) -> tuple[Transducer, list[tuple[int, bytes]]]:
        all_words, all_langs = np.concatenate(word), np.concatenate(lang)
        until = len(all_words) if last else max(0, len(all_words) - SPAN + 1)
        names = list(ids)
        rest = [(int(all_langs[k]), names[all_words[k]]) for k in range(until, len(all_words))]
        return _shard(list(langs), ids, all_langs, all_words, until), rest

    for part in slices(batches):
        for name, text in zip(utf8(part.column("lang")), utf8(part.column("text")), strict=True):
            number = langs.setdefault(name, len(langs))
            for found in segments(text):
                word.append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
                lang.append(np.full(len(found), number, np.int32))
                held += sum(map(len, found))
                if held >= size:
                    shard, rest = flushed(False)
                    yield shard
                    # The last words begin windows that go on in the next shard.
                    ids, held = _Ids(), 0
                    word, lang = [np.array([ids[w] for _, w in rest], np.int32)], [np.array([k for k, _ in rest], np.int32)]
            if word and len(word[-1]):
                word.append(np.zeros(1, np.int32))
                lang.append(np.full(1, number, np.int32))
    if word and sum(map(len, word)):
        yield flushed(True)[0]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _bounds(texts: DataFrame, range_bytes: int) -> list[Prefix]:
    """Where ranges begin: of windows drawn at equal distances from all texts every SAMPLES-th in order."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    stride = max(1, range_bytes, total // MOST_RANGES) // SAMPLES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.random.default_rng(TaskContext.get().partitionId()).integers(0, stride)
        for part in slices(batches):
            drawn = []
            for lang, text in zip(utf8(part.column("lang")), utf8(part.column("text")), strict=True):
                while at < len(text):
                    # A window of the bytes that follow; cut words make a bound as good as whole ones.
                    words = folded(text[at : at + 2000]).split()
                    begin = next((k for k in range(min(1, len(words)), len(words)) if words[k] != b"."), None)
                    if begin is not None:
                        window = words[begin : begin + SPAN]
                        drawn.append((lang, *(window[: window.index(b".")] if b"." in window else window)))
                    at += stride
                at -= len(text)
            if drawn:
                yield pa.RecordBatch.from_arrays([pa.array(drawn, pa.list_(pa.binary()))], ["prefix"])

    # At most SAMPLES * MOST_RANGES windows of a few words, and one a task.
    drawn = sorted((tuple(map(bytes, r[0])) + (b"",) * SPAN)[: SPAN + 1] for r in texts.mapInArrow(run, "prefix array<binary>").toLocalIterator())
    return sorted(set(drawn[SAMPLES::SAMPLES]))


_PIECE = "part long, salt long, piece binary"
_SUMMED = "part long, kind string, lang binary, weight long, asker long, piece binary"
_SUMMED_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]


def _summed(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(_SUMMED_TYPES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _SUMMED_TYPES, strict=True)], [c.split()[0] for c in _SUMMED.split(", ")])


def _pieces(table: pa.Table, kind: str | None = None) -> list[Transducer]:
    if kind is not None:
        table = table.filter(pa.array([k == kind for k in table.column("kind").to_pylist()], pa.bool_()))
    return [Transducer.unpacked(b) for b in table.column("piece").to_pylist()]


def _owner(bounds: list[Prefix], prefix: Prefix) -> int:
    return bisect_right(bounds, prefix)


def _counted(table: pa.Table, bounds: list[Prefix], least: int) -> pa.Table:
    """All pieces of a range -> its phrases that may be frequent; shares of phrases that begin in another range; words by lang."""
    part = table.column("part")[0].as_py()
    whole = Transducer.union(_pieces(table))
    total = np.bincount(whole.columns[0], whole.weight, minlength=len(whole.langs))
    rows = [(part, "words", whole.langs[k], int(total[k]), None, None) for k in np.flatnonzero(total).tolist()]
    phrases, first = whole.phrases(least)
    elsewhere = np.zeros(len(phrases), bool)
    for k in np.flatnonzero(first).tolist():
        owner = _owner(bounds, phrases.prefix(k))
        if owner != part:
            elsewhere[k] = True
            rows.append((owner, "share", None, None, None, phrases.taken(slice(k, k + 1)).packed()))
    rows.append((part, "share", None, None, None, phrases.taken(np.flatnonzero(~elsewhere)).packed()))
    return _summed(rows)


def _parts(counts: Transducer) -> Transducer:
    """Acceptor of the first parts and the rests of all phrases of several words."""
    columns: list[list[np.ndarray]] = [[] for _ in counts.columns]
    size = sum((c > 0).astype(np.int64) for c in counts.columns[1:])
    for cut in range(1, SPAN):
        longer = size > cut
        lang, words = counts.columns[0][longer], [c[longer] for c in counts.columns[1:]]
        nothing = np.zeros(len(lang), np.int32)
        for part in (words[:cut], words[cut:]):
            for k, c in enumerate([lang, *part, *[nothing] * (SPAN - len(part))]):
                columns[k].append(c)
    joined = [np.concatenate(c).astype(np.int32) for c in columns]
    return Transducer.summed(counts.langs, counts.words, joined, np.ones(len(joined[0]), np.int64))


def _asked(table: pa.Table, bounds: list[Prefix], least: int) -> pa.Table:
    """Shares of a range's phrases -> their counts, and the parts of its candidates for the ranges that hold them."""
    part = table.column("part")[0].as_py()
    whole = Transducer.union(_pieces(table))
    counts = whole.taken(np.flatnonzero(whole.weight >= least))
    rows = [(part, "counts", None, None, None, counts.packed())] if len(counts) else []
    rows += [(owner, "parts", None, None, part, piece.packed()) for owner, piece in _parts(counts).pieces(bounds)]
    return _summed(rows)


def _answered(table: pa.Table) -> pa.Table:
    """Counts of a range and parts that others ask for -> their weights, to the askers; the counts once more."""
    counts = _pieces(table, "counts")
    rows = [(table.column("part")[0].as_py(), "counts", None, None, None, c.packed()) for c in counts]
    part = table.column("part")[0].as_py()
    for kind, asker, piece in zip(*(table.column(c).to_pylist() for c in ("kind", "asker", "piece")), strict=True):
        if kind == "parts":
            asked = Transducer.unpacked(piece)
            weights = counts[0].composed(asked) if counts else np.zeros(len(asked), np.int64)
            rows.append((asker, "answer", None, len(weights), part, _packed(weights)))
    return _summed(rows)


_CANDIDATE = "lang string, phrase string, words int, a long, l long, r long, score long"


def _scored(table: pa.Table) -> pa.Table:
    """Counts of a range and the weights of their parts -> its candidates with their lowest-scoring cut."""
    kinds, askers, sizes, pieces = (table.column(c).to_pylist() for c in ("kind", "asker", "weight", "piece"))
    counts = Transducer.unpacked(pieces[kinds.index("counts")])
    answers = sorted((a, n, p) for k, a, n, p in zip(kinds, askers, sizes, pieces, strict=True) if k == "answer")
    parts = _parts(counts)
    known = np.concatenate([_unpacked(p, n, np.int64) for _, n, p in answers]) if answers else np.zeros(0, np.int64)
    parts = Transducer(parts.langs, parts.words, parts.columns, known)
    size = sum((c > 0).astype(np.int64) for c in counts.columns[1:])
    rows = np.flatnonzero(size > 1)
    best: list[np.ndarray] | None = None
    a = counts.weight[rows]
    exact = np.int64 if int(a.max(initial=0)) < 1 << 40 else object
    for cut in range(1, SPAN):
        words = [c[rows] for c in counts.columns[1:]]
        nothing = np.zeros(len(rows), np.int32)
        ask = lambda part: parts.composed(Transducer(counts.langs, counts.words, [counts.columns[0][rows], *part, *[nothing] * (SPAN - len(part))], a))
        first, rest = ask(words[:cut]), ask(words[cut:])
        there = size[rows] > cut
        total = np.where(there, first + rest, 1)
        score = (np.where(there, a, 0).astype(exact) * SCORE // total.astype(exact)).astype(np.int64)
        if best is None:
            best = [first, rest, score]
        else:
            lower = there & (score < best[2])
            best = [np.where(lower, new, old) for new, old in zip((first, rest, score), best, strict=True)]
    word = np.array([b"", *counts.words], object)
    phrase = [b" ".join([w for w in row if w]).decode() for row in zip(*(word[c[rows]].tolist() for c in counts.columns[1:]), strict=True)]
    lang = [counts.langs[k].decode() for k in counts.columns[0][rows].tolist()]
    return pa.table([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(size[rows], pa.int32()), pa.array(a), *(pa.array(x, pa.int64()) for x in best)],
                    [c.split()[0] for c in _CANDIDATE.split(", ")])


def _rounds(ranges: int, fan: int) -> tuple[int, int]:
    """How many rounds of unions lead to `ranges` ranges, and the shards and ranges that meet in each of them.

    Alike in all rounds: `step` shards meet in one of `step` ranges, so a group holds about as much as one shard. With
    `fan` of them in every round the first one's ranges would be few, and each of its groups the work of many shards.
    """
    rounds = 1
    while fan**rounds < ranges:
        rounds += 1
    step = 1
    while step**rounds < ranges:
        step += 1
    return rounds, step


def _merged(texts: DataFrame, bounds: list[Prefix], shard_bytes: int, fan: int) -> DataFrame:
    """Every range's pieces of all shards; groups of unions on the way hold about one shard's worth."""
    rounds, fan = _rounds(len(bounds) + 1, fan)

    def wide(n: int) -> tuple[list[Prefix], int]:
        """Bounds of the ranges of round n and how many last ranges each holds."""
        step = fan ** (rounds - 1 - n)
        return bounds[step - 1 :: step], step

    def cut(whole: Transducer, salt: int, n: int) -> pa.RecordBatch:
        rows = [(k, salt // fan if n < rounds - 1 else 0, p.packed()) for k, p in whole.pieces(wide(n)[0])]
        columns = zip(*rows, strict=True) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.binary()], strict=True)], ["part", "salt", "piece"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        # Shards of one place in their tasks are neighbours, whatever the number of shards of a task.
        for k, shard in enumerate(shards(batches, shard_bytes)):
            yield cut(shard, k * MOST_TASKS + task, 0)

    def again(n: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([cut(Transducer.union(_pieces(table)), table.column("salt")[0].as_py(), n)])

        return run

    pieces = texts.mapInArrow(first, _PIECE)
    for n in range(1, rounds):
        pieces = pieces.groupBy("part", "salt").applyInArrow(again(n), _PIECE)
    return pieces


def candidates(docs: DataFrame, least: int = MIN_COUNT, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(lang, text) -> all candidates (lang, phrase, words, a, l, r, score), and the words of each lang (lang, n)."""
    texts = _texts(docs)
    bounds = _bounds(texts, range_bytes)

    def step(rows: DataFrame, method: Callable[[pa.Table], pa.Table], schema: str = _SUMMED) -> DataFrame:
        return rows.groupBy("part").applyInArrow(method, schema)

    first = cut_lineage(step(_merged(texts, bounds, shard_bytes, fan), lambda t: _counted(t, bounds, least)))
    asked = step(first.where("kind = 'share'"), lambda t: _asked(t, bounds, least))
    scored = step(step(asked, _answered), _scored, _CANDIDATE)
    words = first.where("kind = 'words'").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.sum("weight").alias("n"))
    return scored, words


def _shadows(found: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the greatest count of a longer candidate that holds a phrase."""
    words = F.split("phrase", " ")
    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
            F.sequence(F.lit(1), F.col("words") - n + 1), lambda k: F.array_join(F.slice(words, k, n), " ")))),
        lambda x: x.isNotNull())
    return found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, most: int = MOST, **settings) -> DataFrame:
    """(lang, text) -> (lang, rank, phrase, a, l, r, n, score): the first `most` collocations of each lang."""
    found, words = candidates(docs, **settings)
    found = cut_lineage(found)
    exact = lambda column, factor: F.col(column).cast("decimal(19,0)") * F.lit(factor).cast("decimal(19,0)")
    kept = found.join(_shadows(found), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (exact("longer", 100) < exact("a", SHADOW_PERCENT)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
