"""Byte-level BPE: encode whole texts to ids by a rank file, and decode ids to bytes.

The distinct pieces of a slice of texts are merged together: pieces of similar length form one
padded matrix of ids; every round each row merges its leftmost pair of least rank, the row closes
up by one column, and finished rows leave. Ranks of pairs come from an open-addressing hash table
over all pairs whose bytes together are a token. Merged pieces are remembered in a bounded table.

Defined results: null and empty texts give no ids and no bytes; repeated rows are encoded alike;
ids that no token has make decoding fail with an error.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

NO_RANK = np.int32(2**31 - 1)
#: Pieces of more bytes are merged one by one with a heap: a round of a matrix costs its width.
MATRIX_BYTES = 512
#: Bytes of text whose new pieces are merged together: fuller matrices cost less a piece.
PIECES_OF_BYTES = 2_000_000
#: Pieces remembered by a task; the table is emptied when it is full.
REMEMBERED = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) -> id of the merged token, by linear probing in numpy arrays."""

    _EMPTY = np.uint64(2**64 - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self._mask = np.uint64((1 << max(4, (4 * len(left)).bit_length())) - 1)
        self._keys = np.full(int(self._mask) + 1, self._EMPTY, np.uint64)
        self._values = np.full(int(self._mask) + 1, NO_RANK, np.int32)
        keys = self._key(left, right)
        slot = self._slot(keys)
        while len(keys):
            free = self._keys[slot] == self._EMPTY
            self._keys[slot[free]] = keys[free]
            placed = self._keys[slot] == keys
            self._values[slot[placed]] = merged[placed]
            keys, merged, slot = keys[~placed], merged[~placed], (slot[~placed] + np.uint64(1)) & self._mask

    @staticmethod
    def _key(left, right):
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) & self._mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NO_RANK for pairs that do not merge and for padding (negative ids)."""
        out = np.full(left.shape, NO_RANK, np.int32)
        open_ = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys = self._key(left.ravel()[open_], right.ravel()[open_])
        slot = self._slot(keys)
        flat = out.ravel()
        while len(open_):
            found = self._keys[slot]
            hit = found == keys
            flat[open_[hit]] = self._values[slot[hit]]
            on = ~hit & (found != self._EMPTY)
            open_, keys, slot = open_[on], keys[on], (slot[on] + np.uint64(1)) & self._mask
        return flat.reshape(left.shape)


def _without(matrix: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The matrix without one cell of every row."""
    stay = np.ones(matrix.shape, bool)
    stay[row, column] = False
    return matrix[stay].reshape(len(row), matrix.shape[1] - 1)


class Encoder:
    def __init__(self, rank_path: str, pattern: str):
        import regex

        self.ranks = read_ranks(rank_path)
        self.pieces = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (self.ranks[token[:cut]], self.ranks[token[cut:]], rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in self.ranks and token[cut:] in self.ranks
        ]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        self.table = PairTable(table[:, 0], table[:, 1], table[:, 2].astype(np.int32))
        #: Ids of a piece as packed int32.
        self._known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self._known) > REMEMBERED:
            self._known.clear()
        split = [self.pieces(t) for t in texts]
        found = [list(map(self._known.get, pieces)) for pieces in split]
        open_ = [k for k, ids in enumerate(found) if None in ids]
        self._learn({p for k in open_ for p, ids in zip(split[k], found[k], strict=True) if ids is None})
        for k in open_:
            found[k] = [self._known[p] if ids is None else ids for p, ids in zip(split[k], found[k], strict=True)]
        return [np.frombuffer(b"".join(ids), np.int32) for ids in found]

    def _learn(self, pieces: set[str]) -> None:
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self._known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > MATRIX_BYTES:
                self._known[piece] = np.array(self._merge_long(raw), np.int32).tobytes()
            else:
                by_width.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for group in by_width.values():
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                self._known.update(zip([p for p, _ in part], self.merge_rows([raw for _, raw in part]), strict=True))

    def merge_rows(self, rows: list[bytes]) -> list[bytes]:
        """Packed ids of each row; all rows merge once a round, so the matrix narrows by a column a round."""
        length = np.fromiter(map(len, rows), np.int64, len(rows))
        width = int(length.max())
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        ids = np.where(np.arange(width) < length[:, None], self.byte_ids[raw], np.int32(-1))
        ranks = self.table.ranks(ids[:, :-1], ids[:, 1:])
        out: list[bytes] = [b""] * len(rows)
        number = np.arange(len(rows))
        while len(number):
            row = np.arange(len(number))
            if ranks.shape[1]:
                at = ranks.argmin(1)
                best = ranks[row, at]
            else:
                at, best = np.zeros(len(number), np.int64), np.full(len(number), NO_RANK)
            done = best == NO_RANK
            if done.any():
                block, step = ids[done].tobytes(), 4 * ids.shape[1]
                for k, (n, size) in enumerate(zip(number[done].tolist(), (4 * length[done]).tolist(), strict=True)):
                    out[n] = block[k * step : k * step + size]
                ids, ranks, at, best, number, length = (x[~done] for x in (ids, ranks, at, best, number, length))
                row = row[: len(number)]
            if not len(number):
                break
            # Compaction: the right half of the merged pair and the pair's rank leave their rows.
            ids = _without(ids, row, at + 1)
            ids[row, at] = best
            ranks = _without(ranks, row, at)
            length = length - 1
            for pair in (at - 1, at):  # the two pairs that the merged id is part of
                has = (pair >= 0) & (pair < ranks.shape[1])
                r, p = row[has], pair[has]
                ranks[r, p] = self.table.ranks(ids[r, p], ids[r, p + 1])
        return out

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same merges for one long piece, in a linked list with a heap of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(raw, np.uint8)]
        ranks = self.table.ranks(ids[:-1], ids[1:])
        ids = ids.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current = {i: r for i, r in enumerate(ranks.tolist()) if r != NO_RANK}
        heap = [(r, i) for i, r in current.items()]
        heapq.heapify(heap)
        gone = bytearray(n)
        tokens = self._tokens()
        while heap:
            rank, i = heapq.heappop(heap)
            if gone[i] or current.get(i) != rank:
                continue
            j = after[i]
            ids[i], gone[j] = rank, 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            current.pop(j, None)
            for k in (before[i], i):
                if k >= 0:
                    right = after[k]
                    new = self.ranks.get(tokens[ids[k]] + tokens[ids[right]]) if right < n else None
                    if new is None:
                        current.pop(k, None)
                    else:
                        current[k] = new
                        heapq.heappush(heap, (new, k))
        return [ids[i] for i in range(n) if not gone[i]]

    @lru_cache(maxsize=1)  # noqa: B019 - one encoder per task process
    def _tokens(self) -> dict[int, bytes]:
        return {rank: token for token, rank in self.ranks.items()}


@lru_cache(maxsize=2)
def _encoder(rank_path: str, pattern: str) -> Encoder:
    return Encoder(rank_path, pattern)


@lru_cache(maxsize=2)
def _vocabulary(rank_path: str) -> pa.Array:
    """Bytes of every id; null where no token has the id."""
    ranks = read_ranks(rank_path)
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.binary())


def _joined(ids: pa.Array, vocabulary: pa.Array) -> pa.Array:
    """Bytes of the tokens of each list; an id that no token has is an error."""
    tokens = vocabulary.take(ids.flatten())
    if tokens.null_count:
        raise ValueError("an id that no token has")
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens), b"")


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids array<int>): whole texts, each match of `pattern` merged by itself.

    `rank_path` names a file of `base64 rank` lines that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(rank_path, pattern)
        for part in slices(batches, most=PIECES_OF_BYTES):
            ids = encoder.encode(part.column("text").fill_null("").to_pylist())
            ends = np.cumsum([0, *map(len, ids)])
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), values], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, decoded binary): the bytes of the tokens in order; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(rank_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column("ids")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, _joined(ids, vocabulary)], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame, *carried: str) -> DataFrame:
    """Counts and digests of what encode and decode gave."""
    return decoded.select(
        "doc_id", *carried,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
