"""Stupid-backoff scores of whole texts against n-gram counts of the whole corpus.

Counts are held out: a text is scored against all other texts, so its own n-grams do not vouch for
it and copies do. S(w | context) is count(context w) / count(context) where the n-gram occurs
elsewhere, else BACKOFF times the score with a context shorter by one word; a word that occurs
nowhere else scores 1 / (N + 1), N the words elsewhere.

The work is relational, with rows packed: texts are dealt into blocks of bounded size, equal rows too; each block
explodes its n-grams, combines equal ones and sends hash and count to the partition of the count
table that owns the hash. Each partition sums its counts and joins the totals back to the blocks
that asked; a block then meets its totals and sums the scores by document. A word that is in every
text is one row per block in its partition, however often it occurs. Hashes have 64 bits.

Words and pairs are asked for together. A longer n-gram can occur in another text only if the two
n-grams one word shorter that it holds do: every text that shares it asks for it, one that shares
neither part need not, and its count elsewhere is 0 without asking. So each further order is a round
of its own that asks for those n-grams alone. Texts travel compressed one by one.

Defined results: null and empty texts have no words, score 0 and no mean; rows that repeat a
doc_id are texts of their own; a single text is scored as if all its words were unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, grams, mixed, utf8

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 2 << 20
#: Bytes of text for each hash partition of the count table: some blocks' worth, so that what a block sends to one is not a few bytes.
PART_BYTES = 8 << 20
LEAST_BLOCKS = 16
#: Rows that repeat each other are dealt over so many blocks.
SPREAD = 997
#: n-grams up to this order are asked for in one round.
TOGETHER = 2
#: The empty n-gram; its count is the number of words.
_ALL = np.uint64(0x5851F42D4C957F2D)
_CODEC = "zstd"


class _Block:
    """n-grams of the texts of a block: for order n and word i the one that ends there, if it has n words."""

    def __init__(self, texts: list[bytes], order: int):
        self.words = words = Words(texts)
        hashes = words.hashes()
        self.of_order: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, order + 1):
            gram = grams(hashes, n) if n > 1 else mixed(hashes)
            ends = np.flatnonzero(words.place >= n - 1)
            self.of_order.append((ends, mixed(gram[ends - (n - 1)] + np.uint64(n))))
        self.elsewhere: list[np.ndarray] = []

    def first_asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of the first round, and their counts in the block."""
        asked, counts = np.unique(np.concatenate([g for _, g in self.of_order[:TOGETHER]]), return_counts=True)
        if _ALL not in asked:
            at = int(np.searchsorted(asked, _ALL))
            asked, counts = np.insert(asked, at, _ALL), np.insert(counts, at, len(self.words.place))
        return asked, counts

    def _shared(self, n: int) -> np.ndarray:
        """Which n-grams of a later round hold two shorter ones that both occur elsewhere."""
        ends, shorter = self.of_order[n - 1][0], self.elsewhere[n - 2]
        return (shorter[ends] > 0) & (shorter[ends - 1] > 0)

    def asked(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of the round of order n, when the counts elsewhere of shorter n-grams are there."""
        return np.unique(self.of_order[n - 1][1][self._shared(n)], return_counts=True)

    def _others(self, asked: np.ndarray, totals: np.ndarray, n: int, which: np.ndarray | slice) -> None:
        """For every word the count, in all other texts, of the n-gram that ends there; -1 where there is none."""
        ends, gram = self.of_order[n - 1]
        out = np.full(len(self.words.place), -1, np.int64)
        out[ends] = 0
        ends, at = ends[which], np.searchsorted(asked, gram[which])
        _, back, own = np.unique(self.words.text[ends] * len(asked) + at, return_inverse=True, return_counts=True)
        out[ends] = totals[at] - own[back]
        self.elsewhere.append(out)

    def meet(self, answers: pa.Table) -> np.ndarray:
        """Takes the totals of every round that has ended into `elsewhere`; the words in other texts, by text."""
        rows = sorted(zip(*[answers.column(c).to_pylist() for c in ("round", "part", "size", "totals")], strict=True))
        of_round: dict[int, list[np.ndarray]] = {}
        for k, _, size, totals in rows:
            of_round.setdefault(k, []).append(_unpack(totals, size).astype(np.int64))
        asked, totals = self.first_asked()[0], np.concatenate(of_round[TOGETHER])
        for n in range(1, min(TOGETHER, len(self.of_order)) + 1):
            self._others(asked, totals, n, slice(None))
        rest = totals[np.searchsorted(asked, _ALL)] - self.words.count
        for n in range(TOGETHER + 1, answers.column("last")[0].as_py() + 1):
            self._others(self.asked(n)[0], np.concatenate(of_round.get(n, [np.zeros(0, np.int64)])), n, self._shared(n))
        return rest


def _pack(values: np.ndarray) -> bytes:
    """Compressed byte planes of 64-bit values."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec=_CODEC, asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec=_CODEC, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch.column("text"))
        packed = pa.array([pa.compress(t, codec=_CODEC, asbytes=True) if t else b"" for t in texts], pa.binary())
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("block"), sizes, packed], ["doc_id", "block", "bytes", "packed"])


def _in_order(texts: pa.Table) -> list[bytes]:
    rows = zip(texts.column("bytes").to_pylist(), texts.column("packed").to_pylist(), strict=True)
    return [pa.decompress(t, decompressed_size=n, codec=_CODEC, asbytes=True) if n else b"" for n, t in rows]


_ASKED = "part int, block long, size int, steps binary, counts binary"
_ANSWERED = "block long, part int, size int, totals binary"


def _sent(block: int, asked: np.ndarray, counts: np.ndarray, bits: int) -> pa.Table:
    owner = (asked >> np.uint64(64 - bits)).astype(np.int64)
    name, first = np.unique(owner, return_index=True)
    rows = []
    for k, (a, b) in zip(name.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(owner)], strict=True) if len(name) else [], strict=True):
        step = np.diff(asked[a:b], prepend=np.uint64(k << (64 - bits)))
        rows.append((k, block, b - a, _pack(step), _pack(counts[a:b])))
    part, asker, size, steps, counts = zip(*rows, strict=True) if rows else [()] * 5
    return pa.table([pa.array(part, pa.int32()), pa.array(asker, pa.int64()), pa.array(size, pa.int32()), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())],
                    ["part", "block", "size", "steps", "counts"])


def _ask(order: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        return _sent(table.column("block")[0].as_py(), *_Block(_in_order(table), order).first_asked(), bits)

    return run


def _ask_longer(n: int, bits: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(_in_order(docs), n)
        block.meet(answers)
        return _sent(docs.column("block")[0].as_py(), *block.asked(n), bits)

    return run


def _sum(bits: int):
    def run(table: pa.Table) -> pa.Table:
        base = np.uint64(table.column("part")[0].as_py() << (64 - bits))
        size = table.column("size").to_pylist()
        asked = [base + np.cumsum(_unpack(s, n)) for s, n in zip(table.column("steps").to_pylist(), size, strict=True)]
        counts = np.concatenate([_unpack(c, n) for c, n in zip(table.column("counts").to_pylist(), size, strict=True)])
        gram, back = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.zeros(len(gram), np.int64)
        np.add.at(total, back, counts.astype(np.int64))
        ends = np.cumsum(size)
        answers = [_pack(total[back[b - n : b]]) for n, b in zip(size, ends.tolist(), strict=True)]
        return pa.table([table.column("block"), table.column("part"), table.column("size"), pa.array(answers)], ["block", "part", "size", "totals"])

    return run


def _score(order: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(_in_order(docs), order)
        elsewhere = block.meet(answers)
        words = block.words
        rest = elsewhere[words.text]
        score = np.zeros(len(words.place))
        open_, steps = np.ones(len(words.place), bool), np.zeros(len(words.place))
        for n in range(order, 0, -1):
            count = block.elsewhere[n - 1]
            if n > 1:
                context = np.append(0, block.elsewhere[n - 2][:-1])
            else:
                context = rest
            hit = open_ & (count > 0)
            score[hit] = steps[hit] * np.log(BACKOFF) + np.log(count[hit] / context[hit])
            open_ &= ~hit
            if n > 1:
                steps[open_ & (count == 0)] += 1
        score[open_] = steps[open_] * np.log(BACKOFF) - np.log(rest[open_] + 1)
        total = np.bincount(words.text, score, len(words.count)).astype(np.float64)
        backed = np.bincount(words.text, steps, len(words.count)).astype(np.int64)
        unseen = np.bincount(words.text, open_, len(words.count)).astype(np.int64)
        mean = [round(s / n, 6) if n else None for s, n in zip(total.tolist(), words.count.tolist(), strict=True)]
        return pa.table([docs.column("doc_id"), pa.array(words.count), pa.array(unseen), pa.array(backed), pa.array(total.round(6)), pa.array(mean, pa.float64())],
                        ["doc_id", "n_words", "n_unseen", "n_backoffs", "log_score", "mean_log_score"])

    return run


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_words, n_unseen, n_backoffs, log_score, mean_log_score), natural logarithms."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, int(size // BLOCK_BYTES))
    bits = max(2, int(size // PART_BYTES).bit_length())
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", salt), F.lit(blocks))).mapInArrow(_packed, "doc_id long, block long, bytes long, packed binary")
    later = range(TOGETHER + 1, order + 1)
    # Answers of several rounds meet their texts where they lie: all are dealt by block alike, and only once.
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at_home = (lambda df: df.repartition(width, "block")) if later else (lambda df: df)
    dealt = at_home(dealt)

    def answered(asked: DataFrame, n: int) -> DataFrame:
        return at_home(asked.groupBy("part").applyInArrow(_sum(bits), _ANSWERED)).withColumn("round", F.lit(n))

    rounds = [answered(dealt.groupBy("block").applyInArrow(_ask(min(order, TOGETHER), bits), _ASKED), TOGETHER)]

    def met(last: int, method, schema: str) -> DataFrame:
        answers = reduce(DataFrame.union, rounds).withColumn("last", F.lit(last))
        return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(method, schema)

    for n in later:
        rounds.append(answered(met(n - 1, _ask_longer(n, bits), _ASKED), n))
    return met(order, _score(order), "doc_id long, n_words long, n_unseen long, n_backoffs long, log_score double, mean_log_score double")
