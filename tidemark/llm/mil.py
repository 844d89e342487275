"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Every passage of every whole text is encoded: measured
shares of character classes and word shapes, and signed hashed counts of its words. A gated
attention (tanh times sigmoid) learns from document labels alone which passages matter; the score
is a logistic unit on the attention-weighted mean of the encoded passages.

Training uses at most TRAIN_DOCS labelled documents, those whose ids come first in hash order, so
the choice does not depend on how rows lie; all other documents are only scored. Rows that are held
out (crc32 of the id as text, modulo 3, is 1) are never trained on. Inputs of the score are made
from the text alone.

Defined results: null and empty texts are one empty passage; a null doc_id is not held out and not
trained on; documents with conflicting labels, null labels or labels other than 0 and 1 are not
trained on; without labels of both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, slices, utf8

PASSAGE = 64
#: Labelled documents that training reads at most.
TRAIN_DOCS = 3000
#: Passages of one document that are learned from.
TRAIN_PASSAGES = 64
HASHED = 96
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.01, 1e-4
FOLDS, HELD_OUT = 3, 1

_CLASSES = [b"#*$%&<>", b"|", b"!", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"()[]{}\"'"]
_SHAPES = len(_CLASSES) + 7
FEATURES = _SHAPES + HASHED
_CLASS_OF = np.zeros((len(_CLASSES) + 1, 256), np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _CLASS_OF[_k, list(_chars)] = 1
_CLASS_OF[-1, 128:] = 1


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, index of its text), passages in text order, at least one a text."""
    words = Words(texts)
    per_text = np.maximum(1, -(-words.count // PASSAGE))
    first = np.cumsum(per_text) - per_text
    owner = np.repeat(np.arange(len(texts)), per_text)
    passage = first[words.text] + words.place // PASSAGE
    n = len(owner)
    out = np.zeros((n, FEATURES), np.float32)
    count = np.bincount(passage, minlength=n)
    size = words.end - words.start
    chars = np.bincount(passage, size, n)
    filled = np.maximum(count, 1)
    # Character classes by running sums over the joined words.
    bounds = np.flatnonzero(np.diff(passage, prepend=-1))
    if len(bounds):
        lo, hi = words.start[bounds], words.end[np.append(bounds[1:], len(passage)) - 1]
        for k in range(len(_CLASSES) + 1):
            run = np.append(0, np.cumsum(_CLASS_OF[k][words.codes], dtype=np.int64))
            out[passage[bounds], k] = (run[hi] - run[lo]) / np.maximum(chars[passage[bounds]], 1)
    k = len(_CLASSES) + 1
    out[:, k] = chars / filled / 10
    out[:, k + 1] = count / PASSAGE
    out[:, k + 2] = np.bincount(passage, size == 1, n) / filled
    out[:, k + 3] = np.bincount(passage, size > 12, n) / filled
    hashes = words.hashes()
    if len(passage):
        # Words that repeat the one before, and distinct words.
        again = np.append(False, (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1]))
        out[:, k + 4] = np.bincount(passage, again, n) / filled
        pair = np.sort((passage.astype(np.uint64) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF)))
        fresh = pair[np.append(True, pair[1:] != pair[:-1])]
        out[:, k + 5] = np.bincount((fresh >> np.uint64(32)).astype(np.int64), minlength=n) / filled
        cell = passage * HASHED + ((hashes >> np.uint64(8)) % np.uint64(HASHED)).astype(np.int64)
        sign = 1.0 - 2.0 * ((hashes >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
        out[:, _SHAPES:] = np.bincount(cell, sign, n * HASHED).reshape(n, HASHED) / np.sqrt(filled)[:, None]
    return out, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights; `shift` and `scale` standardise the features."""

    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, features: np.ndarray, owner: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        w = self.weights
        x = (features - self.shift) * self.scale
        h = np.tanh(x @ w["w"] + w["b"])
        t, s = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
        energy = (t * s) @ w["a"]
        begin = np.searchsorted(owner, np.arange(bags))
        weight = np.exp(energy - np.maximum.reduceat(energy, begin)[owner])
        weight /= np.add.reduceat(weight, begin)[owner]
        z = np.add.reduceat(weight[:, None] * h, begin)
        return {"x": x, "h": h, "t": t, "s": s, "weight": weight, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def gradients(self, f: dict[str, np.ndarray], owner: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        w, h, t, s, weight = self.weights, f["h"], f["t"], f["s"], f["weight"]
        error = (f["p"] - label) / len(label)
        dz = (error[:, None] * w["c"])[owner]
        pull = (dz * h).sum(1)
        begin = np.searchsorted(owner, np.arange(len(label)))
        de = weight * (pull - np.add.reduceat(weight * pull, begin)[owner])
        dts = de[:, None] * w["a"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = weight[:, None] * dz + dt @ w["v"].T + ds @ w["u"].T
        dx = dh * (1 - h * h)
        return {"w": f["x"].T @ dx, "b": dx.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de,
                "c": f["z"].T @ error, "d": np.array([error.sum()])}

    def score(self, texts: list[bytes]) -> np.ndarray:
        features, owner = encode(texts)
        return self.forward(features, owner, len(texts))["p"]


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Model:
    """Gated attention and classifier by Adam on the mean log loss of the bags."""
    rng = np.random.default_rng(seed)
    rows = np.concatenate(bags)
    weights = {
        "w": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
        "v": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)), "u": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
        "a": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
    }
    model = Model(rows.mean(0), 1 / (rows.std(0) + 1e-3), weights)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            owner = np.repeat(np.arange(len(part)), [len(bags[k]) for k in part])
            state = model.forward(np.concatenate([bags[k] for k in part]), owner, len(part))
            step += 1
            for name, g in model.gradients(state, owner, labels[part]).items():
                g = g + DECAY * weights[name]
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                weights[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_bags(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, passages: int = TRAIN_PASSAGES) -> tuple[list[np.ndarray], np.ndarray]:
    """Encoded passages and label of at most `most` labelled documents that are not held out, one bag each.

    Of texts that share a doc_id the one with the least hash is learned from, and of a text with more than `passages`
    passages so many at equal distances: what reaches the driver is bounded. Scores are of all passages.
    """
    clear = (labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other"))
    chosen = clear.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "label")
    # At most `most` ids and labels: their size is bounded, so they go to the texts.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            features, owner = encode(utf8(part.column("text")))
            begin = np.searchsorted(owner, np.arange(part.num_rows + 1))
            packed = []
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                at = np.arange(a, b) if b - a <= passages else np.linspace(a, b - 1, passages).astype(np.int64)
                packed.append(features[at].tobytes())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "label", "named")), pa.array(packed, pa.binary())], ["doc_id", "label", "named", "bag"])

    named = texts.select("doc_id", "label", F.xxhash64("text").alias("named"), "text")
    found = named.mapInArrow(bags, f"doc_id long, label {chosen.schema['label'].dataType.simpleString()}, named long, bag binary")
    # Combined where they lie: one bag a document leaves each task.
    rows = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("bag", F.struct("named", "bag")).alias("bag")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in rows], np.array([r.label for r in rows], np.float64)


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, text), (doc_id, quality) -> (doc_id, held_out, score, predicted) of every whole text."""
    bags, y = training_bags(docs, labels, most)
    model = fit(bags, y) if len(set(y.tolist())) == 2 else float(y.mean()) if len(y) else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            p = np.full(part.num_rows, model) if isinstance(model, float) else model.score(utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p.round(6))], ["doc_id", "held_out", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
