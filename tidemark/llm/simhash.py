"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r bits of each. Every
distinct fingerprint therefore emits all its variants within r = 2 bits; equal variants meet, and
each pair that meets is verified. Variants that share their leading bits travel as one packed word,
the fingerprint itself: it is sent to every bucket (a value of the leading bits) that one of its
variants falls into, and the bucket writes them out, sorts them, and keeps a spanning forest of the
verified links. So no link is lost, none is written once per pair of a group, and the shuffle holds
a few dozen words a fingerprint instead of its 2,081 variants.

Exact copies are one fingerprint before any of this. A bucket splits itself by further bits until
the variants it holds at once are bounded.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a null
doc_id is never the least of its component, and a component of null ids only has a null id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import Words, cut_lineage, slices, utf8
from tidemark.llm.components import components, forest

SHINGLE = 4
SEED = 42
DISTANCE = 4
RADIUS = DISTANCE // 2
BITS = 64
#: Variants that a bucket writes out at once, and that buckets hold on average.
VARIANTS_AT_ONCE = 2_000_000
VARIANTS_A_BUCKET = 1_000_000


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """64-bit SimHash of each text over its shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = Words([t.lower() for t in texts])
    begin = np.flatnonzero(words.has_window(SHINGLE))
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    start = np.concatenate([words.start[begin], words.start[words.first[short]]])
    end = np.concatenate([words.end[begin + SHINGLE - 1], words.end[words.first[short] + words.count[short] - 1]])
    text = np.concatenate([words.text[begin], short])
    order = np.argsort(text, kind="stable")
    start, end, text = start[order], end[order], text[order]
    data = words.data
    out = np.zeros(len(texts), np.uint64)
    if not len(text):
        return out
    hashed = np.fromiter((xxh64_intdigest(data[a:b], SEED) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(text))
    owner, first, count = np.unique(text, return_index=True, return_counts=True)
    for k, at, n in zip(owner.tolist(), first.tolist(), count.tolist(), strict=True):
        bits = np.unpackbits(hashed[at : at + n].view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        ones = bits.sum(0, dtype=np.int32)
        out[k] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, text, carried long columns) -> (doc_id, carried, fp long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = pa.array(fingerprints_of(utf8(part.column("text"))).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[part.column(c) for c in carried], fp], ["doc_id", *carried, "fp"])

    schema = ", ".join(f"{c} long" for c in ("doc_id", *carried, "fp"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _flips(bits: int, most: int) -> np.ndarray:
    """All words of `bits` bits with at most `most` (up to 2) ones."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = [np.zeros(1, np.uint64)]
    if most >= 1:
        out.append(one)
    if most >= 2:
        i, j = np.triu_indices(bits, 1)
        out.append(one[i] | one[j])
    return np.concatenate(out)


def _variants(fp: np.ndarray, left: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of the variants of each fingerprint with at most left[i] flips there, and whose they are."""
    mask = np.uint64((1 << low) - 1) if low < 64 else np.uint64(2**64 - 1)
    values, owners = [], []
    for k in range(RADIUS + 1):
        own = np.flatnonzero(left == k)
        flips = _flips(low, k)
        values.append(((fp[own] & mask)[:, None] ^ flips).ravel())
        owners.append(np.repeat(own, len(flips)))
    return np.concatenate(values), np.concatenate(owners)


def _meetings(fp: np.ndarray, left: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Neighbours among the fingerprints that meet in a variant, in parts of bounded size."""
    if len(fp) < 2:
        return
    size = sum(math.comb(low, i) * int((left >= i).sum()) for i in range(RADIUS + 1))
    if size > VARIANTS_AT_ONCE and low > 0:
        bit = (fp >> np.uint64(low - 1)) & np.uint64(1)
        for side in (0, 1):
            rest = left - (bit != side)
            own = np.flatnonzero(rest >= 0)
            for a, b in _meetings(fp[own], rest[own], low - 1):
                yield own[a], own[b]
        return
    value, owner = _variants(fp, left, low)
    ordered = np.sort(value)
    met = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(met):
        return
    at = np.minimum(np.searchsorted(met, value), len(met) - 1)
    shared = np.flatnonzero(met[at] == value)
    order = shared[np.argsort(value[shared], kind="stable")]
    value, owner = value[order], owner[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    pairs = np.unique(owner[same].astype(np.int64) * len(fp) + owner[same + 1])
    yield pairs // len(fp), pairs % len(fp)


def _bucket_links(fp: np.ndarray, bucket: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as stars, of the fingerprints that meet in this bucket."""
    fp = np.unique(fp)
    left = RADIUS - np.bitwise_count((fp >> np.uint64(BITS - prefix)) ^ np.uint64(bucket)).astype(np.int64)
    a, b = (np.concatenate(x) for x in zip(*_meetings(fp, left, BITS - prefix), (np.zeros(0, np.int64),) * 2, strict=True))
    near = np.bitwise_count(fp[a] ^ fp[b]) <= DISTANCE
    label = forest(len(fp), a[near], b[near])
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def links(distinct: DataFrame, count: int) -> DataFrame:
    """(fp) distinct -> (u, v): links whose components are those of all pairs within DISTANCE bits."""
    balls = count * len(_flips(BITS, RADIUS))
    prefix = min(24, max(6, math.ceil(math.log2(max(1, balls / VARIANTS_A_BUCKET)))))
    masks = _flips(prefix, RADIUS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            bucket = ((fp >> np.uint64(BITS - prefix))[:, None] ^ masks).ravel()
            packed = np.repeat(fp, len(masks))
            order = np.argsort(bucket, kind="stable")
            bucket, packed = bucket[order], packed[order]
            name, first = np.unique(bucket, return_index=True)
            cut = np.append(first, len(bucket)) * 8
            data = packed.tobytes()
            rows = [data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "packed"])

    def meet(table: pa.Table) -> pa.Table:
        fp = np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint64)
        u, v = _bucket_links(fp, table.column("bucket")[0].as_py(), prefix)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return distinct.mapInArrow(send, "bucket int, packed binary").groupBy("bucket").applyInArrow(meet, "u long, v long")


def roots(marked: DataFrame) -> DataFrame:
    """(fp, ...) -> (fp, root): the least fingerprint that each distinct fingerprint reaches."""
    distinct = marked.select("fp").distinct()
    count = distinct.count()
    found = components(links(distinct, count)).select(F.col("node").alias("fp"), "root")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def cluster(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint, component_id), a row for each row of `docs`."""
    marked = cut_lineage(fingerprints(docs))
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    rooted = cut_lineage(first.join(roots(marked), "fp"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the least doc_id (null ids last).

    Rows that are equal in every column count as one. Rows are named by doc_id and a hash of their
    columns, so the text is shuffled once, to meet the names of the rows that stay.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"),
                        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType)]).alias("sig"))
    marked = cut_lineage(fingerprints(named, "sig"))
    rooted = marked.join(roots(marked), "fp")
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("best"))
    stay = best.select("best.none", F.coalesce("best.doc_id", F.lit(0)).alias("id"), "best.sig")
    rows = named.select("row", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "sig")
    joined = rows.join(stay, ["none", "id", "sig"], "left_semi")
    twin = F.row_number().over(Window.partitionBy("none", "id", "sig").orderBy("sig"))
    return joined.withColumn("twin", twin).where("twin = 1").select("row.*")
