import hashlib
import random

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA, frame, odd_rows, words
from tidemark.llm import substring


def plain(rows):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - 12):
            if doc is not None:
                key = tuple(w[i : i + 13])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = {i + k for i in range(len(w) - 12) if doc is not None and first[tuple(w[i : i + 13])] < doc for k in range(13)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(map(repr, out))


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "漢"]
    line = [rng.choice(vocabulary) for _ in range(rng.choice([6, 13, 30]))]
    rows = []
    for k in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            at = rng.randrange(len(w) + 1)
            w[at:at] = line * rng.choice([1, 1, 3])
        if rows and rng.random() < 0.2:
            w = words(rng.choice(rows)[1])
        rows.append((rng.randrange(n) if rng.random() < 0.1 else k, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(None, rows[3][1]), (7, rows[3][1]), (7, rows[3][1]), (900, None), (901, "")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_words_are_those_of_the_plain_version(spark, seed):
    rows = corpus(seed)
    out = substring.digests(substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(repr(tuple(r)) for r in out.collect()) == plain(rows)


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_rows()
    out = substring.digests(substring.deduplicate(frame(spark, rows)))
    assert sorted(repr(tuple(r)) for r in out.collect()) == plain([r[:2] for r in rows])
    assert substring.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_overfull_buckets_deal_out_single_windows():
    texts = [t.encode() for _, t in corpus(3) if t]
    runs = substring._Runs(texts, 4, np.array([0, 2]))
    whole = substring._Runs(texts, 4, None)
    windows = lambda r: sorted(x for a, b in zip(r.first.tolist(), r.last.tolist(), strict=True) for x in range(a, b + 1))
    assert windows(runs) == windows(whole) and (runs.last == runs.first).sum() > (whole.last == whole.first).sum()
    # Equal windows share a bucket, split or not.
    bucket = {}
    for a, b, k in zip(runs.first.tolist(), runs.last.tolist(), runs.bucket.tolist(), strict=True):
        for x in range(a, b + 1):
            key = runs.words.data[runs.words.start[x] : runs.words.end[x + 12]]
            assert bucket.setdefault(key, k) == k


def test_equal_hashes_of_other_windows_are_told_apart(monkeypatch):
    strings = [b" ".join(b"a%d" % (k % 5 + j) for j in range(15)) for k in range(9)]
    docs = np.arange(9)
    want = [x.tolist() for x in substring._removed_here(b"\n".join(strings), docs)]
    monkeypatch.setattr(substring, "_word_hashes", lambda codes, a, b: np.zeros(len(a), np.uint64))
    assert [x.tolist() for x in substring._removed_here(b"\n".join(strings), docs)] == want


def test_copies_of_one_row_are_decided_once(spark):
    line = " ".join(f"w{k}" for k in range(30))
    rows = [(5, line)] * 5000 + [(3, "x " + line)] + [(9, line + " y")] * 3
    out = substring.digests(substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    assert sorted(repr(tuple(r)) for r in out.collect()) == plain(rows)


def test_a_hot_passage_in_falling_order_travels_once_a_slice(spark):
    line = " ".join(f"w{k}" for k in range(20))
    rows = [(k, f"a{k} {line} b{k}") for k in range(3000, 0, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    named = docs.withColumn("sig", substring.F.xxhash64("text"))
    sent = substring._send(named, 4, np.zeros(0, np.int64))
    # Windows that begin in the middle of the passage are the same in all rows.
    assert sent.where("size > 0").agg(substring.F.sum("rows")).first()[0] < 2 * len(rows) + 50
    out = substring.digests(substring.deduplicate(docs))
    assert sorted(repr(tuple(r)) for r in out.collect()) == plain(rows)


def test_buckets_sort_their_windows_in_parts(monkeypatch):
    texts = [t.encode() for _, t in corpus(4) if len(words(t)) > 12]
    strings, docs = b"\n".join(b" ".join(t.split()) for t in texts), np.arange(len(texts))[::-1].copy()
    want = [x.tolist() for x in substring._removed_here(strings, docs)]
    monkeypatch.setattr(substring, "SORTED", 50)
    monkeypatch.setattr(substring, "_HASHED", 40)
    assert [x.tolist() for x in substring._removed_here(strings, docs)] == want and want[0]
