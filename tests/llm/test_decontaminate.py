import random

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA, frame, odd_rows, tables
from tidemark.llm import decontaminate as d


def least_edits(segment, text):
    """Edits between the whole segment and its best place in the text, by the full table."""
    cost, at = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for letter in segment:
        new = np.empty_like(cost)
        new[0] = cost[0] + 1
        new[1:] = np.minimum(cost[:-1] + (text != letter), cost[1:] + 1)
        cost = np.minimum.accumulate(new - at) + at
    return int(cost.min())


def mutated(rng, text, rate):
    letters = list(text)
    for _ in range(int(len(letters) * rate)):
        k = rng.randrange(len(letters))
        kind = rng.random()
        if kind < 0.4:
            letters[k] = rng.choice("abcdefgh é")
        elif kind < 0.7:
            del letters[k]
        else:
            letters.insert(k, rng.choice("xyz "))
    return "".join(letters)


@pytest.mark.parametrize("seed", [1, 2])
def test_regions_are_those_of_the_full_table(seed):
    rng = random.Random(seed)
    documents, benchmark = tables("0.001", "documents", "benchmark")
    items = [(i, t.encode()) for i, t in benchmark[:10]]
    texts = []
    for _ in range(60):
        item = rng.choice(items)[1].decode()
        cut = mutated(rng, item, rng.choice([0, 0.03, 0.06, 0.08, 0.1, 0.14]))
        before, after = rng.choice(documents)[1][:200], rng.choice(documents)[1][:150]
        texts.append(f"{before}{rng.choice([' ', '', chr(10)])}{cut} {after}".encode())
    texts += [b"", b"a", b" ", b"\0\0"]
    segments = d.Segments(items)
    got = {(m[0], m[1]) for m in d._matches(segments, texts)}
    want = set()
    for k, text in enumerate(texts):
        code, _, _ = d.folded([text])
        want |= {(k, segments.item[s]) for s in range(len(segments.code)) if least_edits(segments.code[s], code) <= segments.budget[s]}
    assert got == want


def test_spans_are_code_points_and_folding_is_seen_through(spark):
    passage = "The quick brown fox jumps over the lazy dog while seven wizards brew a bitter potion near the old stone bridge."
    docs = [(1, f"é é {passage} end"), (2, passage.upper().replace(" ", "  ")), (3, "### ".join(passage.split())), (4, "nothing of the kind is here, at all, ever"),
            (5, f"{passage} middle {passage}")]
    benchmark = spark.createDataFrame([(7, passage), (8, None), (9, ""), (10, "short")], "item_id long, text string")
    out = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(1, 7), (2, 7), (3, 7), (5, 7), (5, 7)]
    first = next(r for r in out if r.doc_id == 1)
    assert docs[0][1][first.start : first.end].startswith("The quick") and first.edits == 0
    kept = d.clean(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert [r.doc_id for r in kept.collect()] == [4]


def test_blocks_give_what_one_pass_gives(spark, monkeypatch):
    documents, benchmark = tables("0.001", "documents", "benchmark")
    docs = spark.createDataFrame([r[:2] for r in documents], "doc_id long, text string")
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    whole = sorted(map(tuple, d.leaks(docs, items).collect()))
    monkeypatch.setattr(d, "BLOCK_CHARS", 2000)
    assert sorted(map(tuple, d.leaks(docs, items).collect())) == whole
    planted = {(r[0], i) for r in documents for i, t in benchmark if t in r[1]}
    assert planted and planted <= {(a, b) for a, b, *_ in whole}


def test_odd_rows(spark):
    benchmark = spark.createDataFrame([(1, "null id here " * 9)], "item_id long, text string")
    docs = frame(spark, odd_rows())
    assert {r.doc_id for r in d.leaks(docs, benchmark).collect()} == {None}
    assert d.clean(docs, benchmark).columns == docs.columns
    assert d.clean(docs, benchmark).count() == docs.count() - 1
    assert d.leaks(docs, benchmark.where("false")).count() == 0
    assert d.leaks(spark.createDataFrame([], SCHEMA), benchmark).count() == 0


def test_excerpts_of_the_stated_length_are_found_at_every_offset(spark):
    rng = random.Random(5)
    item = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(40))
    segments = d.Segments([(1, item.encode())])
    excerpts = [item[k : k + d.EXCERPT] for k in range(len(item) - d.EXCERPT + 1)]
    texts = [f"{'zq' * 30}{x}{'qz' * 30}".encode() for x in excerpts]
    assert {m[0] for m in d._matches(segments, texts)} == set(range(len(texts)))
    half = [(k, f"before {item[k : k + 116]} after") for k in range(0, len(item) - 116, 7)]
    docs = spark.createDataFrame([*half, (1000, "nothing of the kind")], "doc_id long, text string")
    kept = d.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [1000]
