import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA, frame, odd_rows, tables
from tidemark.llm import collocations

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def plain(rows, least=30, most=2000):
    """(lang, rank, phrase, a, l, r, n, score) by plain counting; rows of (text, lang)."""
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            count.update((lang, *words[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(words) - n + 1))
    found = {p: a for p, a in count.items() if len(p) > 2 and a >= least}
    shadowed = {(p[0], *p[1:][i : i + n]) for p, a in found.items() for n in range(2, len(p) - 1) for i in range(len(p) - n)
                if 100 * a >= 80 * found.get((p[0], *p[1:][i : i + n]), a * 10**9) and len(p[1:][i : i + n]) == n}
    out = []
    for (lang, *words), a in found.items():
        cuts = [(2_000_000 * a // (count[lang, *words[:k]] + count[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        if (lang, *words) not in shadowed:
            out.append((lang, -score, -a, " ".join(words).encode(), a, count[lang, *words[:k]], count[lang, *words[k:]], total[lang], score))
    ranked, place = [], Counter()
    for lang, _, _, phrase, a, left, right, n, score in sorted(out):
        place[lang] += 1
        if place[lang] <= most:
            ranked.append((lang, place[lang], phrase.decode(), a, left, right, n, score))
    return ranked


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "B", "the", "of", "né", "漢", "x\x1cy", "É", "zz", "q" * 70] + [f"w{k}" for k in range(30)]
    common = ["the of a", "New York City", "to be or not", "w1 w2 w3 w4 w5"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(common) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(40))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "!? ", " \x0b"]) for p in parts)
        rows.append((text, rng.choice(["en", "en", "de", None, "und", "x y\nz"])))
    return rows + [(None, "en"), ("", None), (rows[0][0] * 50, "fr")]


def found(spark, rows, **settings):
    out = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), **settings)
    return sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("settings", [{}, {"shard_bytes": 500, "range_bytes": 800}, {"shard_bytes": 900, "range_bytes": 300, "fan": 3}])
def test_collocations_are_those_of_plain_counting(spark, settings):
    rows = corpus(1)
    assert found(spark, rows, **settings) == plain(rows)


def test_limits_ties_and_thresholds(spark):
    rows = corpus(2)
    assert found(spark, rows, most=5, least=3, range_bytes=2000) == plain(rows, least=3, most=5)


def test_one_text_longer_than_a_shard_and_its_words_in_segments(spark, monkeypatch):
    rows = [("one two three. " * 4000 + "four " * 3000, "en")]
    assert found(spark, rows, shard_bytes=1000, range_bytes=1500) == plain(rows)
    text = rows[0][0].encode()
    assert [w for part in collocations.segments(text, 64) for w in part] == [w for part in collocations.segments(text) for w in part]
    assert list(collocations.segments(b"x" * 5000 + b" y", 64)) == [[b"x" * 5000], [b"y"]]


def test_packed_transducers_come_back_and_compose():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 2, 500).astype(np.int32), *(rng.integers(0 if k else 1, 6, 500).astype(np.int32) for k in range(4))]
    for k in range(2, 5):
        columns[k][columns[k - 1] == 0] = 0
    whole = collocations.Transducer.summed([b"de", b"x\ny"], [b"a", b"b", b"c", b"z", "é".encode()], columns, np.ones(500, np.int64))
    back = collocations.Transducer.unpacked(whole.packed())
    assert [c.tolist() for c in back.columns] == [c.tolist() for c in whole.columns] and back.weight.tolist() == whole.weight.tolist()
    assert (back.langs, back.words) == (whole.langs, whole.words)
    some = whole.taken(np.arange(0, len(whole), 3))
    assert whole.composed(collocations.Transducer.unpacked(some.packed())).tolist() == some.weight.tolist()
    assert collocations.Transducer.unpacked(some.packed()).composed(whole).tolist() == [w if k % 3 == 0 else 0 for k, w in enumerate(whole.weight.tolist())]
    bounds = sorted({whole.prefix(k) for k in (10, 77, 200)} | {(b"de", b"bb", b"", b"", b""), (b"zz", b"a", b"", b"", b"")})
    pieces = list(whole.pieces(bounds))
    assert sum(len(p) for _, p in pieces) == len(whole)
    assert all(collocations._owner(bounds, p.prefix(k)) == n for n, p in pieces for k in (0, len(p) - 1))
    assert collocations.Transducer.union([p for _, p in pieces[::-1]]).weight.tolist() == whole.weight.tolist()


def test_odd_rows_clashing_columns_and_an_empty_table(spark):
    rows = odd_rows()
    out = collocations.collocations(frame(spark, rows))
    got = sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain([(r[1], r[2]) for r in rows]) and got
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table_of_documents(spark):
    rows = [(r[1], r[2]) for r in tables("0.001", "documents")[0]]
    assert found(spark, rows, range_bytes=50_000) == plain(rows)


def test_scores_past_64_bits():
    counts = collocations.Transducer([b"en"], [b"a", b"b"], [np.array([0, 0, 0], np.int32), np.array([1, 1, 2], np.int32), np.array([0, 2, 0], np.int32),
                                     *[np.zeros(3, np.int32)] * 2], np.array([1 << 60, (1 << 60) - 7, 1 << 61], np.int64))
    parts = collocations._parts(counts)
    rows = [(0, "counts", None, None, None, counts.packed()), (0, "answer", None, len(parts), 0, collocations._packed(counts.composed(parts)))]
    out = collocations._scored(collocations._summed(rows)).to_pylist()
    assert [(r["phrase"], r["l"], r["r"], r["score"]) for r in out] == [("a b", 1 << 60, 1 << 61, 2_000_000 * ((1 << 60) - 7) // (3 << 60))]


def test_no_round_gathers_more_than_about_one_shard():
    """A little over `fan` ranges: a group of the first round holds `step` shards' pieces of one of its ranges."""
    for ranges in (1, 2, 255, 256, 257, 300, 750, 5000, 65_536):
        rounds, step = collocations._rounds(ranges, 256)
        assert step <= 256 and step**rounds >= ranges > 256 ** (rounds - 1) * (ranges > 1)
        first = -(-ranges // step ** (rounds - 1))
        assert rounds == 1 or step / first <= 1.3
