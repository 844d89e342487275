import math
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA, frame, odd_rows, tables, words
from tidemark.llm import lm


def plain(rows, order):
    texts = [words(t) for _, t in rows]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = [sum((grams(w, n) for w in texts), Counter()) for n in range(1, order + 1)]
    words_all = sum(map(len, texts))
    out = []
    for (doc, _), w in zip(rows, texts, strict=True):
        own = [grams(w, n) for n in range(1, order + 1)]
        rest = words_all - len(w)
        score = unseen = backs = 0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                count = total[n - 1][gram] - own[n - 1][gram]
                below = rest if n == 1 else total[n - 2][gram[:-1]] - own[n - 2][gram[:-1]]
                if count > 0:
                    score += math.log(count / below)
                    break
                if n > 1:
                    score += math.log(lm.BACKOFF)
                    backs += 1
            else:
                score -= math.log(rest + 1)
                unseen += 1
        out.append((repr(doc), len(w), unseen, backs, score))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_the_plain_version(spark, order):
    documents = tables("0.001", "documents")[0][:25]
    rows = [r[:2] for r in odd_rows()] + [(100 + r[0], r[1]) for r in documents]
    got = sorted((repr(r.doc_id), r.n_words, r.n_unseen, r.n_backoffs, r.log_score) for r in lm.score(frame(spark, [(*r, None, None, None, None) for r in rows]), order).collect())
    want = plain(rows, order)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) < 1e-4 for g, w in zip(got, want, strict=True))


def test_empty_table_and_single_text(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = lm.score(spark.createDataFrame([(1, "a b a b")], "doc_id long, text string")).collect()
    assert (row.n_words, row.n_unseen) == (4, 4)


def test_a_copied_phrase_scores_above_its_pairs_in_another_order(spark):
    shared = [(1, "a b c d e f"), (2, "c d x b c y d e z a b")]
    copied, shuffled = (3, "a b c d e f"), (4, "d e f a b c d")
    rows = [*shared, copied, shuffled]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    want = plain(rows, 3)
    assert [(repr(k), g.n_words, g.n_unseen, g.n_backoffs) for k, g in sorted(got.items())] == [w[:4] for w in want]
    assert got[3].mean_log_score > got[4].mean_log_score


def test_the_registered_query_has_order_3_and_asks_only_for_shared_parts(spark):
    import __spark_entry__

    assert "op4_lm_scoring" in __spark_entry__.queries()
    block = lm._Block([b"a b c d", b"a b c x", b"p q r s"], 3)
    block.elsewhere = [None, np.array([-1, 1, 1, 0, -1, 1, 1, 0, -1, 0, 0, 0])]
    asked, counts = block.asked(3)
    assert counts.tolist() == [2]  # only "a b c": the others hold a pair that occurs nowhere else
    every = lm.score(spark.createDataFrame([(k, t) for k, t in enumerate(["a b c d", "a b c d e", "c d e a", "", None])], "doc_id long, text string"), 4)
    assert sorted(repr(r.doc_id) for r in every.collect()) == ["0", "1", "2", "3", "4"]


def test_repeats_of_a_row_lie_in_many_blocks_and_vouch_for_each_other(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm, "PART_BYTES", 4000)
    rows = [(5, "the same words in a row")] * 1500 + [(6, "other words entirely")]
    got = sorted((repr(r.doc_id), r.n_words, r.n_unseen, r.n_backoffs, r.log_score) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect())
    assert got == [(*r[:4], round(r[4], 6)) for r in plain(rows, 3)]
