from collections import Counter

from tests.llm.helpers import SCHEMA, frame, odd_rows, tables, words
from tidemark.llm import quality


def plain(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in often for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def judged(spark, rows, schema=SCHEMA):
    return quality.judge(frame(spark, rows, schema)).collect()


def test_counts_are_those_of_the_plain_version(spark):
    rows = odd_rows() + [(50, "a b c d e a b c d e f", None, None, None, None), (51, "same line here\nsame line here\n \nx\nx", None, None, None, None),
                         (52, "b c d e b c d e b c d e f g h", None, None, None, None)]
    got = sorted(repr(tuple(r)[:7]) for r in judged(spark, rows))
    assert got == sorted(repr((r[0], *plain(r[1]))) for r in rows)
    assert judged(spark, [], SCHEMA) == []


def test_table_decides_after_the_base_rule(spark):
    prose = " ".join(["the", "river", "and", "its", "banks", "were", "green", "in", "early", "spring", "when", "we", "came"])
    rows = [(1, prose), (2, " | ".join(prose.split())), (3, "!! ".join(prose.upper().split()) + "!!"), (4, "$$$ ".join(prose.split())), (5, "the " * 3), (6, " ".join(map(str, range(10**6, 10**6 + 20))))]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    loose = quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), thresholds=()).collect()
    assert all(r.kept is not r.base_failed for r in loose)


def test_kept_rows_keep_their_columns_and_junk_labels_are_rejected(spark):
    docs = frame(spark, odd_rows(["the quick brown fox jumps over a lazy dog and the cat sees it all", "short"]))
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]
    documents, labels = tables("0.01", "documents", "labels")
    verdict = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame([r[:2] for r in documents], "doc_id long, text string")).collect()}
    long_enough = {r[0] for r in documents if not plain(r[1])[5]}
    good = [verdict[d] for d, q, _ in labels if q == 1 and d in long_enough]
    assert sum(good) >= 0.97 * len(good)


def test_plan_is_one_projection(spark):
    plan = quality.judge(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow"))
