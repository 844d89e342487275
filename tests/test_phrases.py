import random

from pyspark.sql import functions as F

from tidemark.operators import phrases


def test_hits_are_those_of_plain_containment(spark, monkeypatch):
    """Short and long phrases, shared beginnings, repeated texts; with little context most pairs need the whole text."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(12)] + ["công", "ty"]
    texts = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 80])))) for k in range(150)]
    known = sorted({" ".join(rng.choice(texts)[1].split()[a : a + rng.choice([1, 2, 3, 4, 9, 30])]) for a in (0, 2, 7, 20) for _ in range(40)}
                   | {"ty", "w1 w1 w1 w1 w1", "nowhere at all", "w1"} - {""})
    want = sorted((k, p) for k, t in texts for p in known if len(p) >= 5 and f" {p} " in f" {t} ")
    t = spark.createDataFrame(texts + texts[:3] + [(999, None)], "k int, t string")
    p = spark.createDataFrame([(x,) for x in known] + [(None,), (known[0],)], "phrase string")
    for context in (phrases.CONTEXT, 2):
        monkeypatch.setattr(phrases, "CONTEXT", context)
        assert sorted(map(tuple, phrases.phrase_hits(t, ["k"], "t", p).collect())) == want and want
    assert phrases.phrase_hits(t, ["k"], "t", p.limit(0)).count() == 0


def test_only_runs_of_the_dictionary_leave_their_row(spark):
    texts = spark.range(2000).select(F.col("id").alias("k"), F.concat_ws(" ", F.lit("alpha beta"), *[F.concat(F.lit("x"), F.hash("id", F.lit(j)).cast("string")) for j in range(20)]).alias("t"))
    p = spark.createDataFrame([("beta gamma delta",), ("gamma alpha",)], "phrase string")
    known = phrases.anchored(p)
    assert {r.anchor for r in known.collect()} == {"beta gamma delta", "gamma alpha"}
    holds = phrases.membership(known, "anchor")
    runs = texts.select(F.explode(F.split("t", " ")).alias("w"))
    assert runs.where(holds(F.col("w"))).count() < 50 and phrases.phrase_hits(texts, ["k"], "t", p).count() == 0


def test_the_filter_grows_with_the_dictionary(spark):
    known = spark.range(60_000).select(F.concat(F.lit("known"), "id").alias("v"))
    holds = phrases.membership(known, "v")
    assert known.where(~holds(F.col("v"))).count() == 0
    assert spark.range(20_000).where(holds(F.concat(F.lit("other"), "id"))).count() < 400
