from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.plans import decision

NOW = datetime(2026, 9, 18, 12)


def day(n):
    return NOW.replace(hour=0) + timedelta(days=n)


def facts_of(spark, observations):
    instants = spark.createDataFrame([(a, NOW) for a in ("BTC", "ETH", "XAU")], "asset string, now timestamp")
    return {(r.asset, r.label): r for r in decision.context_facts(instants, observations).collect()}


def flows(spark, *rows):
    return decision.etf_facts(spark.createDataFrame([("BTC", *r) for r in rows], "asset string, observed timestamp, fetched timestamp, net double"))


def test_zero_stale_future_and_missing_context_stay_apart(spark):
    fetched = NOW - timedelta(hours=1)
    for observed, net, status, bias in ((day(0), 0.0, "ok", 0), (day(-1), -3.0, "ok", -1), (day(-14), 2.0, "stale", 0), (day(4), 2.0, "future", 0), (day(0), None, "missing", 0)):
        fact = facts_of(spark, flows(spark, (observed, fetched, net)))["BTC", "etf_flow"]
        assert (fact.status, fact.bias) == (status, bias) and (fact.value == net if net is not None else fact.value is None)


def test_a_new_retrieval_does_not_refresh_an_old_observation(spark):
    readings = spark.createDataFrame([(day(-4), NOW - timedelta(minutes=1), 1.5)], "observed timestamp, fetched timestamp, value double")
    assert facts_of(spark, decision.mvrv_facts(readings))["BTC", "mvrv"].status == "stale"
    assert facts_of(spark, decision.sentiment_facts(readings))["ETH", "sentiment"].status == "stale"


def test_every_asset_has_its_own_labels_and_times_to_live(spark):
    closes = spark.createDataFrame([("dxy", day(-2), day(-1), 100.0), ("dxy", day(-1), day(0), 100.5), ("gold", day(-1), day(0), 5.0)],
                                   "code string, observed timestamp, fetched timestamp, close double")
    facts = facts_of(spark, decision.dollar_facts(closes).unionByName(decision.gold_facts(closes)))
    assert {k for k in facts if k[0] == "XAU"} == {("XAU", x) for x in ("dollar", "gold_future", "calendar")}
    assert {k[1] for k in facts if k[0] == "ETH"} == {"dollar", "etf_flow", "dealer_gamma", "sentiment", "calendar"}
    assert [facts[a, "dollar"].bias for a in ("BTC", "ETH", "XAU")] == [-1, -1, -1] and facts["XAU", "gold_future"].status == "missing"
    assert facts["BTC", "calendar"].status == "missing"


def test_gamma_holds_eight_hours_and_needs_contracts(spark):
    mk = lambda hours, n: spark.createDataFrame([("BTC", NOW - timedelta(hours=hours), n, 1e6)], "asset string, observed timestamp, contracts long, net_gamma double")
    assert [facts_of(spark, decision.gamma_facts(mk(h, n)))["BTC", "dealer_gamma"].status for h, n in ((8, 3), (9, 3), (1, 0))] == ["ok", "stale", "missing"]


def test_only_sound_facts_with_the_other_side_speak_against_a_verdict(spark):
    closes = spark.createDataFrame([("dxy", day(-2), day(-1), 100.0), ("dxy", day(-1), day(0), 100.5)], "code string, observed timestamp, fetched timestamp, close double")
    observed = decision.dollar_facts(closes).unionByName(flows(spark, (day(-1), day(0), 7.0)))
    instants = spark.createDataFrame([("BTC", NOW)], "asset string, now timestamp")
    facts = decision.context_facts(instants, observed)
    said = {d: [r.label for r in decision.counter_facts(instants.withColumn("direction", F.lit(d)), facts).collect()] for d in (-1, 0, 1)}
    assert said == {1: ["dollar"], -1: ["etf_flow"], 0: []}
