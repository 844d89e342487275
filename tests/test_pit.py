import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.schemas import TABLES, conform, read_table

T = datetime


def quotes(spark):
    rows = [("A", "2026-01-02", T(2026, 1, 2, 8), 10.0, 5), ("A", "2026-01-02", T(2026, 1, 2, 9), None, 6), ("B", "2026-01-02", T(2026, 1, 2, 8), 3.0, None)]
    return spark.createDataFrame(rows, "symbol string, d string, fetched_at timestamp, price double, volume int").select("symbol", F.to_date("d").alias("as_of"), "fetched_at", "price", "volume")


def test_row_latest_keeps_null_but_column_latest_does_not(spark):
    q = quotes(spark)
    row = {r.symbol: r.price for r in pit.latest(q, ["symbol"], ["fetched_at"]).collect()}
    assert row == {"A": None, "B": 3.0}
    cols = q.groupBy("symbol").agg(*pit.field_latest(q, ["symbol"], {"price": None, "volume": None}, ["fetched_at"]))
    assert {r.symbol: (r.price, r.volume) for r in cols.collect()} == {"A": (10.0, 6), "B": (3.0, None)}


def test_later_observations_never_change_the_past(spark):
    q = quotes(spark)
    at = T(2026, 1, 2, 8, 30)
    before = sorted(map(tuple, pit.pit_latest(q, ["symbol"], at).collect()))
    more = q.unionByName(q.where("symbol = 'A'").withColumn("fetched_at", F.lit(T(2026, 2, 1))).withColumn("price", F.lit(99.0)))
    assert sorted(map(tuple, pit.pit_latest(more, ["symbol"], at).collect())) == before


def test_latest_limits_groups_before_the_shuffle(spark):
    plan = pit.latest(quotes(spark), ["symbol"], ["fetched_at"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_append_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "eq_quote")
    assert pit.append_observations(spark, path, "eq_quote", quotes(spark)).first()["rows_new"] == 3
    assert pit.append_observations(spark, path, "eq_quote", quotes(spark)).first()["rows_new"] == 0
    stored = read_table(spark, path, "eq_quote")
    assert stored.count() == 3 and stored.where("listed_share IS NOT NULL").count() == 0


def test_conform_fills_and_drops(spark):
    c = conform(quotes(spark).withColumn("extra", F.lit(1)), "eq_quote")
    assert c.columns == [f.name for f in TABLES["eq_quote"].schema.fields]


def test_asof_matches_a_plain_scan(spark):
    facts = spark.createDataFrame([("k", T(2026, 1, 1, h, m), float(h * 60 + m)) for h in range(0, 24, 3) for m in (0, 59)], "k string, t timestamp, v double")
    probes = spark.createDataFrame([("k", T(2026, 1, 1, h, 30)) for h in range(24)] + [("other", T(2026, 1, 1, 5))], "k string, p timestamp")
    got = {(r.k, r.p): r.v for r in pit.asof_latest(probes, facts, ["k"], "p", "t", ["v"]).collect()}
    rows = facts.collect()
    for (k, p), v in got.items():
        known = [r for r in rows if r.k == k and r.t <= p]
        assert v == (max(known, key=lambda r: r.t).v if known else None)
    assert len(got) == 25


def test_a_burst_of_one_key_and_hour_is_cut_into_pieces_by_rank(spark):
    """A third of all rows in a few milliseconds of one key and hour: many pieces, same answers."""
    rng = random.Random(7)
    t0 = T(2026, 1, 1, 10)
    burst = lambda: t0 + timedelta(microseconds=rng.choice([rng.randrange(3000), rng.randrange(3000), 10**6 * rng.randrange(36000)]))
    keys = ["hot", "hot", "cold", None]
    facts = [(rng.choice(keys), burst(), rng.randrange(5), float(i) if i % 9 else None) for i in range(3000)]
    probes = [(rng.choice(keys), burst(), i) for i in range(1500)]
    f, p = spark.createDataFrame(facts, "k string, t timestamp, tie int, v double"), spark.createDataFrame(probes, "k string, p timestamp, n int")
    pieces = pit._pieces(f, ["k"], "t", 3600, 100, 15)
    crowded = {r._piece: r["count"] for r in pieces.where("k = 'hot'").groupBy("_bucket", "_piece").count().collect() if r["count"] > 1}
    assert len(crowded) > 12 and max(crowded.values()) < 400
    got = {r.n: (r.t_found, r.v) for r in pit.asof_latest(p, f, ["k"], "p", "t", ["v"], ["tie", "v"], piece_rows=100, cuts=15).collect()}
    rank = lambda r: (r[1], r[2], r[3] is not None, r[3] or 0)
    for k, at, n in probes:
        last = max((r for r in facts if r[0] == k and k is not None and r[1] <= at), key=rank, default=None)
        assert got[n] == ((last[1], last[3]) if last else (None, None))
    assert len(got) == 1500
    f = f.withColumn("n", F.monotonically_increasing_id())
    fine = pit.changes_only(f, ["k"], "t", ["tie"], ["tie", "n"], piece_rows=50, cuts=15)
    whole = pit.changes_only(f, ["k"], "t", ["tie"], ["tie", "n"])
    assert sorted(r.n for r in fine.where("k IS NOT NULL").collect()) == sorted(r.n for r in whole.where("k IS NOT NULL").collect())


def test_rows_that_cannot_be_newest_go_and_newest_never(spark):
    rows = [(f"k{k % 50}" if k % 11 else None, k * k % 997 if k % 13 else None, k) for k in range(3000)] + [("old", 1, -1), ("none", None, -2)]
    df = spark.createDataFrame(rows, "key string, at long, k int")
    newest = lambda d: {(r.key, r.at) for r in d.groupBy("key").agg(F.max("at").alias("at")).collect()}
    for slots in (1, 4, 1 << 14):
        kept = pit.maybe_newest(df, ["key"], F.col("at"), slots)
        assert newest(kept) == newest(df)
    assert kept.where("at IS NOT NULL").count() < len(rows) / 10
