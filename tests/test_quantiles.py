import random
import statistics

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.operators.ordered import track_record
from tidemark.operators.quantiles import SKETCH_ACCURACY, UPPER_MIDDLE, _cuts, bucket_of, exact_quantiles


def interpolate(xs, p):
    xs = sorted(xs)
    pos = (len(xs) - 1) * p
    i = int(pos)
    return xs[i] + (xs[min(i + 1, len(xs) - 1)] - xs[i]) * (pos - i)


def test_against_sorting_with_one_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", round(rng.lognormvariate(3, 2), 3)) for _ in range(5000)] + [("hot", 7.0)] * 3000
    rows += [("neg", rng.uniform(-50, 50)) for _ in range(41)] + [("one", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], {"v": ("v", {"p05": 0.05, "p50": 0.5, "p95": 0.95, "um": UPPER_MIDDLE})}).collect()}
    for k in ("hot", "neg", "one"):
        xs = [v for kk, v in rows if kk == k]
        assert abs(got[k].p05 - interpolate(xs, 0.05)) < 1e-9
        assert abs(got[k].p50 - statistics.median(xs)) < 1e-9
        assert abs(got[k].p95 - interpolate(xs, 0.95)) < 1e-9
        assert got[k].um == sorted(xs)[len(xs) // 2]


def test_buckets_stay_small_where_values_crowd(spark):
    n = 200_000
    crowd = spark.range(n).select(F.lit("near zero").alias("k"), (F.col("id") * 2e-8).alias("v")).unionByName(
        spark.range(n).select(F.lit("far").alias("k"), (F.lit(1e9) + F.col("id") % 20_000 - 10_000 + F.col("id") / n).alias("v")))
    cuts = crowd.groupBy("k").agg(F.percentile_approx("v", _cuts([0.05, 0.5, 0.95]), SKETCH_ACCURACY).alias("cuts"))
    held = crowd.join(cuts, "k").select("k", "v", bucket_of(F.col("v"), F.col("cuts")).alias("b"))
    wanted = [r["count"] for r in held.where("b IN (1, 3, 5)").groupBy("k", "b").count().collect()]
    assert len(wanted) == 6 and max(wanted) < 0.005 * n
    got = {r.k: r for r in exact_quantiles(crowd, ["k"], {"v": ("v", {"p05": 0.05, "p50": 0.5})}).collect()}
    want = {r.k: r for r in crowd.groupBy("k").agg(F.percentile("v", 0.05).alias("p05"), F.percentile("v", 0.5).alias("p50")).collect()}
    for k, r in want.items():
        assert abs(got[k].p05 - r.p05) < 1e-6 and abs(got[k].p50 - r.p50) < 1e-6


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.floats(-3, 3)), min_size=1, max_size=40))
def test_merged_track_record_equals_one_pass(spark, pairs):
    caps = {0: 10.0, 1: 500.0, 2: 500.0, 3: 7000.0, 4: 0.0}
    rows = [("v", f"s{s}", caps[s], i, r, r - 0.1, "stop") for i, (s, r) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "g string, symbol string, cap double, i int, r double, net double, reason string")
    got = track_record(df, ["g"], "symbol", "cap", "i").first()
    ordered = sorted(rows, key=lambda x: (-x[2], x[1], x[3]))
    eq = peak = dd = 0.0
    run = worst = 0
    for row in ordered:
        eq += row[4]
        peak = max(peak, eq)
        dd = min(dd, eq - peak)
        run = run + 1 if row[4] <= 0 else 0
        worst = max(worst, run)
    assert abs(got["r_sum"] - eq) < 1e-9 and abs(got["r_dd"] - dd) < 1e-9 and got["streak"] == worst and got["n"] == len(rows)
