"""What several steps read is shuffled or worked out once."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.rolling import sample_deviation
from tidemark.plans import dossier, listing_panel as lp, signals as sg
from tidemark.session import shared


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def counted(spark):
    """A frame whose rows are counted whenever they are worked out, and the count."""
    seen = spark.sparkContext.accumulator(0)

    def mark(x):
        seen.add(1)
        return x

    def wrap(df, column):
        return df.withColumn(column, F.udf(mark, df.schema[column].dataType).asNondeterministic()(column))

    return wrap, seen


def test_readers_of_other_columns_share_a_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id", (F.col("id") * 2).alias("v"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("w"))
    one = shared(df.repartition("k"), ["k"])
    assert one.columns == df.columns and sorted(one.collect(), key=str) == sorted(df.collect(), key=str)
    both = one.groupBy("k").agg(F.sum("v").alias("x")).unionByName(one.groupBy("k").agg(F.count("w").alias("x")))
    assert "ReusedExchange" in final_plan(both)[1]


def test_deviation_of_an_array_is_that_of_rows(spark):
    values = [[], [1.5], [0.1, 0.7, -3.25, 1e6], [2.0] * 5, [1 / (k + 1) for k in range(59)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<double>")
    got = {r.i: r.sd for r in df.select("i", sample_deviation(F.col("v")).alias("sd")).collect()}
    want = {r.i: r.sd for r in df.select("i", F.explode_outer("v").alias("x")).coalesce(1).groupBy("i").agg(F.stddev_samp("x").alias("sd")).collect()}
    assert got == want


def trades(spark, n=6):
    rows = [("a", f"S{k}", 120 + k, date(2026, 1, 2), 10.0, 9.0, 12.0, *((None,) * 3 if k % 2 else ("stop", 8.5, -1.5)), -1.5 if k % 2 == 0 else None, 3, 4) for k in range(n)]
    cols = "variant string, symbol string, i int, entry_date date, entry double, stop double, target double, reason string, exit double, r double, net double, score int, scored int"
    df = spark.createDataFrame(rows, cols)
    return df.select("*", *[F.lit(1.0).alias(c) for c in ("volume_x", "money_x", "money_bn", "foreign_bn")], *[F.lit(True).alias(f"{x}_ok") for x in sg.LAYERS])


def test_open_positions_walk_once(spark, counted):
    wrap, seen = counted
    bars = spark.createDataFrame([(f"S{k}", date(2026, 1, d), 10.0 + d) for k in range(6) for d in (1, 2, 3)], "symbol string, as_of date, price double")
    got = sg.open_positions(wrap(trades(spark), "stop"), bars).collect()
    assert sorted((r.symbol, r.now, r.held) for r in got) == [(f"S{k}", 13.0, 2) for k in (1, 3, 5)]
    assert seen.value <= 6


def test_a_track_record_walks_once(spark, counted):
    wrap, seen = counted
    caps = spark.createDataFrame([("S0", 5.0), ("S2", 9.0)], "symbol string, cap double")
    got = sg.summary(wrap(trades(spark), "net"), caps).collect()
    assert [(r.variant, r.trades, r.total_r, r.worst_losing_streak) for r in got] == [("a", 3, -4.5, 3)]
    assert seen.value <= 6


def test_newest_events_are_shuffled_once(spark):
    at = datetime(2026, 1, 1)
    rows = [("A", f"e{k % 5}", "code", f"t{k}", date(2026, 1, 1 + k % 5), None, None, at + timedelta(days=k)) for k in range(10)]
    df = spark.createDataFrame(rows, "symbol string, event_id string, event_code string, title string, public_date date, record_date date, exright_date date, fetched_at timestamp")
    got, plan = final_plan(dossier.events(df.repartition(3), k=3))
    assert [(r.symbol, r["count"], [x.title for x in r.rows]) for r in got] == [("A", 5, ["t9", "t8", "t7"])]
    assert "ReusedExchange" in plan


def test_panel_rows_are_worked_out_once(spark, counted):
    wrap, seen = counted
    first = datetime(2026, 1, 1)
    rows = [("r", "c", k, "d", first, first + timedelta(days=k), 3, 10.0, 9.0, 50.0, 50.0, 3, date(2026, 1, 2), date(2026, 1, 1)) for k in range(8)]
    panel = spark.createDataFrame(rows, "region string, category string, list_id int, district string, first_seen timestamp, last_seen timestamp, days_seen long, price_first double,"
                                        " price_last double, size_first double, size_last double, crawl_days int, gone_cutoff date, first_crawl_day date")
    got = lp.panel_metrics(wrap(panel, "price_last"), spark.createDataFrame([(0,)], "list_id int"), min_samples=1).collect()
    assert [(r.pcn, r.pc, r.pcm, r.dm) for r in got] == [(8, 100.0, -10.0, 3)]
    assert seen.value <= 8
