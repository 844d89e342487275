from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.plans import screener, signals as sg
from tidemark.plans.bars import daily_bars


def test_one_position_at_a_time_and_no_entry_on_the_exit_bar(spark):
    cols = "symbol string, i int, entry double, stop double, target double, exit_i int, exit double, score int, scored int, entry_date date"
    d = date(2026, 1, 1)
    c = spark.createDataFrame([("A", 120, 10.0, 9.0, 12.0, 125, 8.5, 4, 4, d), ("A", 125, 9.0, 8.0, 11.0, 130, 11.5, 4, 4, d), ("A", 126, 9.0, 8.0, 11.0, 140, 11.5, 4, 4, d),
                               ("A", 150, 9.0, 8.0, 11.0, None, None, 4, 4, d), ("A", 160, 9.0, 8.0, 11.0, 161, 7.0, 4, 4, d), ("A", 141, 5.0, 4.0, 7.0, 142, 7.0, 1, 4, d)], cols)
    t = sg.walk_forward(c, None, (("rule", 3, False),)).orderBy("i").collect()
    assert [r.i for r in t] == [120, 126, 150]
    assert t[0].r < -1 and abs(t[0].net - (t[0].r - 10 * 0.004 / 1.0)) < 1e-12 and t[2].r is None


def test_truncating_the_future_keeps_closed_trades(spark):
    import random

    rng, rows = random.Random(3), []
    for s in range(6):
        p = 100.0
        for k in range(400):
            p *= 1 + rng.gauss(0.0005, 0.03)
            rows.append((f"S{s}", date(2024, 1, 1) + timedelta(days=k), p, 1000 + (k * 37 % 900), p * 1e6, float((k * 31) % 11 - 5)))
    bars = spark.createDataFrame(rows, "symbol string, as_of date, price double, volume int, turnover double, foreign_net double")
    cut = date(2024, 1, 1) + timedelta(days=300)
    variants = (("all", 0, False),)

    def closed(b):
        t = sg.walk_forward(sg.candidates(b), None, variants).where(F.col("exit_date") <= cut)
        return sorted((r.symbol, r.i, r.exit_i, r.exit) for r in t.collect())

    full, early = closed(bars), closed(bars.where(F.col("as_of") <= cut))
    assert full == early and full


def test_halt_gap_is_left_out_of_the_z_score(spark):
    d, rows = date(2026, 1, 1), []
    for k in range(40):
        d += timedelta(days=60 if k == 39 else 6 if k == 20 else 1)
        rows.append(("A", d, 100.0 + k % 2 if k < 39 else 60.0, 10))
    h = screener.price_history(spark.createDataFrame(rows, "symbol string, as_of date, price double, volume int")).first()
    assert h.last_ret is None and h.ret_sd < 0.02 and h.days == 40


def test_zero_dividend_falls_back(spark):
    f = spark.createDataFrame([("A", "2026-Q1", "dividend_yield", 0.03, 1), ("A", "2026-Q2", "dividend_yield", 0.0, 1), ("A", "2026-Q2", "pe", 0.0, 1), ("A", "2026-Q1", "pe", 9.0, 1)],
                              "symbol string, period string, metric string, value double, fetched_at int")
    got = {r.metric: (r.latest_value, r.latest_period, r.percentile) for r in screener.fundamental_percentiles(f).collect()}
    assert got == {"dividend_yield": (0.03, "2026-Q1", 1.0), "pe": (0.0, "2026-Q2", 0.5)}


def test_guard_refuses_an_empty_universe(spark):
    import pytest

    old = spark.createDataFrame([("GVR", 18.0, None)], "s string, pe double, pb double")
    with pytest.raises(screener.PublishRefused):
        screener.require_publishable(old.where("false"), old)


def test_one_reading_of_the_sessions_tells_bars_flows_and_shares(spark):
    rows = [(["A", "B", None][i % 3], None if i % 13 == 0 else date(2026, 1, 1) + timedelta(days=i % 7), (i * 37) % 50, [None, -1.0, float(i)][i % 3 if i % 2 else 2],
             i, [None, 5.0 * i][i % 2], [None, 3.0 * i][i % 5 == 0], [None, 1000 + i][i % 4 == 0]) for i in range(90)]
    quotes = spark.createDataFrame(rows, "symbol string, as_of date, fetched_at int, price double, volume int, foreign_buy_value double, foreign_sell_value double, listed_share int"
                                   ).withColumn("value", F.lit(None).cast("double"))
    order = ["fetched_at", "volume"]
    daily = screener.session_quotes(quotes, order)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    bars = daily_bars(quotes, order).select("symbol", "as_of", "price", "volume")
    assert same(daily.where("bar IS NOT NULL").select("symbol", "as_of", "bar.price", "bar.volume"), bars)
    assert same(screener._flow_totals(daily.where("foreign_buy_value IS NOT NULL OR foreign_sell_value IS NOT NULL")), screener.foreign_flow(quotes, order))
    shares = daily.groupBy("symbol").agg(F.max_by("share.listed_share", "share.at").alias("listed_share"))
    assert same(shares.where("listed_share IS NOT NULL"), screener.share_counts(quotes, order))
