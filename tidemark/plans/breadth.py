"""Market breadth per session and the regime it describes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.numeric import pct, ratio, rnd
from tidemark.operators.rolling import Series


def above_average_share(bars: DataFrame, n: int = 50) -> DataFrame:
    """Share of symbols at or above their own n-session average, per session."""
    s = Series("symbol", "as_of")
    flagged = bars.select("as_of", "price", s.sma("price", n).alias("ma")).where("ma IS NOT NULL")
    return flagged.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("price") >= F.col("ma")).alias("above")
    ).select("as_of", "n", "above", pct("above", "n").alias("a50"))


def session_breadth(bars: DataFrame, min_history: int = fv.BREADTH_MIN_HISTORY) -> DataFrame:
    """One row per session: advances and declines, averages, 52-week extremes, money, foreign net."""
    s = Series("symbol", "as_of")
    at = bars.select(
        "as_of", "price", "turnover", "foreign_net",
        s.lag("price").alias("prev"), s.sma("price", 50).alias("ma50"), s.sma("price", 200).alias("ma200"),
        s.high("price", 252).alias("hi"), s.low("price", 252).alias("lo"), s.count(252).alias("held"))
    up, down = F.col("price") > F.col("prev"), F.col("price") < F.col("prev")
    at_high = (F.col("held") >= min_history) & (F.col("price") >= F.col("hi"))
    at_low = (F.col("held") >= min_history) & (F.col("price") <= F.col("lo")) & ~at_high
    money = F.coalesce("turnover", F.lit(0.0))
    g = at.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("covered"), F.count("prev").alias("n"),
        F.count_if(up).alias("adv"), F.count_if(down).alias("dec"),
        F.count_if(F.col("price") >= F.col("ma50")).alias("_a50"), F.count("ma50").alias("_c50"),
        F.count_if(F.col("price") >= F.col("ma200")).alias("_a200"), F.count("ma200").alias("_c200"),
        F.count_if(at_high).alias("nh"), F.count_if(at_low).alias("nl"),
        F.coalesce(F.sum(F.when(up, money)), F.lit(0.0)).alias("_up"),
        F.coalesce(F.sum(F.when(down, money)), F.lit(0.0)).alias("_down"),
        F.coalesce(F.sum("foreign_net"), F.lit(0.0)).alias("_fn"))
    return g.select(
        "as_of", "covered", "n", "adv", "dec",
        rnd(F.least(ratio("adv", "dec"), F.lit(fv.AD_CAP)), 2).alias("_ad"), "_a50", "_c50", "_a200", "_c200",
        "nh", "nl", "_up", "_down", "_fn",
    ).select(
        "as_of", "covered", "n", "adv", "dec",
        F.when(F.col("dec") > 0, F.col("_ad")).alias("ad"),
        rnd(ratio("_a50", "_c50") * 100, 1).alias("a50"), rnd(ratio("_a200", "_c200") * 100, 1).alias("a200"),
        "nh", "nl",
        rnd(ratio("_up", F.col("_up") + F.col("_down")) * 100, 1).alias("uv"),
        F.when(F.col("_fn") != 0, rnd(F.col("_fn") / 1e9, 1)).alias("fn"))


def coverage_floor(sessions: DataFrame, share: float = fv.BREADTH_MIN_COVERAGE) -> DataFrame:
    """One row: the upper-middle session size and the share of it a session must reach.

    Runs over one row per session, so the sorted list is bounded by the calendar.
    """
    sizes = F.array_sort(F.collect_list("covered"))
    middle = F.element_at(sizes, (F.floor(F.size(sizes) / 2) + 1).cast("int"))
    return sessions.agg(middle.alias("median_universe")).withColumn("_floor", F.col("median_universe") * F.lit(share))


def published_breadth(bars: DataFrame, sessions: int = fv.BREADTH_SESSIONS, min_names: int = fv.BREADTH_MIN_NAMES,
                      share: float = fv.BREADTH_MIN_COVERAGE, min_history: int = fv.BREADTH_MIN_HISTORY) -> DataFrame:
    """The newest sessions that cover enough of the market to be compared."""
    per_day = session_breadth(bars, min_history)
    kept = per_day.crossJoin(F.broadcast(coverage_floor(per_day, share))).where(
        (F.col("covered") >= F.col("_floor")) & (F.col("n") >= min_names))
    return kept.orderBy(F.col("as_of").desc()).limit(sessions).drop("_floor")


def skipped_sessions(bars: DataFrame, last: int = 5, share: float = fv.BREADTH_MIN_COVERAGE) -> DataFrame:
    per_day = session_breadth(bars)
    thin = per_day.crossJoin(F.broadcast(coverage_floor(per_day, share))).where(F.col("covered") < F.col("_floor"))
    return thin.orderBy(F.col("as_of").desc()).limit(last).select("as_of", "covered")


def regime_label(a50: Column, a200: Column) -> Column:
    return (
        F.when(a50.isNull() | a200.isNull(), F.lit(None))
        .when((a200 >= 60) & (a50 >= 55), "broad")
        .when((a200 <= 35) & (a50 <= 40), "weak")
        .when((a50 >= 55) & (a200 < 55), "early_recovery")
        .when((a50 <= 40) & (a200 > 40), "pullback")
        .otherwise("mixed"))


def breadth_regime(breadth: DataFrame) -> DataFrame:
    return breadth.select("as_of", "a50", "a200", regime_label(F.col("a50"), F.col("a200")).alias("regime"))


def market_trend(bars: DataFrame, universe: DataFrame | None = None, n: int = 50, min_names: int = fv.REGIME_MIN_NAMES) -> DataFrame:
    """Per day: is more than half of the universe strictly above its own average? Only with enough names."""
    s = Series("symbol", "as_of")
    inside = bars if universe is None else bars.join(universe.select("symbol"), "symbol", "left_semi")
    g = inside.select("as_of", "price", s.sma("price", n).alias("ma")).where("ma IS NOT NULL").groupBy("as_of").agg(
        F.count(F.lit(1)).alias("names"), F.count_if(F.col("price") > F.col("ma")).alias("above"))
    return g.where(F.col("names") >= min_names).select(
        "as_of", "names", "above", (F.col("above") / F.col("names") > 0.5).alias("rising"))
