"""Rules-based signals walked forward, with their track record.

A signal's exit depends only on prices after it, never on which other signals were taken.  So every
candidate gets its exit from one forward frame, and the walk reduces to taking candidates in order
while flat: a short fold over a symbol's candidates, repeated per rule variant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.numeric import ratio, rnd
from tidemark.operators.ordered import track_record
from tidemark.operators.quantiles import UPPER_MIDDLE, exact_quantiles
from tidemark.operators.rolling import Series, median_of, sample_deviation, with_obv
from tidemark.session import written

LAYERS = ("volume", "money", "foreign", "accumulation")


def eligible(bars: DataFrame, caps: DataFrame, min_history: int = fv.MIN_HISTORY, min_cap: float = fv.MIN_MARKET_CAP,
             limit: int | None = None) -> DataFrame:
    """Symbols with enough bars and size; `limit` keeps the largest."""
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")).where(F.col("bars") >= min_history)
    out = n.join(caps.where(F.col("cap") >= min_cap), "symbol")
    return out if limit is None else out.orderBy(F.col("cap").desc(), "symbol").limit(limit)


def bar_features(bars: DataFrame) -> DataFrame:
    """Every input of the rule, each bar seeing only itself and earlier bars."""
    s = Series("symbol", "as_of")
    b = bars.select("symbol", "as_of", "price", "volume", "turnover", "foreign_net", s.index().alias("i"),
                    s.ret("price").alias("ret"), s.sma("price", 20).alias("fast"), s.sma("price", 50).alias("slow"),
                    s.high("price", fv.MIN_HISTORY).alias("hi"), s.low("price", fv.MIN_HISTORY).alias("lo"),
                    s.prior_values("volume", fv.FLOW_LOOKBACK).alias("_volumes"),
                    s.prior_values("turnover", fv.FLOW_LOOKBACK).alias("_turnovers"),
                    s.sum_min_obs("foreign_net", 5, 3).alias("foreign_week"))
    b = with_obv(b, s)
    return b.select(
        "symbol", "as_of", "i", "price", "volume", "turnover", "foreign_net", "fast", "slow", "hi", "lo",
        median_of(F.col("_volumes")).alias("base_volume"), median_of(F.col("_turnovers")).alias("base_turnover"), "foreign_week", "obv", s.lag("obv", fv.OBV_SLOPE_BARS).alias("obv_back"),
        s.stdev_of_returns("ret", 60).alias("sd"), s.crossed_up("fast", "slow").alias("crossed"))


def confirmation_layers(features: DataFrame) -> DataFrame:
    """Pass/fail per layer, NULL where an input is missing; a missing layer counts neither way."""
    def spike(today, base):
        t, b = F.col(today), F.col(base)
        return F.when((F.coalesce(t, F.lit(0)) != 0) & (F.coalesce(b, F.lit(0.0)) != 0), t >= b * fv.VOL_SPIKE_MULT)

    layers = {
        "volume_ok": spike("volume", "base_volume"),
        "money_ok": spike("turnover", "base_turnover"),
        "foreign_ok": F.when(F.col("foreign_week").isNotNull(), F.col("foreign_week") > 0),
        "accumulation_ok": F.when(F.col("i") >= fv.OBV_SLOPE_BARS, F.col("obv") > F.col("obv_back")),
    }
    out = features.withColumns(layers)
    score = sum(F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in layers)
    scored = sum(F.col(c).isNotNull().cast("int") for c in layers)
    return out.withColumn("score", score).withColumn("scored", scored)


def candidates(bars: DataFrame, min_history: int = fv.MIN_HISTORY, max_hold: int = fv.MAX_HOLD) -> DataFrame:
    """Every bar the rule would buy on if flat (before layer and regime tests), with its stop, target and exit.

    Only the crossover is tested on every bar.  The wide look-backs and the look-ahead are read, for the
    few bars that crossed, as slices of the symbol's own series (one element per session).
    """
    s = Series("symbol", "as_of")
    b = bars.select("symbol", "as_of", "price", F.col("volume").cast("double").alias("volume"), "turnover", "foreign_net",
                    s.index().alias("i"), s.ret("price").alias("ret"),
                    s.sma("price", 20).alias("fast"), s.sma("price", 50).alias("slow"))
    b = with_obv(b, s).withColumn("crossed", s.crossed_up("fast", "slow"))
    series = b.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(
        "i", "as_of", "price", "volume", "turnover", "foreign_net", "obv", "ret", "crossed"))).alias("_s"))
    hits = F.filter("_s", lambda x: (x["i"] >= min_history) & x["crossed"])
    # A hit stands at place `min_history` of its slice: all of its look-back is there, the look-ahead ends with the series.
    near = series.select("symbol", F.inline(F.transform(hits, lambda x: F.struct(
        x["i"].alias("i"), F.slice("_s", x["i"] - min_history + 2, min_history + max_hold).alias("_near")))))
    now = F.element_at("_near", min_history)

    def last(c, n, end=0):
        """The non-null values of the n bars that end `end` bars from the hit."""
        return F.filter(F.transform(F.slice("_near", min_history - n + 1 + end, n), lambda x: x[c]), lambda x: x.isNotNull())

    def prior(c):
        return median_of(F.filter(last(c, fv.FLOW_LOOKBACK, -1), lambda x: x != 0))

    # Values that later steps mention often come out of a generator, so they are worked out once.
    wide = near.select("symbol", "i", "_near", F.inline(F.array(F.struct(
        F.array_max(last("price", min_history)).alias("hi"), F.array_min(last("price", min_history)).alias("lo"),
        sample_deviation(last("ret", 59)).alias("sd"), last("foreign_net", 5).alias("_week")))))
    c = wide.select(
        "symbol", "i", *[now[x].alias(x) for x in ("as_of", "price", "volume", "turnover", "obv")], "hi", "lo", "sd",
        prior("volume").alias("base_volume"), prior("turnover").alias("base_turnover"),
        F.when(F.size("_week") >= 3, F.aggregate("_week", F.lit(0.0), lambda a, x: a + x)).alias("foreign_week"),
        F.element_at("_near", min_history - fv.OBV_SLOPE_BARS)["obv"].alias("obv_back"),
        F.transform(F.slice("_near", min_history + 1, max_hold), lambda x: F.struct(x["as_of"].alias("as_of"), x["price"].alias("price"))).alias("ahead"))
    upper_half = (F.col("hi") > F.col("lo")) & ((F.col("price") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) >= 0.5)
    c = confirmation_layers(c.where(upper_half & (F.col("sd") > 0)))
    risk = F.col("price") * F.col("sd") * fv.STOP_SD
    c = c.withColumn("stop", rnd(F.col("price") - risk, 1)).withColumn("target", rnd(F.col("price") + risk * fv.TARGET_R, 1))
    # Position (0-based, in bars after the entry) of the first close through either level.
    through = F.transform("ahead", lambda x, k: F.when((x["price"] <= F.col("stop")) | (x["price"] >= F.col("target")), k))
    first = F.array_min(through)
    k = F.coalesce(first, F.when(F.size("ahead") >= max_hold, F.lit(max_hold - 1)))
    c = c.withColumn("_k", k).withColumn("_x", F.when(F.col("_k").isNotNull(), F.get("ahead", F.col("_k"))))
    reason = (F.when(F.col("_x").isNull(), F.lit(None)).when(F.col("_x.price") <= F.col("stop"), "stop")
              .when(F.col("_x.price") >= F.col("target"), "target").otherwise("time"))
    return c.select(
        "symbol", "i", F.col("as_of").alias("entry_date"), F.col("price").alias("entry"), "stop", "target",
        (F.col("i") + F.col("_k") + 1).alias("exit_i"), F.col("_x.as_of").alias("exit_date"), F.col("_x.price").alias("exit"),
        reason.alias("reason"), "score", "scored",
        rnd(ratio("volume", "base_volume"), 2).alias("volume_x"), rnd(ratio("turnover", "base_turnover"), 2).alias("money_x"),
        rnd(F.col("turnover") / 1e9, 1).alias("money_bn"), rnd(F.col("foreign_week") / 1e9, 1).alias("foreign_bn"),
        *[f"{x}_ok" for x in LAYERS])


def walk_forward(cands: DataFrame, trend: DataFrame | None = None, variants: Sequence[tuple[str, int, bool]] =
                 (("rule", fv.MIN_LAYERS, False),)) -> DataFrame:
    """Trades of each variant (name, layers required, market filter applied).

    One position per symbol at a time; the bar that closes a position opens none.  A position still
    open ends its symbol's walk and comes out without an exit.  A day without a market reading blocks nothing.
    """
    c = cands
    if trend is not None:
        c = c.join(trend.select(F.col("as_of").alias("entry_date"), "rising"), "entry_date", "left")
    else:
        c = c.withColumn("rising", F.lit(None).cast("boolean"))
    v = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(k).alias("_need"), F.lit(g).alias("_gate")) for n, k, g in variants])
    c = c.select("*", F.inline(v)).where((F.col("score") >= F.col("_need")) & (~F.col("_gate") | F.coalesce("rising", F.lit(True))))
    cols = [x for x in cands.columns if x not in ("symbol", "i")]
    row = F.struct("i", *cols)
    g = c.groupBy("variant", "symbol").agg(F.array_sort(F.collect_list(row)).alias("_c"))
    start = F.struct(F.lit(-1).cast("long").alias("free_after"), F.filter("_c", lambda x: F.lit(False)).alias("taken"))
    never = F.lit(2 ** 62)
    walked = F.aggregate(
        "_c", start,
        lambda st, x: F.when(x["i"] > st["free_after"], F.struct(
            F.coalesce(x["exit_i"].cast("long"), never).alias("free_after"),
            F.concat(st["taken"], F.array(x)).alias("taken"))).otherwise(st),
        lambda st: st["taken"])
    return trade_metrics(g.select("variant", "symbol", F.inline(walked)))


def trade_metrics(trades: DataFrame, cost: float = fv.ROUND_TRIP_COST) -> DataFrame:
    """Result in units of risk, before and after round-trip costs. NULL while open or without risk."""
    risk = F.abs(F.col("entry") - F.col("stop"))
    r = ratio(F.col("exit") - F.col("entry"), risk)
    return trades.withColumn("r", r).withColumn("net", r - ratio(F.col("entry") * cost, risk))


def summary(trades: DataFrame, caps: DataFrame, group: Sequence[str] = ("variant",)) -> DataFrame:
    """Track record per group, in order of size, then symbol, then entry.

    Ranges of the order are drawn from a first pass over the trades, so these are written before.
    """
    closed = written(trades.where("r IS NOT NULL").select(*group, "symbol", "i", "reason", "r", "net")).where("r IS NOT NULL").join(caps.select("symbol", "cap"), "symbol", "left")
    t = track_record(closed, list(group), "symbol", "cap", "i")
    n, wins = F.col("n"), F.col("r_wins")
    losses = n - wins
    avg_win = F.coalesce(ratio("gain", wins), F.lit(0.0))
    avg_loss = F.coalesce(ratio("loss", losses), F.lit(0.0))
    hit = wins / n
    return t.select(
        *group, n.alias("trades"), rnd(hit * 100, 1).alias("hit_rate"), rnd(F.col("r_sum") / n, 3).alias("avg_r"),
        rnd("r_sum", 1).alias("total_r"), rnd("r_dd", 1).alias("max_drawdown_r"),
        F.when(wins > 0, rnd(avg_win, 2)).alias("avg_win_r"), rnd(avg_loss, 2).alias("avg_loss_r"),
        rnd(hit * avg_win + (1 - hit) * avg_loss, 3).alias("expectancy_r"),
        rnd(ratio("gain", F.abs("loss")), 2).alias("profit_factor"), F.col("streak").alias("worst_losing_streak"),
        rnd("net_sum", 1).alias("net_total_r"), rnd(F.col("net_sum") / n, 3).alias("net_avg_r"),
        rnd(F.col("net_wins") / n * 100, 1).alias("net_hit_rate"), rnd("net_dd", 1).alias("net_max_drawdown_r"),
        "stop", "target", "time")


LADDER = tuple((f"layers_{k}", k, False) for k in range(5)) + (("market_filter", fv.MIN_LAYERS, True),)


def benchmark(bars: DataFrame, universe: DataFrame | None = None, min_history: int = fv.MIN_HISTORY) -> DataFrame:
    """Median buy-and-hold change over the universe, and its span. One row a symbol is written, as several steps read it."""
    inside = bars if universe is None else bars.join(universe.select("symbol"), "symbol", "left_semi")
    g = inside.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("price", "as_of").alias("first"), F.max_by("price", "as_of").alias("last"),
        F.min("as_of").alias("start"), F.max("as_of").alias("end")).where(F.col("n") >= min_history)
    g = written(g.withColumn("change", ratio("last", "first") - 1).withColumn("_all", F.lit(1)))
    span = g.groupBy("_all").agg(F.count("change").alias("tickers"), F.min("start").alias("from"), F.max("end").alias("to"))
    mid = exact_quantiles(g, ["_all"], {"c": ("change", {"_mid": UPPER_MIDDLE})})
    return span.join(mid, "_all").select(rnd(F.col("_mid") * 100, 1).alias("median_return_pct"), "tickers", "from", "to")


def open_positions(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Positions without an exit, marked to the last close. They are few, read twice and so written."""
    live = written(trades.where("exit IS NULL"))
    marks = bars.join(live.select("variant", "symbol", "entry_date"), "symbol").groupBy("variant", "symbol").agg(
        F.max_by("price", "as_of").alias("_now"), F.max("as_of").alias("as_of"),
        F.count_if(F.col("as_of") >= F.col("entry_date")).alias("held"))
    return live.join(marks, ["variant", "symbol"]).select(
        "variant", "symbol", "entry_date", rnd("entry", 1).alias("entry"), "stop", "target", rnd("_now", 1).alias("now"),
        rnd(ratio(F.col("_now") - F.col("entry"), F.abs(F.col("entry") - F.col("stop"))), 2).alias("ur"), "held", "as_of",
        layer_digest().alias("layers"))


def layer_digest() -> Column:
    """Compact record of which layers agreed; a layer that abstained is absent from the JSON."""
    return F.to_json(F.struct(
        F.col("score").alias("n"), F.col("scored").alias("of"),
        F.when(F.col("volume_ok").isNotNull(), F.col("volume_x")).alias("v"),
        F.when(F.col("money_ok").isNotNull(), F.col("money_bn")).alias("m"),
        F.when(F.col("foreign_ok").isNotNull(), F.col("foreign_bn")).alias("f"),
        F.col("accumulation_ok").cast("int").alias("a")))
