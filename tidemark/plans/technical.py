"""Bar features for any timeframe: averages, Wilder strength, efficiency, width, channels, breakouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.numeric import ratio
from tidemark.operators.rolling import Series

SERIES = ["asset", "seconds"]


def malformed() -> Column:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    bad_number = F.lit(False)
    for x in (o, h, l, c):
        bad_number = bad_number | x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(bad_number | F.col("time").isNull() | (l <= 0) | (h < F.greatest(o, c)) | (l > F.least(o, c)), F.lit(True))


def series_health(bars: DataFrame, now_ms, continuous: bool = True, min_bars: int = fv.GATE["min_bars"]) -> DataFrame:
    """Per series: closed bars, and why it must not be used (NULL when fine)."""
    s = Series(SERIES, "time")
    closed = closes_at() <= F.lit(now_ms)
    marked = bars.select(*SERIES, "time", malformed().alias("_bad"), closed.alias("_closed"),
                         (F.col("time") - s.lag("time")).alias("_gap"))
    g = marked.groupBy(*SERIES).agg(
        F.count_if("_closed").alias("count"), F.count_if("_bad").alias("_nbad"), F.count_if(F.col("_gap") == 0).alias("_dups"),
        F.count_if(F.col("_closed") & (F.col("_gap") != F.col("seconds"))).alias("_gaps"))
    problem = F.when((F.col("_nbad") > 0) | (F.col("_dups") > 0), "malformed").when(F.col("count") < min_bars, "short")
    if continuous:
        problem = problem.when(F.col("_gaps") > 0, "gaps")
    return g.select(*SERIES, "count", problem.alias("problem"))


def closes_at() -> Column:
    """A bar counts from its exclusive close onwards."""
    return (F.col("time") + F.col("seconds")) * 1000


def _last(values: Column, n: int) -> Column:
    """The last n elements, or all of a shorter array."""
    return F.slice(values, F.greatest(F.size(values) - (n - 1), F.lit(1)), n)


def _mean(values: Column, n: int) -> Column:
    return F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x) / F.lit(float(n))


def _smoothed_tail(values: Column, n: int, alpha: float, keep: int) -> Column:
    """Last `keep` values of the smoothing seeded with the mean of the first n; the state stays that short."""
    rest = F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))
    return F.aggregate(rest, F.array(_mean(values, n)), lambda acc, x: F.slice(F.concat(acc, F.array(
        F.element_at(acc, -1) + F.lit(alpha) * (x - F.element_at(acc, -1)))), F.greatest(-F.size(acc) - 1, F.lit(-keep)), keep))


def _adx(plus: Column, minus: Column, n: int = 14) -> Column:
    """Smoothed directional index, all in one pass over the movements."""
    a = 1.0 / n

    def dx(p, m):
        return F.when(p + m != 0, 100 * F.abs(p - m) / F.nullif(p + m, F.lit(0.0))).otherwise(F.lit(0.0))

    p0, m0 = _mean(plus, n), _mean(minus, n)
    start = F.struct(p0.alias("p"), m0.alias("m"), F.lit(1).alias("k"), dx(p0, m0).alias("adx"))

    def step(s, x):
        p = s["p"] + a * (x["plus"] - s["p"])
        m = s["m"] + a * (x["minus"] - s["m"])
        d = dx(p, m)
        k = s["k"] + 1
        # The first n indices are averaged (kept as a running sum), later ones smoothed.
        value = (F.when(k < n, s["adx"] + d).when(k == n, (s["adx"] + d) / F.lit(float(n)))
                 .otherwise(s["adx"] + a * (d - s["adx"])))
        return F.struct(p.alias("p"), m.alias("m"), k.alias("k"), value.alias("adx"))

    moves = F.arrays_zip(plus.alias("plus"), minus.alias("minus"))
    return F.aggregate(F.slice(moves, n + 1, F.greatest(F.size(plus) - n, F.lit(0))), start, step, lambda s: s["adx"])


def features(bars: DataFrame, now_ms, continuous: bool = True, min_bars: int = fv.GATE["min_bars"]) -> DataFrame:
    """One row per usable series at an instant; bars still forming then change nothing.

    A series has one element per time step, so folding it as an array is bounded by the calendar.
    """
    health = series_health(bars, now_ms, continuous, min_bars)
    s = Series(SERIES, "time")
    b = bars.where(closes_at() <= F.lit(now_ms)).withColumn("_pc", s.lag("close")).withColumn("_ph", s.lag("high")).withColumn("_pl", s.lag("low"))
    up, down = F.col("high") - F.col("_ph"), F.col("_pl") - F.col("low")
    w20, prior20 = s.rows(-19), s.rows(-20, -1)
    b = b.select(
        *SERIES, "time", "open", "high", "low", "close",
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc"))).alias("tr"),
        F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)).alias("plus"),
        F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)).alias("minus"),
        F.abs(F.col("close") - F.col("_pc")).alias("_move"), s.lag("close", 20).alias("_c20"),
        F.when(F.count(F.lit(1)).over(w20) >= 20, 4 * F.stddev_pop("close").over(w20) / F.avg("close").over(w20)).alias("width"),
        F.max("high").over(prior20).alias("upper"), F.min("low").over(prior20).alias("lower"))
    b = b.withColumn("_path", F.sum("_move").over(w20)).withColumn(
        "er", F.coalesce(ratio(F.abs(F.col("close") - F.col("_c20")), "_path"), F.lit(0.0)))
    g = b.groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct(
        "time", "open", "high", "low", "close", "tr", "plus", "minus", "width", "upper", "lower", "er"))).alias("_s"))
    g = g.join(health.where("problem IS NULL").select(*SERIES, "count"), SERIES)

    def field(name, skip=0):
        arr = F.slice("_s", 1 + skip, F.greatest(F.size("_s") - skip, F.lit(0))) if skip else F.col("_s")
        return F.transform(arr, lambda x: x[name])

    # Folds are materialised once by the generator below instead of once per mention.
    once = g.select(*SERIES, "count", F.inline(F.array(F.struct(
        F.element_at("_s", -1).alias("_b"), _last(F.col("_s"), 13).alias("_tail"),
        _smoothed_tail(field("close"), 20, 2 / 21, 6).alias("_e20"), _smoothed_tail(field("close"), 50, 2 / 51, 1).alias("_e50"),
        _smoothed_tail(field("tr", 1), 14, 1 / 14, 14).alias("_atr"), _adx(field("plus", 1), field("minus", 1)).alias("adx"),
        _last(F.filter(field("width"), lambda w: w.isNotNull()), 251).alias("_widths")))))
    last20, last50, atr = F.element_at("_e20", -1), F.element_at("_e50", -1), F.element_at("_atr", -1)
    slope = (last20 - F.get("_e20", F.lit(0))) / F.when(atr != 0, atr).otherwise(F.lit(1.0))
    current = F.element_at("_widths", -1)
    reference = F.slice("_widths", 1, F.greatest(F.size("_widths") - 1, F.lit(0)))
    f = once.select(
        *SERIES, "count", ((F.col("_b.time") + F.col("seconds")) * 1000).alias("closed_at"), F.col("_b.close").alias("close"),
        F.col("_b.open").alias("open"), F.col("_b.high").alias("high"), F.col("_b.low").alias("low"),
        last20.alias("ema20"), last50.alias("ema50"), atr.alias("atr"), "adx", F.col("_b.er").alias("er"), slope.alias("slope"),
        (100.0 * F.size(F.filter(reference, lambda w: w <= current)) / F.nullif(F.size(reference), F.lit(0))).alias("width_pct"),
        F.col("_b.upper").alias("upper"), F.col("_b.lower").alias("lower"), "_tail", "_atr", "_b")
    up_trend = (F.col("close") > F.col("ema20")) & (F.col("ema20") > F.col("ema50")) & (F.col("slope") > fv.GATE["slope"])
    down_trend = (F.col("close") < F.col("ema20")) & (F.col("ema20") < F.col("ema50")) & (F.col("slope") < -fv.GATE["slope"])
    f = f.withColumn("direction", F.when(up_trend, 1).when(down_trend, -1).otherwise(0))
    for d, name in ((1, "up"), (-1, "down")):
        f = f.withColumn(f"breakout_{name}", _breakout(d))
    return f.drop("_tail", "_atr", "_b")


def _breakout(d: int) -> Column:
    """Newest bar of the last 13 closing beyond its own prior channel; its level and range stay frozen."""
    level = "upper" if d == 1 else "lower"
    # The newest 13 bars, newest first, with the range each had; a bar before the first range has none.
    pairs = F.zip_with(F.reverse("_tail"), F.reverse(_last(F.col("_atr"), 13)), lambda x, a: F.struct(
        x["time"].alias("time"), x["close"].alias("close"), x[level].alias("level"), a.alias("atr")))
    hits = F.filter(pairs, lambda x: d * (x["close"] - x["level"]) > fv.GATE["breakout"] * x["atr"])
    hit = F.get(hits, F.lit(0))
    retest = fv.GATE["retest"]
    later_lost = F.exists("_tail", lambda x: (x["time"] > hit["time"]) & (d * (x["close"] - hit["level"]) < -retest * hit["atr"]))
    b = F.col("_b")
    touch = (b["low"] <= hit["level"] + retest * hit["atr"]) if d == 1 else (b["high"] >= hit["level"] - retest * hit["atr"])
    reclaim = (d * (b["close"] - hit["level"]) > fv.GATE["breakout"] * hit["atr"]) & (d * (b["close"] - b["open"]) > 0)
    fresh = hit["time"] == b["time"]
    return F.when(F.size(hits) > 0, F.struct(
        hit["level"].alias("level"), hit["atr"].alias("atr"), ((hit["time"] + F.col("seconds")) * 1000).alias("at"),
        fresh.alias("fresh"), (~fresh & touch & reclaim & ~later_lost).alias("retest"), later_lost.alias("invalid")))
