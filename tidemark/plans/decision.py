"""Gated verdicts from two timeframes and a live quote, and context facts with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.numeric import rnd
from tidemark.operators.pit import asof_latest

_NEEDED = ("close", "atr", "adx", "er", "slope", "ema20", "ema50", "closed_at", "upper", "lower")


_UNUSABLE = "break level unusable"


def _finite(c: Column) -> Column:
    x = c.cast("double")
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def verdicts(inputs: DataFrame, features: DataFrame, min_bars: int = fv.GATE["min_bars"], assets=tuple(fv.GATE_ASSETS),
             fast_seconds: int = 3600, slow_seconds: int = 14400) -> DataFrame:
    """One verdict per input (asset, now, source_kind, price, quote_at, error, clock_ok): the first rule that speaks wins."""
    def side(seconds, tag):
        f = features.where(F.col("seconds") == seconds)
        return f.select("asset", F.struct(*[c for c in f.columns if c != "asset"]).alias(tag))

    t = inputs.join(side(fast_seconds, "h1"), "asset", "left").join(side(slow_seconds, "h4"), "asset", "left")
    gate = fv.GATE
    now, price, at = F.col("now"), F.col("price"), F.col("quote_at")

    def sane(tag):
        f = F.col(tag)
        ok = f.isNotNull()
        for c in _NEEDED:
            ok = ok & _finite(f[c])
        return F.coalesce(ok & (f["atr"] > 0) & (f["count"] >= min_bars) & f["adx"].between(0, 100) & f["er"].between(0, 1), F.lit(False))

    def stale(tag, seconds):
        f = F.col(tag)
        return (f["closed_at"] > now) | (now - f["closed_at"] >= seconds * 1000)

    d = F.col("h4.direction")
    br = F.when(d == 1, F.col("h1.breakout_up")).otherwise(F.col("h1.breakout_down"))
    t = t.withColumn("_d", d).withColumn("_br", br).withColumn("_line", F.col("_br.level") - F.col("_d") * gate["retest"] * F.col("_br.atr"))
    d, br, line = F.col("_d"), F.col("_br"), F.col("_line")
    h1, h4 = F.col("h1"), F.col("h4")
    distance = d * (price - br["level"]) / F.nullif(br["atr"], F.lit(0.0))
    weak = lambda f: (f["adx"] < gate["adx"]) | (f["er"] < gate["er"])
    no_quote = ~_finite(price) | ~_finite(at) | (price <= 0) | (at > now + 5000) | (now - at > gate["quote_age_ms"])
    unusable_mark = ~_finite(br["level"]) | ~_finite(br["atr"]) | ~_finite(br["at"]) | (br["atr"] <= 0) | (br["level"] <= 0) | (br["at"] > h1["closed_at"])
    far = (distance > gate["chase"]) | (F.abs(price - h1["close"]) > 0.5 * h1["atr"]) | (F.abs(price - h1["ema20"]) > 2 * h1["atr"])
    rules = [
        (~F.col("asset").isin(list(assets)) | now.isNull(), "DATA", "unknown asset or no clock"),
        (~F.coalesce(F.col("clock_ok"), F.lit(True)) & (F.col("asset") != "XAU"), "DATA", "clock not verified"),
        (F.col("error").isNotNull(), "DATA", "source error"),
        ((F.col("asset") == "XAU") & (F.coalesce("source_kind", F.lit("")) != "broker-xauusd"), "DATA", "needs the broker's own quote"),
        (F.col("source_kind").isNull() | ~sane("h1") | ~sane("h4"), "DATA", "missing quote or closed bars"),
        (stale("h1", fast_seconds) | stale("h4", slow_seconds), "DATA", "bars stale or ahead of time"),
        (no_quote, "DATA", "quote not fresh"),
        (((d == 0) | weak(h4)) & F.coalesce(h1["width_pct"] <= 20, F.lit(False)), "COMPRESSION", "compressed, no strong slow trend"),
        ((d == 0) | weak(h4), "RANGE", "no strong slow trend"),
        ((h1["direction"] != d) | weak(h1), "ALIGNMENT", "fast frame disagrees or is weak"),
        (br.isNull() | br["invalid"] | ~(br["fresh"] | br["retest"]), "WAIT_BREAK", "trend, waiting for a break or a confirmed retest"),
        (unusable_mark, "DATA", _UNUSABLE),
        (d * (price - line) <= 0, "INVALID", "price lost the confirmation level"),
        (far, "EXTENDED", "price ran away, wait for a retest"),
        (distance < gate["breakout"], "WAIT_RECLAIM", "price not yet outside the level"),
    ]
    setup = reason = None
    for cond, name, why in rules:
        c = F.coalesce(cond, F.lit(True))
        setup = F.when(c, name) if setup is None else setup.when(c, name)
        reason = F.when(c, why) if reason is None else reason.when(c, why)
    t = t.withColumn("setup", setup.otherwise(F.when(br["fresh"], "BREAKOUT").otherwise("PULLBACK"))).withColumn(
        "reason", reason.otherwise("aligned entry"))
    entered = F.col("setup").isin("BREAKOUT", "PULLBACK")
    marked = entered | F.col("setup").isin("INVALID", "EXTENDED", "WAIT_RECLAIM")
    action = F.when(entered & (d == 1), "BUY").when(entered & (d == -1), "SELL").otherwise("WAIT")
    # The slow direction is known once bars and quote are sound, also where only the break level is not.
    unsound = (F.col("setup") == "DATA") & (F.col("reason") != _UNUSABLE)
    direction = F.when(unsound, 0).otherwise(d)
    return t.select("asset", "now", F.lit(fv.GATE_VERSION).alias("version"), action.alias("action"), "setup", "reason",
                    direction.alias("direction"), F.when(marked, br["level"]).alias("level"), F.when(marked, line).alias("invalidation"))


def fact_status(facts: DataFrame) -> DataFrame:
    """Status of each fact (value, observed, fetched, ttl_ms, bias) at `now`: zero is data, absence is not.

    Both the observation and its retrieval must lie in the past and inside the time to live, so a new
    retrieval cannot refresh an old observation.
    """
    o, f, now = (F.unix_millis(F.col(c).cast("timestamp")) for c in ("observed", "fetched", "now"))
    ttl = F.col("ttl_ms")
    status = (F.when(o.isNull() | f.isNull() | F.col("value").isNull(), "missing").when((o > now) | (f > now), "future")
              .when((now - o > ttl) | (now - f > ttl), "stale").otherwise("ok"))
    return facts.withColumn("status", status).withColumn("bias", F.when(F.col("status") == "ok", F.col("bias")).otherwise(F.lit(0)))


def dollar_bias(last: Column, previous: Column, at_least: float = fv.DOLLAR_MOVE_PERCENT) -> Column:
    """A dollar move of a fifth of a percent or more weighs against the asset."""
    move = (last / F.nullif(previous, F.lit(0.0)) - 1) * 100
    return F.when(F.abs(move) >= at_least, -F.signum(move).cast("int")).otherwise(F.lit(0))


def context_spec(spark) -> DataFrame:
    """(asset, label, ttl_ms): which facts an asset is judged with and how long they hold."""
    rows = [(asset, label, ttl) for label, (assets, ttl) in fv.CONTEXT.items() for asset in assets]
    return spark.createDataFrame(rows, "asset string, label string, ttl_ms long")


def _observation(df: DataFrame, label: str, value: Column, bias: Column, asset: Column | None = None) -> DataFrame:
    """Observations of one label; without an asset of their own they speak of every asset of the label."""
    assets = F.array(*[F.lit(a) for a in fv.CONTEXT[label][0]])
    named = df.withColumn("_asset", F.explode(assets)) if asset is None else df.withColumn("_asset", asset).where(F.array_contains(assets, F.col("_asset")))
    return named.select(F.col("_asset").alias("asset"), F.lit(label).alias("label"), value.cast("double").alias("value"),
                        F.col("observed").cast("timestamp").alias("observed"), F.col("fetched").cast("timestamp").alias("fetched"),
                        F.coalesce(bias, F.lit(0)).cast("int").alias("bias"))


def daily_closes(closes: DataFrame, code: str) -> DataFrame:
    """A series' newest daily closes (code, observed, fetched, close), each with the close of the day before it."""
    one = closes.where(F.col("code") == code)
    return one.withColumn("previous", F.lag("close").over(Window.partitionBy("code").orderBy("observed")))


def dollar_facts(closes: DataFrame) -> DataFrame:
    """The dollar index: its move against the close before; without one there is no value."""
    d = daily_closes(closes, "dxy")
    known = F.col("previous").isNotNull() & (F.col("previous") != 0)
    return _observation(d, "dollar", F.when(known, F.col("close")), dollar_bias(F.col("close"), F.col("previous")))


def gold_facts(closes: DataFrame) -> DataFrame:
    """The gold future as a reference only: it never weighs on a side."""
    d = daily_closes(closes, "gold")
    return _observation(d, "gold_future", F.when(F.col("previous").isNotNull() & (F.col("previous") != 0), F.col("close")), F.lit(0))


def etf_facts(flows: DataFrame, days: int = 5) -> DataFrame:
    """Published fund flows (asset, observed, fetched, net): the sum of the last days says the side, a zero is a value."""
    last = Window.partitionBy("asset").orderBy("observed").rowsBetween(-(days - 1), 0)
    f = flows.where(_finite(F.col("net"))).withColumn("_sum", F.sum("net").over(last))
    return _observation(f, "etf_flow", F.col("_sum"), F.signum("_sum").cast("int"), F.col("asset"))


def gamma_facts(surfaces: DataFrame) -> DataFrame:
    """Net dealer gamma (asset, observed, contracts, net_gamma) where there are contracts; its sign is a model's assumption, so no side."""
    s = surfaces.withColumn("fetched", F.col("observed"))
    return _observation(s, "dealer_gamma", F.when(F.coalesce(F.col("contracts") > 0, F.lit(False)) & _finite(F.col("net_gamma")), F.col("net_gamma")), F.lit(0), F.col("asset"))


def sentiment_facts(readings: DataFrame) -> DataFrame:
    """Sentiment readings (observed, fetched, value)."""
    return _observation(readings, "sentiment", F.when(_finite(F.col("value")), F.col("value")), F.lit(0))


def mvrv_facts(readings: DataFrame) -> DataFrame:
    """Valuation readings (observed, fetched, value)."""
    return _observation(readings, "mvrv", F.col("value"), F.lit(0))


def facts_as_known(probes: DataFrame, observations: DataFrame, keys=("asset", "label"), ttl_ms: int | None = 86_400_000) -> DataFrame:
    """Context at each probe's `now`: the newest observation retrieved by then, with its status.

    With `ttl_ms` None the probes bring the time to live of their label.
    """
    known = asof_latest(probes, observations, list(keys), "now", "fetched", ["value", "observed", "bias"], tie=["observed", "value"])
    known = known.withColumnRenamed("fetched_found", "fetched")
    return fact_status(known if ttl_ms is None else known.withColumn("ttl_ms", F.lit(ttl_ms)))


def context_facts(instants: DataFrame, observations: DataFrame) -> DataFrame:
    """Every fact of its asset's context at each instant (asset, now), also those that nobody has observed: they are missing."""
    probes = instants.join(F.broadcast(context_spec(instants.sparkSession)), "asset")
    return facts_as_known(probes, observations, ttl_ms=None)


def counter_facts(verdict: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that speak against a verdict (asset, now, direction): sound ones with a side, the opposite one."""
    spoken = facts.where("status = 'ok' AND bias <> 0").select("asset", "now", "label", "value", "bias")
    return verdict.select("asset", "now", "direction").join(spoken, ["asset", "now"]).where(F.col("bias") == -F.col("direction"))
