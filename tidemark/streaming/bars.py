"""Bars from ticks as event-time windows: only closed bars come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_bars(ticks: DataFrame, seconds: int, delay: str = "10 minutes", key: str = "asset", ts: str = "ts", price: str = "price", volume: str = "volume") -> DataFrame:
    """Open, high, low, close and volume per window.

    In append mode a window is emitted once the watermark passes its exclusive end, so a forming bar
    is never seen; the longer timeframe is built from ticks as well, not from the shorter one.
    Works on a static frame too, where every window comes out. Ticks of one instant count in order of price.
    """
    w = F.window(F.col(ts), f"{seconds} seconds")
    g = ticks.withWatermark(ts, delay).groupBy(F.col(key), w.alias("w")).agg(
        F.min_by(price, F.struct(ts, price)).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, F.struct(ts, price)).alias("close"), F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("ticks"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("closed_at"), "open", "high", "low", "close", "volume", "ticks")


def sliding_totals(events: DataFrame, size: str = "24 hours", slide: str = "1 hour", delay: str = "10 minutes", key: str = "asset", ts: str = "ts", value: str = "value") -> DataFrame:
    """Rolling turnover: sums over overlapping windows."""
    g = events.withWatermark(ts, delay).groupBy(F.col(key), F.window(F.col(ts), size, slide).alias("w")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "n")


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) bars; rejected ones carry why. The same test on a stream or a table."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    missing = o.isNull() | h.isNull() | l.isNull() | c.isNull()
    why = (F.when(missing, "missing").when(l <= 0, "not positive").when((h < F.greatest(o, c)) | (l > F.least(o, c)), "inverted"))
    marked = bars.withColumn("problem", why)
    return marked.where("problem IS NULL").drop("problem"), marked.where("problem IS NOT NULL")
