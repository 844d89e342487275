"""Capital-flow series: trailing window, running total and recent sums per asset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.numeric import rnd
from tidemark.operators.pit import latest
from tidemark.operators.rolling import Series


def observed_series(metrics: DataFrame, pattern: str, days: int = fv.FLOW_DAYS, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """Newest value per (series, as_of), inside the trailing window ending at the newest date of all matched series."""
    rows = latest(metrics.where(F.col("series").like(pattern)), ["series", "as_of"], list(order)).select("series", "as_of", "value")
    newest = metrics.where(F.col("series").like(pattern)).agg(F.max("as_of")).scalar()
    return rows.where(F.col("as_of") >= F.date_sub(newest, days))


def part(n: int):
    return F.split_part("series", F.lit("."), F.lit(n))


def net_flows(metrics: DataFrame, days: int = fv.FLOW_DAYS, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """Daily net flow per asset with its running total; one row per asset and day."""
    rows = observed_series(metrics, "etf.%.net_flow", days, order).select(part(2).alias("asset"), "as_of", rnd("value", 2).alias("v"))
    return rows.withColumn("cum", rnd(Series("asset", "as_of").cumulative("v"), 1))


def issuer_flows(metrics: DataFrame, days: int = fv.FLOW_DAYS, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """Issuers keep their own dates: a day one did not report stays absent."""
    rows = observed_series(metrics, "etf.%.flow.%", days, order)
    named = rows.where(F.size(F.split("series", r"\.")) >= 4).select(
        part(2).alias("asset"), F.upper(F.trim(part(4))).alias("issuer"), "as_of", rnd("value", 2).alias("v"))
    return named.where("issuer <> '' AND issuer <> 'TOTAL'")


def flow_stats(net: DataFrame, issuers: DataFrame) -> DataFrame:
    back = net.withColumn("back", Series("asset", "as_of").back())
    g = back.groupBy("asset").agg(
        F.count(F.lit(1)).alias("days"), F.max("as_of").alias("latest"), F.max(F.when(F.col("back") == 1, F.col("v"))).alias("latest_musd"),
        rnd(F.sum(F.when(F.col("back") <= 5, F.col("v"))), 1).alias("sum_5d"), rnd(F.sum(F.when(F.col("back") <= 20, F.col("v"))), 1).alias("sum_20d"))
    n = issuers.groupBy("asset").agg(F.count_distinct("issuer").alias("issuers"))
    return g.join(n, "asset", "left").withColumn("issuers", F.coalesce("issuers", F.lit(0)))


def flow_document(net: DataFrame, issuers: DataFrame) -> DataFrame:
    """Published shape: parallel arrays per asset, issuers nested with their own arrays (bounded by the window's days)."""
    def arrays(df, keys):
        pts = F.array_sort(F.collect_list(F.struct("as_of", "v", *(["cum"] if "cum" in df.columns else []))))
        return df.groupBy(*keys).agg(pts.alias("_p"))

    main = arrays(net, ["asset"]).select("asset", F.transform("_p", lambda x: x["as_of"]).alias("d"),
                                         F.transform("_p", lambda x: x["v"]).alias("v"), F.transform("_p", lambda x: x["cum"]).alias("cum"))
    inner = arrays(issuers, ["asset", "issuer"]).select("asset", "issuer", F.struct(
        F.transform("_p", lambda x: x["as_of"]).alias("d"), F.transform("_p", lambda x: x["v"]).alias("v")).alias("_s"))
    nested = inner.groupBy("asset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("issuer", "_s")))).alias("issuers"))
    return main.join(nested, "asset", "left")
