"""Asking prices against state land prices, street by street within a district."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.numeric import ratio, rnd
from tidemark.functions.text import cell_key, street_key
from tidemark.operators.pit import latest
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.realestate import with_current_province


def state_streets(land_prices: DataFrame) -> DataFrame:
    """One state price per street: the median of its segments' newest prices."""
    newest = latest(land_prices.where("price_residential > 0"), ["province", "street_key", "segment"], ["fetched_at"])
    keys = ["province", "district", "street_key"]
    docs = newest.groupBy(*keys).agg(F.expr("max_by(source_doc, fetched_at) FILTER (WHERE source_doc IS NOT NULL)").alias("doc"))
    prices = exact_quantiles(newest, keys, {"p": ("price_residential", {"state_vnd_m2": 0.5})})
    return prices.join(docs, keys)


def asking_streets(observations: DataFrame, band=fv.PRICE_BAND, source: str = fv.SALE_SOURCE, min_key: int = fv.MIN_STREET_KEY) -> DataFrame:
    newest = latest(observations.where(
        (F.col("source") == source) & F.col("street_name").isNotNull() & F.col("price_per_m2").between(*band)), ["list_id"], ["fetched_at"])
    keyed = newest.select("region", "district", "price_per_m2", street_key("street_name").alias("street_key")).where(
        F.length("street_key") > min_key)
    keys = ["region", "district", "street_key"]
    n = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("ask_n"))
    return exact_quantiles(keyed, keys, {"p": ("price_per_m2", {"_ask": 0.5})}).join(n, keys).select(
        *keys, (F.col("_ask") * 1e6).alias("ask_vnd_m2"), "ask_n")


def matched_streets(observations: DataFrame, land_prices: DataFrame, band=fv.RATIO_BAND, **asking) -> DataFrame:
    """Streets both sides know. The district must agree: street names repeat across districts."""
    joined = asking_streets(observations, **asking).join(state_streets(land_prices), ["street_key", "district"])
    return joined.withColumn("ratio", ratio("ask_vnd_m2", "state_vnd_m2")).where(F.col("ratio").between(*band))


def district_ratios(matched: DataFrame, min_streets: int = fv.MIN_STREETS, dimension: DataFrame | None = None) -> DataFrame:
    """District medians and where each stands against its province. A district's streets are few, each one row."""
    half = F.lit(0.5)
    g = matched.groupBy("region", "district").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.percentile("ratio", half), 2).alias("rr"),
        rnd(F.percentile("ask_vnd_m2", half) / 1e6, 1).alias("ask"), rnd(F.percentile("state_vnd_m2", half) / 1e6, 1).alias("st"),
        F.min_by("doc", F.struct("street_key", "province")).alias("doc")).where(F.col("n") >= min_streets)
    rows = with_current_province(g, "region", dimension)
    peers = rows.groupBy("rs").agg(F.percentile("rr", half).alias("_peer"))
    return rows.join(peers, "rs").select(
        cell_key("region", "district").alias("slug"), F.col("district").alias("d"), F.col("region").alias("r"), "rs",
        "rr", "n", "ask", "st", "doc", rnd("_peer", 2).alias("rm"), rnd(ratio("rr", "_peer"), 2).alias("rp"))


def province_coverage(land_prices: DataFrame) -> DataFrame:
    return land_prices.groupBy("province").agg(
        F.count_distinct("street_key").alias("streets"), F.max("source_doc").alias("doc"))
