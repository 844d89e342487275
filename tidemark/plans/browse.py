"""Browsable listing inventory: live, sane and consistent ads, newest first, per district."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.numeric import rnd
from tidemark.functions.text import category_slug, cell_key
from tidemark.operators.pit import top_k
from tidemark.plans.realestate import fresh_listings, with_current_province


def inventory(observations: DataFrame, band=fv.PRICE_BAND, source: str = fv.SALE_SOURCE, stale_after: int = fv.STALE_AFTER_DAYS,
              tolerance: float = fv.CONSISTENCY_TOLERANCE) -> DataFrame:
    """Status and lane are tested after the newest observation is known, so an older active row cannot slip through."""
    live = fresh_listings(observations, stale_after, "price_per_m2 IS NOT NULL AND size_m2 > 0 AND price > 0")
    implied = F.col("price") / 1e6 / F.col("size_m2")
    return live.where(
        (F.col("source") == source) & F.col("price_per_m2").between(*band)
        & (F.col("status").isNull() | (F.col("status") == "active"))
        & (F.abs(implied / F.col("price_per_m2") - 1) <= tolerance))


def optional(df: DataFrame, name: str, type_: str):
    return F.col(name) if name in df.columns else F.lit(None).cast(type_)


def browse_rows(rows: DataFrame, per_district: int = fv.MAX_PER_DISTRICT, link: str = "https://www.nhatot.com/{}.htm") -> DataFrame:
    """The newest ads of each district as published rows; absent keys stay NULL and are left out of the JSON."""
    kept = top_k(rows.where("region IS NOT NULL AND district IS NOT NULL"), ["region", "district"], ["as_of", "list_id"], per_district)
    nonzero = lambda name: F.when(optional(rows, name, "int") != 0, optional(rows, name, "int"))
    located = (F.coalesce("latitude", F.lit(0.0)) != 0) & (F.coalesce("longitude", F.lit(0.0)) != 0)
    age = F.floor((F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("orig_list_time").cast("timestamp")))
                  / F.lit(86_400_000_000))
    head, tail = link.split("{}")
    return kept.select(
        cell_key("region", "district").alias("k"), "region", "district",
        F.col("list_id").alias("id"), F.col("subject").alias("t"), rnd(F.col("price") / 1e9, 3).alias("tp"),
        rnd("price_per_m2", 1).alias("p"), rnd("size_m2", 1).alias("sz"),
        F.coalesce(optional(rows, "ward_v3", "string"), F.col("ward")).alias("w"), F.col("street_name").alias("st"),
        category_slug("category", F.lit("khac")).alias("c"), F.to_date("as_of").alias("d"),
        F.concat(F.lit(head), F.col("list_id").cast("string"), F.lit(tail)).alias("u"),
        nonzero("rooms").alias("r"), nonzero("toilets").alias("wc"), nonzero("floors").alias("fl"),
        optional(rows, "direction", "string").alias("dir"), F.col("legal_doc").alias("lg"),
        F.when(F.col("is_agent"), 1).when(F.col("account_name") != "", 0).alias("ag"),
        nonzero("image_count").alias("im"),
        F.when(located, rnd("latitude", 5)).alias("lat"), F.when(located, rnd("longitude", 5)).alias("lon"),
        F.when(age > 0, age).alias("age"))


def shard_index(rows: DataFrame, thin_below: int = fv.THIN_SAMPLE, dimension: DataFrame | None = None) -> DataFrame:
    """One row per district shard."""
    g = rows.groupBy("k").agg(F.min("region").alias("region"), F.min("district").alias("district"), F.count(F.lit(1)).alias("n"))
    return with_current_province(g, "region", dimension).select(
        "k", F.col("district").alias("d"), F.col("region").alias("r"), "rs", "n", (F.col("n") < thin_below).cast("int").alias("thin"))
