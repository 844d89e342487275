"""Landed property ads: JSON to observation rows, code dictionaries, crawl checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import parsing
from tidemark.functions.numeric import ratio, rnd
from tidemark.schemas import conform

AD_SCHEMA = """list_id bigint, list_time bigint, orig_list_time bigint, region_name string, area_name string, ward_name string,
 category_name string, house_type string, price double, size double, price_million_per_m2 double, rooms int, latitude double,
 longitude double, street_name string, subject string, property_legal_document int, body string, company_ad string, account_name string,
 account_oid string, toilets string, direction string, floornumber string, ward_name_v3 string, region_name_v3 string,
 number_of_images string, thumbnail_image string, state string, status string, price_string string, area_v2 string, region_v2 string, ward string"""


def listing_rows(landed: DataFrame, json: str = "json", lane: str = "lane", fetched_at: str = "fetched_at") -> DataFrame:
    """Landed ads (JSON text, lane code, retrieval time) as listing observations.

    A missing price per m2 is computed; a field the source left out stays NULL, never zero or false.
    """
    ad = landed.withColumn("_a", F.from_json(json, AD_SCHEMA)).select("_a.*", F.col(lane).alias("_lane"), F.col(fetched_at).alias("fetched_at"))
    computed = ratio(F.col("price") / 1e6, F.when(F.col("size") != 0, F.col("size")))
    rows = ad.select(
        "list_id", F.concat(F.lit("chotot:"), F.col("_lane")).alias("source"),
        F.coalesce(parsing.epoch_ms("list_time"), F.col("fetched_at").cast("timestamp")).alias("as_of"), "fetched_at",
        F.col("region_name").alias("region"), F.col("area_name").alias("district"), F.col("ward_name").alias("ward"),
        F.col("category_name").alias("category"), "house_type", "price", F.col("size").alias("size_m2"),
        F.coalesce("price_million_per_m2", F.when(F.col("price") != 0, computed)).alias("price_per_m2"), "rooms", "latitude", "longitude",
        "street_name", "subject", F.col("property_legal_document").alias("legal_doc"), "body", parsing.boolean("company_ad").alias("is_agent"),
        "account_name", "account_oid", parsing.integer("toilets").alias("toilets"), "direction", parsing.integer("floornumber").alias("floors"),
        F.col("ward_name_v3").alias("ward_v3"), F.col("region_name_v3").alias("region_v3"), parsing.epoch_ms("orig_list_time").alias("orig_list_time"),
        parsing.integer("number_of_images").alias("image_count"), F.col("thumbnail_image").alias("thumbnail"), "state", "status", "price_string",
        parsing.integer("area_v2").alias("area_v2"), parsing.integer("region_v2").alias("region_v2"), parsing.integer("ward").alias("ward_v2"))
    return conform(rows, "re_listing")


def known_codes(seen_now: DataFrame, remembered: DataFrame) -> DataFrame:
    """Codes as a floor: everything ever seen, the newest name of each (code, name, seen_at)."""
    return seen_now.unionByName(remembered).groupBy("code").agg(F.max_by("name", "seen_at").alias("name"), F.max("seen_at").alias("seen_at"))


def unseen_codes(remembered: DataFrame, crawled: DataFrame) -> DataFrame:
    return remembered.select("code").subtract(crawled.select("code"))


def crawl_shortfalls(expected: DataFrame, rows: DataFrame, key: str = "region", cap: int = fv.PROVINCE_TOTAL_CAP, share: float = fv.SHORTFALL_SHARE) -> DataFrame:
    """Regions whose rows fall well below what the source itself reported (`status` short), and those whose
    reported total is at the source's own ceiling and so no real count (`status` source total saturated)."""
    got = rows.groupBy(key).agg(F.count(F.lit(1)).alias("got"))
    t = expected.join(got, key, "left").withColumn("got", F.coalesce("got", F.lit(0)))
    status = F.when(F.col("expected") >= cap, "source total saturated").when((F.col("expected") > 0) & (F.col("got") < F.col("expected") * share), "short")
    return t.withColumn("status", status).where("status IS NOT NULL")


def load_profile(rows: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Busiest districts, and one row with the share of repeated ids."""
    by_district = rows.groupBy("region", "district").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "region", "district").limit(top)
    n, ids = F.count(F.lit(1)), F.count_distinct("list_id")
    totals = rows.agg(n.alias("rows"), ids.alias("unique_list_ids"), rnd(1 - ids / F.nullif(n, F.lit(0)), 4).alias("duplicate_rate"))
    return by_district, totals
