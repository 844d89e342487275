"""Listing lifetimes: price cuts, time on market, disappearance, reposts, broker share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.numeric import pct, ratio, rnd
from tidemark.operators.pit import latest
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.realestate import CELL
from tidemark.session import written


def sale_observations(observations: DataFrame, band=fv.PRICE_BAND, source: str = fv.SALE_SOURCE) -> DataFrame:
    return observations.where(
        (F.col("price") > 0) & (F.col("size_m2") > 0) & (F.col("source") == source) & F.col("price_per_m2").between(*band))


def lifetimes(observations: DataFrame) -> DataFrame:
    """One row per listing. The newest address wins: posters edit live ads."""
    def last(c):
        return F.expr(f"max_by({c}, fetched_at) FILTER (WHERE {c} IS NOT NULL)").alias(c)

    def edge(how, c, name):
        return F.expr(f"{how}({c}, fetched_at)").alias(name)

    return observations.groupBy("list_id").agg(
        last("region"), last("district"), last("category"),
        F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_seen"),
        F.count_distinct(F.to_date("fetched_at")).alias("days_seen"),
        edge("min_by", "price", "price_first"), edge("max_by", "price", "price_last"),
        edge("min_by", "size_m2", "size_first"), edge("max_by", "size_m2", "size_last"))


def crawl_calendar(observations: DataFrame, gone_after: int = fv.GONE_AFTER_CRAWLS) -> DataFrame:
    """Per (region, category): number of crawl days, the day a listing must have been seen since, the first day.

    The window runs over distinct days, so it is bounded by the calendar.
    """
    days = observations.select("region", "category", F.to_date("fetched_at").alias("day")).distinct()
    ranked = days.withColumn("recency", F.row_number().over(
        Window.partitionBy("region", "category").orderBy(F.col("day").desc())))
    return ranked.groupBy("region", "category").agg(
        F.max("recency").alias("crawl_days"), F.min(F.when(F.col("recency") <= gone_after, F.col("day"))).alias("gone_cutoff"),
        F.min("day").alias("first_crawl_day"))


def listing_panel(observations: DataFrame) -> DataFrame:
    """Lifetimes with their cell's crawl calendar."""
    return lifetimes(observations).join(crawl_calendar(observations), ["region", "category"])


def _log_bin(c: Column, tolerance: float) -> Column:
    """Bin index such that values within `tolerance` of each other are at most one bin apart."""
    import math

    width = -math.log(1 - tolerance) * 1.01
    return F.floor(F.ln(c) / F.lit(width)).cast("long")


def reposted(observations: DataFrame, days: int = fv.REPOST_DAYS, tolerance: float = fv.REPOST_TOLERANCE) -> DataFrame:
    """Ids of listings that vanished and came back: same cell, another ad first seen within `days` at a close size and price.

    A range join on three axes, kept off any pairwise product:
    - both sides are first reduced to distinct (cell, size, price, day) groups, so copies count once;
    - bins a little wider than the tolerance (and than `days`) turn the ranges into equality on
      neighbouring bins;
    - the match is a left-semi join, which stops at a row's first partner instead of listing them.
    A later first sight already implies a different listing.
    """
    life = lifetimes(observations.where("price > 0 AND size_m2 > 0")).where("region IS NOT NULL AND district IS NOT NULL AND category IS NOT NULL").select(
        "list_id", *CELL, "first_seen", "last_seen", F.col("size_last").alias("size"), F.col("price_last").alias("price"))
    life = written(life)  # one row a listing, read by both sides and by the answer
    sb, pb = _log_bin(F.col("size"), tolerance), _log_bin(F.col("price"), tolerance)
    span = days + 1

    def day_bin(d):
        return F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / F.lit(span)).cast("long")

    # Appearances: per group and day the last first-sight decides same-day order.
    b = life.withColumn("_day", F.to_date("first_seen")).groupBy(*CELL, "size", "price", "_day").agg(
        F.max("first_seen").alias("b_seen")
    ).select(*CELL, F.col("size").alias("b_size"), F.col("price").alias("b_price"), F.col("_day").alias("b_day"), "b_seen",
             sb.alias("_sb"), pb.alias("_pb"), day_bin("_day").alias("_db"))
    # Disappearances: per group and day the earliest last-sight suffices to find a partner for the group,
    # but each instant decides for itself on the same day, so instants stay distinct.
    a = life.select(*CELL, "size", "price", "last_seen").distinct().withColumn("_day", F.to_date("last_seen"))
    near = [F.explode(F.array(*[base + F.lit(i) for i in (-1, 0, 1)])) for base in (sb, pb)]
    probe = a.withColumn("_sb", near[0]).withColumn("_pb", near[1]).withColumn(
        "_db", F.explode(F.array(day_bin("_day"), day_bin("_day") + 1)))
    close = ((F.abs(b["b_size"] - probe["size"]) <= F.lit(tolerance) * probe["size"])
             & (F.abs(b["b_price"] - probe["price"]) <= F.lit(tolerance) * probe["price"])
             & (b["b_seen"] > probe["last_seen"]) & (F.datediff(b["b_day"], probe["_day"]) <= days))
    on = [probe[c] == b[c] for c in (*CELL, "_sb", "_pb", "_db")]
    cond = close
    for c in on:
        cond = cond & c
    back = probe.join(b, cond, "left_semi").select(*CELL, "size", "price", "last_seen").distinct()
    return life.join(back, [*CELL, "size", "price", "last_seen"], "left_semi").select("list_id")


def broker_share(observations: DataFrame, known_from=fv.AGENT_KNOWN_FROM, min_samples: int = fv.MIN_SAMPLES, source: str = fv.SALE_SOURCE) -> DataFrame:
    """Brokerage postings per cell, over observations recent enough to carry the flag; NULL there means an owner."""
    known = observations.where((F.col("source") == source) & (F.col("fetched_at") >= F.lit(known_from).cast("timestamp_ntz")))
    g = latest(known, ["list_id"], ["fetched_at"]).groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("agn"), F.count_if("is_agent").alias("broker_n"))
    return g.where(F.col("agn") >= min_samples).select(*CELL, pct("broker_n", "agn").alias("ag"), "agn")


def panel_metrics(panel: DataFrame, repeats: DataFrame, brokers: DataFrame | None = None, min_samples: int = fv.MIN_SAMPLES,
                  cut: float = fv.CUT_THRESHOLD, drift: float = fv.SIZE_DRIFT, min_crawls: int = fv.MIN_CRAWLS_FOR_GONE) -> DataFrame:
    """Per cell: cut rate and size, time on market with its truncated share, disappearance with and without reposts.

    `repeats`: ids from `reposted`.
    """
    same = (F.col("days_seen") > 1) & (F.abs(F.col("size_last") - F.col("size_first")) <= F.lit(drift) * F.col("size_first"))
    is_cut = same & (F.col("price_last") < F.col("price_first") * F.lit(1 - cut))
    change = (F.col("price_last") / F.col("price_first") - 1) * 100
    held = F.floor((F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp")))
                   / F.lit(86_400_000_000))
    gone = F.to_date("last_seen") < F.col("gone_cutoff")
    rows = (panel.join(repeats.distinct().withColumn("_back", F.lit(True)), "list_id", "left")
            .withColumn("_held", held).withColumn("_cut", F.when(is_cut, change)).withColumn("_gone", gone))
    # One row a listing, read by the counts and by both passes of the medians.
    rows = written(rows.select(*CELL, same.alias("_same"), is_cut.alias("_is_cut"), "first_seen", "first_crawl_day", "crawl_days",
                               "_held", "_cut", "_gone", "_back"))
    same, is_cut = F.col("_same"), F.col("_is_cut")
    g = rows.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(same).alias("pcn"), F.count_if(is_cut).alias("_cuts"),
        F.count_if(F.to_date("first_seen") <= F.col("first_crawl_day")).alias("_trunc"),
        F.max("crawl_days").alias("_crawls"), F.count_if("_gone").alias("_goners"),
        F.count_if(F.col("_gone") & F.col("_back").isNull()).alias("_still"),
    ).where(F.col("_n") >= min_samples)
    mid = exact_quantiles(rows, CELL, {"held": ("_held", {"_dm": 0.5}), "cut": ("_cut", {"_pcm": 0.5})})
    measured = F.col("_crawls") >= min_crawls
    out = g.join(mid, CELL).select(
        *CELL, "pcn", pct("_cuts", "pcn").alias("pc"), rnd("_pcm", 1).alias("pcm"), F.floor("_dm").alias("dm"),
        pct("_trunc", "_n").alias("dmc"), F.when(measured, pct("_goners", "_n")).alias("gr"),
        F.when(measured, F.col("_n")).alias("grn"), F.when(measured, pct("_still", "_n")).alias("grx"))
    return out if brokers is None else out.join(brokers, CELL, "left")


def panel_totals(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("pcn"), F.lit(0)).alias("repeat_observed"),
                       F.count("gr").alias("cells_with_gone_rate"))
