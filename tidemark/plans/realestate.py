"""Robust price statistics per cell (region, district, category) from repeated listing observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.numeric import cagr_percent, col, pct, ratio, rnd
from tidemark.functions.text import category_slug, cell_key, slug
from tidemark.operators.pit import latest
from tidemark.session import written
from tidemark.operators.quantiles import clip_between, exact_quantiles

CELL = ["region", "district", "category"]


def fresh_listings(observations: DataFrame, stale_after: int = fv.STALE_AFTER_DAYS, usable: str | None =
                   "price_per_m2 IS NOT NULL AND size_m2 > 0", order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """Newest observation of every listing still seen by its own cell's recent crawls.

    Age counts from the cell's last crawl, never from today: a crawl that failed ages nothing out.
    """
    crawl = observations.groupBy("region", "category").agg(F.max("fetched_at").alias("cell_crawled_at"))
    newest = latest(observations if usable is None else observations.where(usable), ["list_id"], list(order))
    return newest.join(crawl, ["region", "category"]).where(
        F.datediff("cell_crawled_at", "fetched_at") <= stale_after)


def collapse_reposts(listings: DataFrame, order: Sequence[str | Column] = ("fetched_at",), extra_keys: Sequence[str] = (),
                     price_unit: float = 1e6) -> DataFrame:
    """One row per property: same cell and lane, same rounded size and price; the newest stays."""
    keyed = listings.withColumn("_size", F.round("size_m2")).withColumn("_price", F.round(F.col("price") / price_unit))
    kept = latest(keyed, [*extra_keys, *CELL, "source", "_size", "_price"], [*order, "list_id"] if all(
        isinstance(o, str) for o in order) else list(order))
    return kept.drop("_size", "_price")


def lane(listings: DataFrame, source: str, band: tuple[float, float]) -> DataFrame:
    """One lane inside its sanity band: sale and rent never mix."""
    return listings.where((F.col("source") == source) & F.col("price_per_m2").between(*band))


def cell_statistics(observations: DataFrame, min_samples: int = fv.MIN_SAMPLES, band=fv.PRICE_BAND, source: str = fv.SALE_SOURCE,
                    stale_after: int = fv.STALE_AFTER_DAYS, price_unit: float = 1e6) -> DataFrame:
    """Freshness, repost collapse, band, 5-95 % clip, then sample size, quartiles, size, price and age per cell."""
    usable = collapse_reposts(fresh_listings(observations, stale_after), price_unit=price_unit)
    return clipped_statistics(lane(usable, source, band), min_samples)


def clipped_statistics(rows: DataFrame, min_samples: int, keys: Sequence[str] = tuple(CELL)) -> DataFrame:
    keys = list(keys)
    # Cleaned rows are read by the bounds and the clip, clipped ones by the counts and the medians.
    clipped = written(clip_between(written(rows), keys, "price_per_m2", fv.CLIP_LOW, fv.CLIP_HIGH))
    age = F.greatest(F.lit(0), F.datediff("fetched_at", "as_of"))
    counts = clipped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"),
        F.max("fetched_at").alias("updated_at")).where(F.col("n") >= min_samples)
    medians = exact_quantiles(clipped, keys, {
        "ppm2": ("price_per_m2", {"median_ppm2": 0.5, "p25_ppm2": 0.25, "p75_ppm2": 0.75}),
        "size": ("size_m2", {"median_size": 0.5}),
        "price": ("price", {"median_price": 0.5}),
        "age": (age, {"median_age": 0.5}),
    })
    return counts.join(medians, keys)


def lane_statistics(observations: DataFrame, min_samples: int = fv.MIN_SAMPLES, sale: str = fv.SALE_SOURCE, rent: str = fv.RENT_SOURCE,
                    sale_band=fv.PRICE_BAND, rent_band=fv.RENT_BAND, stale_after: int = fv.STALE_AFTER_DAYS,
                    price_unit: float = 1e6) -> DataFrame:
    """Sale statistics with the rent leg beside them, both lanes cleaned in one pass with the lane as a key."""
    usable = collapse_reposts(fresh_listings(observations, stale_after), price_unit=price_unit)
    rows = usable.where(((F.col("source") == sale) & F.col("price_per_m2").between(*sale_band))
                        | ((F.col("source") == rent) & F.col("price_per_m2").between(*rent_band)))
    both = clipped_statistics(rows, min_samples, ["source", *CELL])
    is_sale = F.col("source") == sale
    names = [c for c in both.columns if c not in ("source", *CELL)]
    return both.groupBy(*CELL).agg(
        *[F.max(F.when(is_sale, F.col(c))).alias(c) for c in names],
        F.max(F.when(~is_sale, F.col("median_ppm2"))).alias("rent_ppm2"), F.max(F.when(~is_sale, F.col("n"))).alias("rent_n"),
    ).where("n IS NOT NULL")


def rent_statistics(observations: DataFrame, min_samples: int = fv.MIN_SAMPLES, band=fv.RENT_BAND, source: str = fv.RENT_SOURCE,
                    stale_after: int = fv.STALE_AFTER_DAYS, price_unit: float = 1e6) -> DataFrame:
    """The rent leg, cleaned by the same rules as the sale leg."""
    rows = lane(collapse_reposts(fresh_listings(observations, stale_after), price_unit=price_unit), source, band)
    return clipped_median(rows, CELL, min_samples).select(*CELL, F.col("median_ppm2").alias("rent_ppm2"), F.col("n").alias("rent_n"))


def clipped_median(rows: DataFrame, keys: Sequence[str], min_samples: int) -> DataFrame:
    # Cleaned rows are read by the bounds and the clip, clipped ones by the counts and the medians.
    clipped = written(clip_between(written(rows), keys, "price_per_m2", fv.CLIP_LOW, fv.CLIP_HIGH))
    n = clipped.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples)
    return n.join(exact_quantiles(clipped, keys, {"p": ("price_per_m2", {"median_ppm2": 0.5})}), list(keys))


def daily_history(observations: DataFrame, min_samples: int = fv.MIN_SAMPLES, band=fv.PRICE_BAND, source: str = fv.SALE_SOURCE,
                  price_unit: float = 1e6) -> DataFrame:
    """Clipped median per cell and crawl day. No freshness rule: each day stands alone."""
    daily = observations.where("price_per_m2 IS NOT NULL AND size_m2 > 0").withColumn("day", F.to_date("fetched_at"))
    newest = latest(daily, ["day", "list_id"], ["fetched_at"])
    kept = collapse_reposts(newest, order=["list_id"], extra_keys=["day"], price_unit=price_unit)
    return clipped_median(lane(kept, source, band), ["day", *CELL], min_samples)


def growth(history: DataFrame, min_points: int = fv.CAGR_MIN_POINTS, min_days: int = fv.CAGR_MIN_DAYS) -> DataFrame:
    """Annualised growth per cell, NULL while the history is short or the number implausible."""
    g = history.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("points"), F.datediff(F.max("day"), F.min("day")).alias("hd"),
        F.min_by("median_ppm2", "day").alias("_first"), F.max_by("median_ppm2", "day").alias("_last"))
    return g.select(*CELL, "points", cagr_percent("_first", "_last", "hd", "points", min_points, min_days).alias("g"), "hd")


def valuation_label(cells: DataFrame, value: str = "y", peers: Sequence[str] = ("category",)) -> DataFrame:
    """Yield against the median of its peers. Runs over published cells, one row each."""
    peer = cells.groupBy(*peers).agg(F.percentile(value, F.lit(0.5)).alias("_peer"))
    y, m = F.col(value), F.col("_peer")
    label = (F.when((F.coalesce(m, F.lit(0.0)) == 0) | (F.coalesce(y, F.lit(0.0)) == 0), F.lit(None))
             .when(y >= m * fv.CHEAP_FACTOR, "cheap").when(y <= m * fv.RICH_FACTOR, "rich").otherwise("fair"))
    return cells.join(peer, list(peers), "left").withColumn("v", label).drop("_peer")


def province_dimension(spark) -> DataFrame:
    """Former region slug -> current province (a fixed list, so its size is known)."""
    rows = [(name, former) for name, olds in fv.PROVINCES for former in olds]
    rows += [("Hồ Chí Minh", "tp-ho-chi-minh"), ("Hồ Chí Minh", "thanh-pho-ho-chi-minh")]
    return spark.createDataFrame(rows, "province string, former string").select("province", slug("former").alias("key"))


def region_lookup_key(region) -> Column:
    """Slug without an administrative prefix."""
    key = slug(region)
    for prefix in fv.PROVINCE_PREFIXES:
        key = F.regexp_replace(key, f"^{prefix}", "")
    return key


def with_current_province(df: DataFrame, region: str = "region", dimension: DataFrame | None = None, out: str = "rs") -> DataFrame:
    """Adds the current province; an unknown region keeps its own name."""
    dim = province_dimension(df.sparkSession) if dimension is None else dimension
    joined = df.withColumn("_key", region_lookup_key(region)).join(
        dim.select(F.col("key").alias("_key"), F.col("province").alias("_province")), "_key", "left")
    return joined.withColumn(out, F.coalesce("_province", col(region))).drop("_key", "_province")


def published_cells(stats: DataFrame, history: DataFrame | None = None, panel: DataFrame | None = None,
                    dimension: DataFrame | None = None) -> DataFrame:
    """The cell table: rounded statistics, yield, growth, panel metrics and the valuation label.

    `stats` comes from `lane_statistics`.
    """
    t = stats
    if history is not None:
        t = t.join(growth(history).drop("points"), CELL, "left")
    else:
        t = t.withColumn("g", F.lit(None).cast("double")).withColumn("hd", F.lit(0))
    if panel is not None:
        t = t.join(panel, CELL, "left")
    t = with_current_province(t, "region", dimension)
    located = (F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lon", F.lit(0.0)) != 0)
    panel_cols = [c for c in (panel.columns if panel is not None else []) if c not in CELL]
    cells = t.select(
        cell_key("region", "district").alias("slug"), *CELL, "rs", category_slug("category").alias("cs"),
        rnd("median_ppm2", 1).alias("p"), rnd("p25_ppm2", 1).alias("p25"), rnd("p75_ppm2", 1).alias("p75"),
        rnd("median_size", 0).alias("sz"), rnd(F.col("median_price") / 1e9, 2).alias("tp"), rnd("median_age", 0).alias("age"),
        "n", F.col("updated_at").alias("u"),
        F.when(located, rnd("lat", 5)).alias("lat"), F.when(located, rnd("lon", 5)).alias("lon"),
        rnd(ratio(F.col("rent_ppm2") * 12, "median_ppm2") * 100, 2).alias("y"), F.col("rent_n").alias("yn"),
        "g", F.coalesce("hd", F.lit(0)).alias("hd"), *panel_cols)
    return valuation_label(cells)


def province_cards(cells: DataFrame, provinces: DataFrame) -> DataFrame:
    """Per (province, category) medians of the cell medians; provinces without data appear with zero rows.

    `provinces`: one row per province (`rs`). A median of medians cannot be rolled up, so it is taken over cells.
    """
    g = cells.groupBy("rs", "cs").agg(
        rnd(F.percentile("p", F.lit(0.5)), 1).alias("p"), rnd(F.percentile("y", F.lit(0.5)), 2).alias("y"),
        F.sum("n").alias("n"), F.count_distinct("region", "district").alias("d"), F.count(F.lit(1)).alias("rows"))
    return provinces.select("rs").join(g, "rs", "left").select(
        "rs", "cs", "p", "y", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("d", F.lit(0)).alias("d"),
        F.coalesce("rows", F.lit(0)).alias("rows"))


def corpus_totals(observations: DataFrame, stale_after: int = fv.STALE_AFTER_DAYS, sale: str = fv.SALE_SOURCE) -> DataFrame:
    """One row: observations, listings, days, span, legal coverage, and what the freshness rule removes."""
    raw = observations.agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("list_id").alias("listings"),
        F.count_distinct(F.to_date("fetched_at")).alias("snapshot_days"), F.min("fetched_at").alias("history_from"),
        F.max("fetched_at").alias("history_to"),
        F.count_if((F.col("source") == sale) & F.col("legal_doc").isNotNull()).alias("legal_doc_rows"),
        F.count_if(F.col("source") == sale).alias("_sale"))
    crawl = observations.groupBy("region", "category").agg(F.max("fetched_at").alias("cell_crawled_at"))
    newest = latest(observations, ["list_id"], ["fetched_at"]).join(crawl, ["region", "category"])
    fresh = newest.agg(F.count_if(F.datediff("cell_crawled_at", "fetched_at") <= stale_after).alias("fresh_listings"),
                       F.count(F.lit(1)).alias("_all"))
    return raw.crossJoin(F.broadcast(fresh)).select(                  # two one-row frames
        "observations", "listings", "snapshot_days", "history_from", "history_to", "legal_doc_rows",
        rnd(F.lit(100.0) * F.col("legal_doc_rows") / F.greatest("_sale", F.lit(1)), 1).alias("legal_doc_pct"),
        "fresh_listings", (F.col("_all") - F.col("fresh_listings")).alias("aged_out"),
        rnd(F.lit(100.0) * (F.col("_all") - F.col("fresh_listings")) / F.greatest("_all", F.lit(1)), 1).alias("aged_out_pct"))
