"""Company dossier: ratio history, profile, owners, relations, events and headline statements per symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.numeric import rnd
from tidemark.operators.pit import latest, top_k
from tidemark.session import shared

META_SCHEMA = ("freeFloatPercentage double, maximumForeignPercentage double, averageMatchValue1Month double, "
               "icbCodeLv2 string, icbCodeLv4 string")


def metric_value(key: Column, value: Column) -> Column:
    """Published unit of a ratio; implausible values are withheld, not clamped."""
    percent = key.isin(fv.DOSSIER_PERCENT_KEYS)
    billions = key.isin(fv.DOSSIER_BILLION_KEYS)
    scaled = F.when(percent, value * 100).when(billions, value / 1e9).otherwise(value)
    signed = F.when(key == "cir", F.abs(scaled)).otherwise(scaled)
    sane = F.when(percent, signed.between(-500, 500)).when(billions, F.lit(True)).otherwise(signed.between(-100_000, 100_000))
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite & sane, rnd(signed, 3))


def ratio_points(fundamentals: DataFrame, keys: dict[str, str] = fv.DOSSIER_METRICS, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """(symbol, key, cadence, period, value): newest value per period, bounded tails, empty cadences dropped.

    A company's periods of one metric are bounded by its reporting calendar.
    """
    lookup = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    newest = latest(fundamentals.where(F.col("value").isNotNull() & F.col("metric").isin(list(keys))),
                    ["symbol", "period", "metric"], list(order))
    yearly = F.col("period").endswith("-Q5")
    pts = newest.select(
        "symbol", F.element_at(lookup, F.col("metric")).alias("key"), F.when(yearly, "y").otherwise("q").alias("cadence"),
        F.when(yearly, F.substring("period", 1, 4)).otherwise(F.col("period")).alias("period"), "value", "fetched_at",
    ).withColumn("value", metric_value(F.col("key"), F.col("value"))).where("value IS NOT NULL")
    w = Window.partitionBy("symbol", "key", "cadence")
    limit = F.when(F.col("cadence") == "y", fv.MAX_YEARS).otherwise(fv.MAX_QUARTERS)
    tail = pts.withColumn("_r", F.row_number().over(w.orderBy(F.col("period").desc()))).where(F.col("_r") <= limit)
    alive = tail.withColumn("_top", F.max(F.abs("value")).over(w)).where("_top > 0")
    return alive.select("symbol", "key", "cadence", "period", "value", "fetched_at")


def ratio_series(points: DataFrame) -> DataFrame:
    """Per symbol: map of key to its quarterly and yearly points in order, and the newest stamp."""
    def arr(c):
        return F.array_sort(F.collect_list(F.when(F.col("cadence") == c, F.struct("period", "value"))))

    per_key = points.groupBy("symbol", "key").agg(arr("q").alias("q"), arr("y").alias("y"), F.max("fetched_at").alias("as_of"))
    non_empty = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return per_key.groupBy("symbol").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct(non_empty("q"), non_empty("y")))))).alias("m"),
        F.max("as_of").alias("as_of"))


def company_facts(companies: DataFrame, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """Newest profile with the readable part of its JSON; a malformed document gives no facts rather than an error."""
    c = latest(companies, ["symbol"], list(order)).withColumn("_m", F.from_json("meta", META_SCHEMA))
    share = lambda n: F.when(F.col(f"_m.{n}").between(0, 1), rnd(F.col(f"_m.{n}"), 4))
    code = lambda n: F.when(F.length(F.trim(f"_m.{n}")) > 0, F.trim(f"_m.{n}"))
    return c.select(
        "symbol", F.col("short_name").alias("short"), "profile", "sector", F.col("company_type").alias("type"), F.col("listing_date").alias("listed"),
        F.col("state_percent").alias("state"), F.col("foreign_percent").alias("foreign"), "rating", F.col("target_price").alias("target"),
        "rating_as_of", "source", share("freeFloatPercentage").alias("ff"), share("maximumForeignPercentage").alias("fmax"),
        F.when(F.col("_m.averageMatchValue1Month") >= 0, rnd(F.col("_m.averageMatchValue1Month") / 1e9, 3)).alias("liq"),
        code("icbCodeLv2").alias("icb2"), code("icbCodeLv4").alias("icb4"))


def _largest(df: DataFrame, names: Sequence[str], share: str, k: int, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key, then the k largest shares of each symbol, in order, as an array of structs with the full count."""
    columns = dict.fromkeys([*key, *names, share, *order])
    newest = latest(df.select(*columns), key, list(order)).withColumn("pct", rnd(F.col(share) * 100, 3))
    newest = shared(newest.select(*dict.fromkeys([*key, *names]), "pct"))  # counted and ranked
    counts = newest.groupBy("symbol").agg(F.count(F.lit(1)).alias("count"))
    kept = top_k(newest, ["symbol"], [F.coalesce(F.when(F.col("pct") != 0, F.col("pct")), F.lit(-1.0)).desc(), *[F.col(c) for c in key[1:]]], k, "_r")
    rows = kept.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_r", *names, "pct"))).alias("_rows"))
    return rows.join(counts, "symbol").select("symbol", F.transform("_rows", lambda r: r.dropFields("_r")).alias("rows"), "count")


def owners(df: DataFrame, k: int = fv.MAX_OWNERS, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    return _largest(df, ["owner_name", "position_name", "owner_type", "quantity", "update_date"], "percentage", k,
                    ["symbol", "owner_name", "position_name"], order)


def relations(df: DataFrame, k: int = fv.MAX_RELATIONS, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    return _largest(df, ["related_code", "related_name", "relation_type"], "ownership_percent", k,
                    ["symbol", "related_name", "relation_type"], order)


def events(df: DataFrame, k: int = fv.MAX_EVENTS, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    names = ["event_code", "title", "public_date", "record_date", "exright_date"]
    newest = latest(df.select(*dict.fromkeys(["symbol", "event_id", *names, *order])), ["symbol", "event_id"], list(order))
    newest = shared(newest.select("symbol", "event_id", *names))  # counted and ranked
    counts = newest.groupBy("symbol").agg(F.count(F.lit(1)).alias("count"))
    kept = top_k(newest, ["symbol"], [F.col("public_date").desc_nulls_last(), F.col("event_id")], k, "_r")
    rows = kept.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_r", *names))).alias("_rows"))
    return rows.join(counts, "symbol").select("symbol", F.transform("_rows", lambda r: r.dropFields("_r")).alias("rows"), "count")


def statement_points(df: DataFrame, order: Sequence[str] = ("fetched_at",), core=tuple(fv.CORE_STATEMENT_FIELDS),
                     annual_only=tuple(fv.ANNUAL_STATEMENT_FIELDS)) -> DataFrame:
    """(symbol, field, statement, cadence, period, value in billions): headline lines only, some of them annual only."""
    newest = latest(df.where(F.col("field").isin([*core, *annual_only])), ["symbol", "period", "statement", "field"], list(order))
    cadence = F.when(F.col("period_type") == "year", "y").otherwise("q")
    pts = newest.withColumn("cadence", cadence).where("value IS NOT NULL").where(
        ~((F.col("cadence") == "q") & F.col("field").isin(list(annual_only))))
    limit = F.when(F.col("cadence") == "y", fv.MAX_YEARS).otherwise(fv.MAX_QUARTERS)
    w = Window.partitionBy("symbol", "field", "cadence").orderBy(F.col("period").desc(), F.col("statement").desc())
    return pts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).select(
        "symbol", "field", "statement", F.col("label_vi").alias("label"), "cadence", "period", rnd(F.col("value") / 1e9, 3).alias("value"), "public_date")


def statement_series(points: DataFrame) -> DataFrame:
    def arr(c):
        return F.array_sort(F.collect_list(F.when(F.col("cadence") == c, F.struct("period", "value"))))

    per_field = points.groupBy("symbol", "field").agg(
        F.min("label").alias("label"), F.min("statement").alias("section"), arr("q").alias("q"), arr("y").alias("y"),
        F.max_by("public_date", "period").alias("published"))
    return per_field.groupBy("symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "field", F.struct("label", "section", "q", "y", "published"))))).alias("st"))


def dossiers(listings: DataFrame, fundamentals: DataFrame, companies: DataFrame | None = None, owner_rows: DataFrame | None = None,
             relation_rows: DataFrame | None = None, event_rows: DataFrame | None = None, statements: DataFrame | None = None,
             fund_order: Sequence[str] = ("fetched_at",), order: Sequence[str] = ("fetched_at",), listing_order: Sequence[str] = ("fetched_at",),
             company_order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """One nested row per symbol with any ratio history; parts that were never collected stay NULL."""
    base = latest(listings.where("symbol IS NOT NULL"), ["symbol"], list(listing_order)).select(
        F.col("symbol").alias("s"), F.col("organ_name").alias("n"), F.col("exchange").alias("e"), F.col("industry").alias("i"))
    t = base.join(ratio_series(ratio_points(fundamentals, order=fund_order)).withColumnRenamed("symbol", "s"), "s")
    if companies is not None:
        co = company_facts(companies, company_order)
        t = t.join(co.select(F.col("symbol").alias("s"), F.struct(*[c for c in co.columns if c != "symbol"]).alias("co")), "s", "left")
    if owner_rows is not None:
        t = t.join(owners(owner_rows, order=order).select(F.col("symbol").alias("s"), F.col("rows").alias("owners")), "s", "left")
    if relation_rows is not None:
        t = t.join(relations(relation_rows, order=order).select(F.col("symbol").alias("s"), F.col("rows").alias("rel"), F.col("count").alias("rel_count")), "s", "left")
    if event_rows is not None:
        t = t.join(events(event_rows, order=order).select(F.col("symbol").alias("s"), F.col("rows").alias("events"), F.col("count").alias("events_count")), "s", "left")
    if statements is not None:
        t = t.join(statement_series(statement_points(statements, order)).withColumnRenamed("symbol", "s"), "s", "left")
    return t


def manifest(rows: DataFrame) -> DataFrame:
    have = lambda c: F.count_if(F.col(c).isNotNull()) if c in rows.columns else F.lit(0).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("count"), have("co").alias("dossiers"), have("st").alias("statements"))
