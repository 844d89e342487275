"""Landed company, ratio, statement, coin and feed documents to observation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import parsing
from tidemark.functions.numeric import denan, finite, ratio, rnd
from tidemark.session import written
from tidemark.functions.text import blank_to_null, strip_tags, trim_sentences
from tidemark.operators.pit import top_k
from tidemark.schemas import conform


def ratio_rows(records: DataFrame, fields: dict[str, str] = fv.RATIO_FIELDS) -> DataFrame:
    """Quarterly ratio records (symbol, year, quarter, one column per field) to the long panel."""
    have = {src: metric for src, metric in fields.items() if src in records.columns}
    wide = records.where("year <> 0 AND quarter <> 0").select(
        "symbol", parsing.quarter_label("year", "quarter").alias("period"), "fetched_at",
        *[F.col(src).cast("string").try_cast("double").alias(metric) for src, metric in have.items()])
    return wide.unpivot(["symbol", "period", "fetched_at"], list(have.values()), "metric", "value").where("value IS NOT NULL").select(
        "symbol", "period", "metric", "value", "fetched_at")


def period_columns_rows(table: DataFrame) -> DataFrame:
    """A metric per row and a period per column, as long rows; period columns are those named like 2026-Q2."""
    periods = [c for c in table.columns if "-Q" in c]
    wide = table.select("symbol", F.trim("metric").alias("metric"), "fetched_at", *[F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in periods])
    return wide.unpivot(["symbol", "metric", "fetched_at"], [f"`{c}`" for c in periods], "period", "value").where("value IS NOT NULL AND metric <> ''")


_META = ("analyst", "averageMatchValue1Month", "averageMatchVolume1Month", "highestPrice1Year", "lowestPrice1Year", "maximumForeignPercentage",
         "freeFloat", "freeFloatPercentage", "icbCodeLv2", "icbCodeLv4")


def _text(c: str) -> Column:
    return blank_to_null(strip_tags(c))


def _number(c: str) -> Column:
    return finite(parsing.number(c))


def profile_rows(landed: DataFrame) -> DataFrame:
    """Company profiles (symbol, JSON document, fetched_at)."""
    p = landed.withColumn("_d", F.from_json("json", "map<string,string>")).where(F.size("_d") > 0)
    d = lambda k: F.try_element_at("_d", F.lit(k))
    meta = F.to_json(F.map_filter("_d", lambda k, v: k.isin(list(_META)) & v.isNotNull()))
    return conform(p.select(
        "symbol", d("viOrganName").alias("organ_name"), d("viOrganShortName").alias("short_name"), _text(d("profile")).alias("profile"),
        F.coalesce(d("sectorVn"), d("sector")).alias("sector"), d("comTypeCode").alias("company_type"), parsing.flexible_date(d("listingDate")).alias("listing_date"),
        _number(d("statePercentage")).alias("state_percent"), _number(d("foreignerPercentage")).alias("foreign_percent"), d("rating").alias("rating"),
        _number(d("targetPrice")).alias("target_price"), parsing.flexible_date(d("ratingAsOf")).alias("rating_as_of"), F.lit("Vietcap").alias("source"), "fetched_at",
        meta.alias("meta")), "eq_company")


def owner_rows(landed: DataFrame) -> DataFrame:
    schema = "array<struct<ownerName: string, positionName: string, ownerType: string, quantity: string, percentage: string, updateDate: string>>"
    x = landed.select("symbol", "fetched_at", F.inline(F.from_json("json", schema))).withColumn("owner_name", _text(F.col("ownerName"))).where("owner_name IS NOT NULL")
    return conform(x.select("symbol", "owner_name", F.coalesce(_text(F.col("positionName")), F.lit("")).alias("position_name"), F.col("ownerType").alias("owner_type"),
                            _number(F.col("quantity")).cast("long").alias("quantity"), _number(F.col("percentage")).alias("percentage"),
                            parsing.flexible_date("updateDate").alias("update_date"), "fetched_at"), "eq_owner")


def relationship_rows(landed: DataFrame) -> DataFrame:
    """Two arrays of one document become one tagged table."""
    item = "array<struct<rightOrganNameVi: string, rightOrganNameEn: string, rightTicker: string, rightOrganCode: string, ownedPercentage: string>>"
    d = landed.withColumn("_d", F.from_json("json", f"subsidiaries {item}, affiliates {item}"))
    both = d.select("symbol", "fetched_at", F.lit("subsidiary").alias("relation_type"), F.inline("_d.subsidiaries")).unionByName(
        d.select("symbol", "fetched_at", F.lit("affiliate").alias("relation_type"), F.inline("_d.affiliates")))
    name = _text(F.coalesce(F.nullif("rightOrganNameVi", F.lit("")), F.col("rightOrganNameEn")))
    return conform(both.withColumn("related_name", name).where("related_name IS NOT NULL").select(
        "symbol", F.coalesce(F.nullif("rightTicker", F.lit("")), F.col("rightOrganCode")).alias("related_code"), "related_name", "relation_type",
        _number(F.col("ownedPercentage")).alias("ownership_percent"), "fetched_at"), "eq_relationship")


def event_rows(landed: DataFrame) -> DataFrame:
    item = ("id string, eventCode string, eventTitleVi string, eventNameVi string, eventDescVi string, descriptionVi string, publicDate string, displayDate1 string, "
            "recordDate string, exrightDate string, exerciseRatio string, cashDividendPercentage string, stockDividendPercentage string, issuePrice string, category string")
    fields = ", ".join(f"{p.split()[0]}: {p.split()[1]}" for p in item.split(", "))
    x = landed.select("symbol", "fetched_at", F.inline(F.from_json("json", f"content array<struct<{fields}>>")["content"])).where(F.length(F.trim("id")) > 0)
    meta = F.to_json(F.struct("eventNameVi", "exerciseRatio", "cashDividendPercentage", "stockDividendPercentage", "issuePrice", "category"))
    return conform(x.select(
        "symbol", F.trim("id").alias("event_id"), F.col("eventCode").alias("event_code"), _text(F.coalesce("eventTitleVi", "eventNameVi")).alias("title"),
        _text(F.coalesce("eventDescVi", "descriptionVi")).alias("description"), parsing.flexible_date(F.coalesce("publicDate", "displayDate1")).alias("public_date"),
        parsing.flexible_date("recordDate").alias("record_date"), parsing.flexible_date("exrightDate").alias("exright_date"), "fetched_at", meta.alias("meta")), "eq_event")


def statement_rows(records: DataFrame, fields: DataFrame) -> DataFrame:
    """Financial statements (symbol, section, statement, period_type, JSON record) limited to the lines the form declares.

    `fields`: symbol, section, field, titleVi, titleEn, level.  A zero counts only because the form lists the line.
    """
    r = records.withColumn("_r", F.from_json("json", "map<string,string>"))
    year, length = parsing.integer(F.try_element_at("_r", F.lit("yearReport"))), parsing.integer(F.try_element_at("_r", F.lit("lengthReport")))
    r = r.withColumn("_y", year).withColumn("_q", F.coalesce(length, F.lit(0))).where(
        F.col("_y").isNotNull() & ((F.col("period_type") == "year") | F.col("_q").between(1, 4)))
    period = F.when(F.col("period_type") == "year", F.col("_y").cast("string")).otherwise(parsing.quarter_label("_y", "_q"))
    long = r.select("symbol", "section", "statement", "period_type", period.alias("period"), "fetched_at",
                    parsing.flexible_date(F.try_element_at("_r", F.lit("publicDate"))).alias("public_date"), F.explode("_r").alias("field", "_v"))
    return conform(long.join(fields, ["symbol", "section", "field"]).withColumn("value", _number(F.col("_v"))).where("value IS NOT NULL").select(
        "symbol", "period", "period_type", "statement", "field", F.col("titleVi").alias("label_vi"), F.col("titleEn").alias("label_en"), "level", "value", "public_date",
        "fetched_at"), "eq_statement")


# --- coins ----------------------------------------------------------------------------------

def board_24h(raw: DataFrame, min_turnover: float = fv.MIN_TURNOVER_USD, pegged=tuple(fv.PEGGED)) -> DataFrame:
    """24-hour board of dollar-quoted pairs that are neither pegged nor illiquid."""
    n = parsing.number
    b = raw.where(F.col("symbol").endswith("USDT")).select(
        F.expr("substring(symbol, 1, length(symbol) - 4)").alias("s"), n("lastPrice").alias("p"), n("priceChangePercent").alias("chp"), n("quoteVolume").alias("_t"),
        n("highPrice").alias("h"), n("lowPrice").alias("l"), n("count").alias("_n"))
    b = b.where((F.col("s") != "") & ~F.col("s").isin(list(pegged)) & (F.col("p") != 0) & (F.col("_t") >= min_turnover))
    return b.select("s", "p", "chp", rnd(F.col("_t") / 1e6, 2).alias("v"), "h", "l",
                    F.when(F.col("h") > F.col("l"), rnd((F.col("p") - F.col("l")) / F.nullif(F.col("h") - F.col("l"), F.lit(0.0)) * 100, 0)).alias("pos"),
                    F.when(F.col("_n") != 0, F.col("_n").cast("long")).alias("t"), F.nullif(rnd(ratio("_t", "_n"), 0), F.lit(0.0)).alias("avg"))


def turnover_series(board: DataFrame, at, source: str = "board_24h") -> DataFrame:
    return board.select(F.concat(F.lit("crypto."), "s", F.lit(".turnover_musd")).alias("series"), F.lit(at).alias("as_of"), F.col("v").alias("value"),
                        F.lit(source).alias("source"), F.lit(at).alias("fetched_at"))


def latest_and_change(points: DataFrame, keys, order: str, value: str, back: int = 7) -> DataFrame:
    """Newest level of each series and its change against `back` points earlier; NULL where that is missing or zero."""
    ends = top_k(points, list(keys), [order], back + 1, "_r")
    g = ends.groupBy(*keys).agg(F.max(F.when(F.col("_r") == 1, F.col(value))).alias("level"), F.max(F.when(F.col("_r") == back + 1, F.col(value))).alias("_prior"))
    return g.where("level IS NOT NULL").select(*keys, "level", rnd((ratio("level", "_prior") - 1) * 100, 2).alias("change"))


def sentiment_summary(readings: DataFrame, keys=("source",), days: int = 7) -> DataFrame:
    """Newest reading of each source and the mean of its last seven; readings (as_of, value as text) that are no whole number do not count."""
    whole = readings.where(F.coalesce(F.col("value").rlike(r"^\d+$"), F.lit(False))).withColumn("_v", F.col("value").cast("long"))
    last = top_k(whole, list(keys), ["as_of"], days, "_r")
    return last.groupBy(*keys).agg(F.max(F.when(F.col("_r") == 1, F.col("_v"))).alias("value"), F.max("as_of").alias("as_of"),
                                   rnd(F.avg("_v"), 0).cast("long").alias("mean_7d"))


def failed_sources(expected: DataFrame, answered: DataFrame, key: str = "source") -> DataFrame:
    """Sources that were asked and gave nothing usable: named, so that a missing section is not read as a zero."""
    return expected.select(key).distinct().join(answered.select(key).distinct(), key, "left_anti")


COIN_SCHEMA = """id string, name string, market_cap_rank int, description struct<en: string>, categories array<string>, links struct<homepage: array<string>>, genesis_date string,
 market_data struct<market_cap: struct<usd: double>, fully_diluted_valuation: struct<usd: double>, total_volume: struct<usd: double>, circulating_supply: double,
 max_supply: double, total_supply: double, ath: struct<usd: double>, ath_change_percentage: struct<usd: double>, ath_date: struct<usd: string>, atl: struct<usd: double>,
 atl_date: struct<usd: string>, price_change_percentage_7d: double, price_change_percentage_30d: double, price_change_percentage_1y: double>"""


def coin_profiles(landed: DataFrame, description_chars: int | None = None, max_categories: int | None = None) -> DataFrame:
    """Coin documents (symbol, JSON) flattened; names that announce a superseded token are dropped.

    Descriptions and category lists are whole; a publisher that wants them shorter names the limits.
    """
    c = landed.withColumn("_d", F.from_json("json", COIN_SCHEMA)).where(F.length("_d.name") > 0)
    dead = F.lit(False)
    for marker in fv.DEAD_MARKERS:
        dead = dead | F.contains(F.lower("_d.name"), F.lit(marker))
    m = lambda p: F.col(f"_d.market_data.{p}")
    named = F.filter("_d.categories", lambda x: F.length(x) > 0)
    day = lambda p: blank_to_null(F.substring(m(p), 1, 10))
    return c.where(~dead).select(
        "symbol", F.col("_d.name").alias("name"), F.col("_d.id").alias("id"), F.col("_d.market_cap_rank").alias("rank"), trim_sentences("_d.description.en", description_chars).alias("description"),
        (named if max_categories is None else F.slice(named, 1, max_categories)).alias("categories"), blank_to_null(F.get("_d.links.homepage", F.lit(0))).alias("home"),
        m("market_cap.usd").alias("mc"), m("fully_diluted_valuation.usd").alias("fdv"), m("total_volume.usd").alias("vol"), m("circulating_supply").alias("supply"),
        m("max_supply").alias("max_supply"), m("total_supply").alias("total_supply"), m("ath.usd").alias("ath"), m("ath_change_percentage.usd").alias("ath_pct"),
        day("ath_date.usd").alias("ath_date"), m("atl.usd").alias("atl"), day("atl_date.usd").alias("atl_date"), m("price_change_percentage_7d").alias("d7"),
        m("price_change_percentage_30d").alias("d30"), m("price_change_percentage_1y").alias("d1y"), F.col("_d.genesis_date").alias("genesis"))


def symbol_ids(ranked: DataFrame) -> DataFrame:
    """Symbol to id: the best ranked coin carrying a symbol owns it."""
    return ranked.where("symbol <> '' AND id <> ''").groupBy(F.upper("symbol").alias("symbol")).agg(F.min_by("id", "rank").alias("id"))


def identity_check(profiles: DataFrame, board: DataFrame, band=fv.UNIT_BAND) -> DataFrame:
    """Capitalisation over supply must be near the traded price, else the symbol resolved to another coin."""
    t = profiles.join(board.where("p > 0").select(F.col("s").alias("symbol"), F.col("p").alias("quoted")), "symbol", "left")
    share = ratio(ratio("mc", F.when(F.col("supply") != 0, F.col("supply"))), "quoted")
    return t.withColumn("mismatched", F.coalesce(~((share > band[0]) & (share < band[1])), F.lit(False)))


# --- feeds ----------------------------------------------------------------------------------

RSS_SCHEMA = "title string, link string, description string, pubDate string"


def feed_articles(landed: DataFrame, xml: str = "xml") -> DataFrame:
    """RSS documents (source, XML) to one article per URL; an unreadable document gives none."""
    items = landed.select("source", F.explode(F.regexp_extract_all(xml, F.lit(r"(?is)<item[\s>].*?</item>"), F.lit(0))).alias("_i")).withColumn(
        "_x", F.from_xml("_i", RSS_SCHEMA, {"mode": "PERMISSIVE"}))
    a = items.select("source", F.trim("_x.title").alias("title"), F.trim("_x.link").alias("url"), strip_tags(F.coalesce("_x.description", F.lit(""))).alias("summary"),
                     parsing.rfc822("_x.pubDate").alias("published_at")).where("title <> '' AND url <> ''")
    return top_k(a, ["url"], [F.col("published_at").desc_nulls_last(), F.col("source")], 1)


def linked_objects(docs: DataFrame, json: str = "json", keys=("title", "source", "published_at", "publishedAt", "summary", "excerpt")) -> DataFrame:
    """Every {url, title} object at any depth of landed documents: the longest value of each key per URL.

    Each level of nesting is opened once, from the level above it, until nothing is left to open; levels
    are written to the shared checkpoint folder, so no document is parsed again.
    """
    spark = docs.sparkSession
    get = lambda k: F.expr(f"try_variant_get(v, '$.{k}', 'string')")
    level = docs.select(F.try_parse_json(json).alias("v")).where("v IS NOT NULL")
    found = None
    while True:
        level = written(level)
        if level.isEmpty():
            break
        here = level.select(get("url").alias("url"), *[get(k).alias(k) for k in keys]).where(
            "(url LIKE 'http://%' OR url LIKE 'https://%') AND title IS NOT NULL")
        found = here if found is None else found.unionByName(here)
        level = spark.sql("SELECT e.value AS v FROM {f} AS t, LATERAL variant_explode(t.v) AS e", f=level).where(
            "schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%'")
    if found is None:
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in ("url", *keys)))
    return found.groupBy("url").agg(*[F.max_by(k, F.struct(F.length(k), F.col(k))).alias(k) for k in keys])


# --- maintenance -----------------------------------------------------------------------------

def missing_rows(reference: DataFrame, existing: DataFrame, keys=("symbol",)) -> DataFrame:
    """Rows of a published reference whose key the tables lack; their original stamps stay."""
    return reference.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def restored_share_counts(reference: DataFrame, quotes: DataFrame, session, published_at) -> DataFrame:
    """Share counts of a published table (s, sh) for symbols whose quotes state none, as quote rows of its session.

    These are observations that were made before, not new ones: they carry the stamp of their publication.
    """
    known = quotes.where("listed_share > 0").select("symbol")
    rows = reference.where(F.col("sh") > 0).select(F.col("s").alias("symbol"), F.lit(session).cast("date").alias("as_of"),
                                                   F.lit(published_at).cast("timestamp").alias("fetched_at"), F.col("sh").cast("double").alias("listed_share"))
    return missing_rows(rows, known)


def without_quarter(symbols: DataFrame, fundamentals: DataFrame, at) -> DataFrame:
    """Symbols not yet collected for the latest completed quarter."""
    done = fundamentals.where(F.col("period") == parsing.latest_completed_quarter(F.lit(at)))
    return symbols.select("symbol").join(done.select("symbol").distinct(), "symbol", "left_anti")


def short_history(symbols: DataFrame, quotes: DataFrame, dates: int = 20) -> DataFrame:
    held = quotes.groupBy("symbol").agg(F.count_distinct("as_of").alias("n")).where(F.col("n") >= dates)
    return symbols.select("symbol").join(held, "symbol", "left_anti")


def not_collected_since(symbols: DataFrame, profiles: DataFrame, statements: DataFrame, since) -> DataFrame:
    """Symbols lacking a recent profile or recent statements."""
    recent = lambda df: df.where(F.col("fetched_at") >= F.lit(since)).select("symbol")
    return symbols.select("symbol").join(recent(profiles).intersect(recent(statements)), "symbol", "left_anti")
