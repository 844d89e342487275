"""Landed HTML tables: rows and cells, state land prices, fund flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import parsing
from tidemark.functions.numeric import rnd
from tidemark.functions.text import strip_tags, street_key
from tidemark.operators.pit import top_k


def table_rows(pages: DataFrame, html: str, keep: Sequence[str], joiner: str = " ") -> DataFrame:
    """One row per table row: its position and the text of its cells."""
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "_row"))
    cells = F.transform(F.regexp_extract_all("_row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: strip_tags(c, joiner))
    return rows.select(*keep, "pos", cells.alias("cells"))


def _cell(i: int) -> Column:
    return F.get("cells", F.lit(i))


def land_price_rows(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("province", "page", "fetched_at")) -> DataFrame:
    """number | district | street | segment | residential | commercial, with the document the page names."""
    doc = F.nullif(F.regexp_extract(strip_tags(html), fv.LAND_DOCUMENT, 0), F.lit(""))
    rows = table_rows(pages.withColumn("_doc", doc), html, [*keep, "_doc"])
    usable = rows.where((F.size("cells") >= 5) & _cell(0).rlike(r"^\d+$") & (_cell(2) != ""))
    blank = lambda c: F.when(F.length(c) > 0, c)
    return usable.select(
        *keep, "pos", F.col("_doc").alias("source_doc"), blank(_cell(1)).alias("district"), _cell(2).alias("street"), street_key(_cell(2)).alias("street_key"),
        F.coalesce(blank(_cell(3)), F.lit(fv.WHOLE_STREET)).alias("segment"), parsing.dotted_price(_cell(4)).alias("price_residential"),
        parsing.dotted_price(_cell(5)).alias("price_commercial")).where("price_residential IS NOT NULL")


def first_seen(rows: DataFrame, keys: Sequence[str] = ("province", "street_key", "segment"), order: Sequence[str] = ("page", "pos")) -> DataFrame:
    """Pagination that repeats itself: the first page to show a street segment wins."""
    return top_k(rows, list(keys), [F.col(c).asc() for c in order], 1)


def fund_flow_series(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("asset", "fetched_at")) -> DataFrame:
    """Fund-flow tables to series rows: one per fund and day, and the day's net.

    The header carries forward to the rows below it.  A published total is authoritative, zero
    included; without one the net exists only if every fund reported.
    """
    rows = table_rows(pages.withColumn("_doc", F.xxhash64(*keep, html)), html, [*keep, "_doc"], "").where(F.size("cells") > 0)
    first = F.lower(_cell(0))
    rest = F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    codes = F.filter(rest, lambda c: (c != "") & (F.lower(c) != "total"))
    ticker_row = (first == "") & (F.size(codes) >= 3) & F.forall(codes, lambda c: c.rlike("^[A-Z]{2,5}$"))
    is_header = (first == "date") | ticker_row
    # A page's rows are few; the window is per page.
    w = Window.partitionBy("_doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    body = rows.withColumn("_hdr", F.last(F.when(is_header, rest), ignorenulls=True).over(w)).withColumn("_is", is_header).withColumn(
        "as_of", parsing.day_month_year(_cell(0)))
    body = body.where(~F.col("_is") & F.col("_hdr").isNotNull() & F.col("as_of").isNotNull()).withColumn("_vals", rest)
    body = body.select(*keep, "as_of", "_hdr", F.size("_vals").alias("_ncells"), F.transform(
        F.slice(F.arrays_zip(F.col("_hdr").alias("issuer"), F.col("_vals").alias("cell")), 1, F.least(F.size("_hdr"), F.size("_vals"))),
        lambda z: F.struct(z["issuer"].alias("issuer"), parsing.accounting_number(z["cell"]).alias("value"))).alias("_z"))
    funds = F.filter("_z", lambda z: F.lower(z["issuer"]) != "total")
    total = F.get(F.filter("_z", lambda z: F.lower(z["issuer"]) == "total"), F.lit(0))["value"]
    body = body.select(*keep, "as_of", "_ncells", F.size("_hdr").alias("_n"), funds.alias("_f"), total.alias("_total"))
    per_fund = body.select(*keep, "as_of", F.inline("_f")).where("value IS NOT NULL").select(
        *keep, F.concat(F.lit("etf."), "asset", F.lit(".flow."), F.lower("issuer")).alias("series"), "as_of", "value",
        F.to_json(F.struct(F.lit("musd").alias("unit"), "issuer")).alias("meta"))
    complete = F.forall("_f", lambda z: z["value"].isNotNull()) & (F.size("_f") > 0) & (F.col("_ncells") == F.col("_n"))
    summed = rnd(F.aggregate("_f", F.lit(0.0), lambda a, z: a + F.coalesce(z["value"], F.lit(0.0))), 2)
    net = body.select(*keep, F.concat(F.lit("etf."), "asset", F.lit(".net_flow")).alias("series"), "as_of",
                      F.coalesce("_total", F.when(complete, summed)).alias("value"),
                      F.to_json(F.struct(F.lit("musd").alias("unit"), F.col("_n").alias("issuers"))).alias("meta")).where("value IS NOT NULL")
    return per_fund.unionByName(net)
