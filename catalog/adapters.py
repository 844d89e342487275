"""Domain tables derived from the star-schema test tables, in Spark and as SQL for the oracle.

Both forms compute the same columns from the same tables; neither reads anything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- equity quotes -------------------------------------------------------------------

QUOTE_ORDER = ["fetched_at", "line_no", "part_no", "volume", "value"]

QUOTES = """
SELECT cast(l_suppkey AS {str}) AS symbol,
       cast(l_shipdate AS date) AS as_of,
       {fetched} AS fetched_at,
       l_linenumber AS line_no, l_partkey AS part_no,
       CASE WHEN l_linestatus = 'F' THEN 'hose' ELSE 'upcom' END AS exchange,
       l_extendedprice / l_quantity AS price,
       CASE WHEN l_linenumber <= 3 THEN l_extendedprice / l_quantity * (1 - l_discount) END AS ref_price,
       CASE WHEN l_tax > 0 THEN l_extendedprice / l_quantity END AS open_price,
       l_extendedprice / l_quantity * (1 + l_tax) AS high,
       l_extendedprice / l_quantity * (1 - l_discount) AS low,
       cast(l_quantity AS bigint) AS volume,
       l_extendedprice AS value,
       CASE WHEN l_linenumber = 1 THEN l_partkey * 1000 + 1000 END AS listed_share,
       CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS foreign_buy_value,
       CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS foreign_sell_value,
       CASE WHEN l_returnflag = 'A' THEN cast(l_quantity AS bigint) END AS foreign_buy_vol,
       CASE WHEN l_returnflag = 'R' THEN cast(l_quantity AS bigint) END AS foreign_sell_vol
FROM lineitem
"""

_SPARK_MS = "{ts} + make_dt_interval(0, 0, 0, ({ms}) / 1000.0)"
_DUCK_MS = "{ts} + to_milliseconds({ms})"


def _sql(spark: SparkSession, sf: str, text: str, tables: list[str]) -> DataFrame:
    frames = {t: table(spark, sf, t) for t in tables}
    for t in tables:
        text = text.replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **frames)


def _spark_text(text: str, **ms) -> str:
    return text.format(str="string", **{k: _SPARK_MS.format(ts=t, ms=m) for k, (t, m) in ms.items()})


def _duck_text(text: str, **ms) -> str:
    return text.format(str="varchar", **{k: _DUCK_MS.format(ts=t, ms=m) for k, (t, m) in ms.items()})


_QUOTE_MS = {"fetched": ("l_shipdate", "l_orderkey")}


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _spark_text(QUOTES, **_QUOTE_MS), ["lineitem"])


QUOTES_SQL = "eq_quote AS (" + _duck_text(QUOTES, **_QUOTE_MS) + ")"
# One bar per symbol and session, its newest quote with a price; shared by many oracle statements.
BARS_SQL = QUOTES_SQL + """,
told AS (SELECT symbol, as_of, arg_max(e, row(e.fetched_at, e.line_no, e.part_no, e.volume, e.value)) AS q FROM eq_quote AS e WHERE sign(e.price) = 1 GROUP BY ALL),
bars AS (SELECT symbol, as_of, q.price, q.volume, CASE WHEN q.value IS NULL THEN q.volume * q.price ELSE q.value END AS turnover,
  coalesce(list_sum([q.foreign_buy_value, -q.foreign_sell_value]), 0) AS foreign_net FROM told)"""

# --- listed companies -------------------------------------------------------------------

COMPANIES = """
SELECT cast(s_suppkey AS {str}) AS symbol, s_name AS organ_name,
       CASE s_nationkey % 4 WHEN 0 THEN 'hose' WHEN 1 THEN 'HSX' WHEN 2 THEN ' hnx ' ELSE 'upcom' END AS exchange,
       n_name AS industry, r_name AS sector, s_acctbal AS balance
FROM supplier
JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""


def companies(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _spark_text(COMPANIES), ["supplier", "nation", "region"])


COMPANIES_SQL = "eq_listing AS (" + _duck_text(COMPANIES) + ")"

# --- fundamentals ---------------------------------------------------------------------------

FUND_ORDER = ["fetched_at", "line_no", "part_no", "quantity", "extended"]

FUNDAMENTALS = """
SELECT cast(l_suppkey AS {str}) AS symbol,
       concat(year(l_shipdate), '-Q', quarter(l_shipdate)) AS period,
       CASE l_returnflag WHEN 'A' THEN 'dividend_yield' WHEN 'N' THEN 'pe' ELSE 'roic' END AS metric,
       CASE l_returnflag WHEN 'A' THEN l_discount WHEN 'N' THEN l_quantity / 2 ELSE l_tax END AS value,
       {fetched} AS fetched_at,
       l_linenumber AS line_no, l_partkey AS part_no, l_quantity AS quantity, l_extendedprice AS extended
FROM lineitem
"""


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _spark_text(FUNDAMENTALS, **_QUOTE_MS), ["lineitem"])


FUNDAMENTALS_SQL = "eq_fundamental AS (" + _duck_text(FUNDAMENTALS, **_QUOTE_MS) + ")"

# --- property listings -----------------------------------------------------------------------

LISTINGS = """
SELECT o_custkey AS list_id,
       CASE WHEN o_orderstatus = 'O' THEN 'chotot:u' ELSE 'chotot:s' END AS source,
       {as_of} AS as_of, {fetched} AS fetched_at,
       r_name AS region, c_mktsegment AS district, o_orderpriority AS category, n_name AS ward,
       o_totalprice * CASE WHEN o_orderstatus = 'O' THEN 1e2 ELSE 1e5 END AS price,
       size_m2,
       o_totalprice * CASE WHEN o_orderstatus = 'O' THEN 1e2 ELSE 1e5 END / 1e6 / size_m2
         * CASE WHEN o_orderkey % 17 = 0 THEN 1.2 ELSE 1.0 END AS price_per_m2,
       c_acctbal / 97 AS latitude, c_acctbal / 53 AS longitude,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('Đường Số ', cast(100 + c_custkey % 20 AS {str})) END AS street_name,
       c_name AS subject,
       CASE WHEN o_orderkey % 3 > 0 THEN cast(o_orderkey % 3 AS int) END AS legal_doc,
       CASE WHEN c_nationkey % 2 = 0 THEN true END AS is_agent,
       CASE WHEN o_orderkey % 11 > 0 THEN c_name END AS account_name,
       CASE WHEN o_orderkey % 5 > 1 THEN cast(o_orderkey % 5 AS int) END AS rooms,
       CASE o_orderkey % 6 WHEN 0 THEN 'sold' WHEN 1 THEN NULL ELSE 'active' END AS status,
       {orig} AS orig_list_time
FROM orders
JOIN (SELECT l_orderkey, sum(l_quantity) AS size_m2 FROM lineitem
GROUP BY l_orderkey) AS sizes ON o_orderkey = l_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""
_LISTING_MS = {
    "fetched": ("o_orderdate", "o_orderkey"),
    "as_of": ("o_orderdate", "-86400000.0 * (o_orderkey % 30)"),
    "orig": ("o_orderdate", "-86400000.0 * (o_custkey % 90)"),
}


def listings(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _spark_text(LISTINGS, **_LISTING_MS), ["orders", "lineitem", "customer", "nation", "region"])


LISTINGS_SQL = "re_listing AS (" + _duck_text(LISTINGS, **_LISTING_MS) + ")"

# --- state land prices -------------------------------------------------------------------------

LAND_PRICES = """
SELECT r_name AS province,
       CASE p_partkey % 5 WHEN 0 THEN 'FURNITURE' WHEN 1 THEN 'HOUSEHOLD' WHEN 2 THEN 'MACHINERY'
                          WHEN 3 THEN 'BUILDING' ELSE 'AUTOMOBILE' END AS district,
       concat('so ', cast(100 + p_size % 25 AS {str})) AS street_key,
       p_type AS segment,
       (p_retailprice - 890) * (CASE WHEN p_partkey % 13 = 0 THEN -1 ELSE 1 END) * 1e6 AS price_residential,
       concat(cast(p_size AS {str}), '/2025/QĐ-UBND') AS source_doc,
       p_partkey AS fetched_at
FROM part
JOIN region ON p_partkey % 5 = r_regionkey
"""


def land_prices(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _spark_text(LAND_PRICES), ["part", "region"])


LAND_PRICES_SQL = "re_land_price AS (" + _duck_text(LAND_PRICES) + ")"

# --- generic series --------------------------------------------------------------------------------

METRICS = """
SELECT concat('etf.', event_type, CASE WHEN user_id % 3 = 0 THEN '.net_flow'
              ELSE concat('.flow.fund', cast(user_id % 3 AS {str})) END) AS series,
       cast(ts AS date) AS as_of, value - 40 AS value, ts AS fetched_at, event_id
FROM events
"""


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _spark_text(METRICS), ["events"])


METRICS_SQL = "metric_ts AS (" + _duck_text(METRICS) + ")"

# --- option chain ----------------------------------------------------------------------------------------

OPTIONS = """
SELECT p_brand AS snapshot, p_retailprice AS strike,
       CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS kind,
       cast(p_size AS double) AS oi, 0.2 + (p_partkey % 50) / 100.0 AS iv,
       (1 + p_partkey % 420) * 1.0 AS days, 950.0 AS spot
FROM part
"""


def options(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _spark_text(OPTIONS), ["part"]).withColumn("iv", F.col("iv").cast("double")).withColumn(
        "days", F.col("days").cast("double")).withColumn("spot", F.col("spot").cast("double"))


OPTIONS_SQL = ("option_chain AS (SELECT * REPLACE (cast(iv AS double) AS iv, cast(days AS double) AS days,"
               " cast(spot AS double) AS spot) FROM (" + _duck_text(OPTIONS) + "))")

# --- articles -----------------------------------------------------------------------------------------------

ARTICLES = """
SELECT cast(doc_id AS {str}) AS url, split_part(text, chr(10), 1) AS title, text AS body, source, doc_id
FROM documents
"""


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _spark_text(ARTICLES), ["documents"])


ARTICLES_SQL = "articles AS (" + _duck_text(ARTICLES) + ")"
