"""Landing queries: documents are assembled from the tables, then read back by the source mappers.

The SQL states what must come out, straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import adapters as ad
from catalog.equity import bars, build_screener
from catalog.registry import ORACLE, query
from tidemark.functions.numeric import clean_nulls, rnd
from tidemark.operators import pit
from tidemark.sources import html_tables, listings as ls, prices as px, publish, records as rc


@query("landed_listing_rows", """SELECT o_orderkey AS list_id, 'chotot:' || lower(o_orderstatus) AS source, o_orderpriority AS category, o_totalprice AS price,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(o_custkey AS double) + 1 END AS size_m2,
  CASE WHEN o_orderkey % 3 = 0 THEN 7.5 ELSE round(o_totalprice / 1e6 / CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(o_custkey AS double) + 1 END, 8) END AS price_per_m2,
  CASE WHEN o_orderkey % 2 = 0 THEN true END AS is_agent, CASE WHEN o_orderkey % 4 > 0 THEN cast(o_orderkey % 4 AS int) END AS toilets FROM orders""")
def q_landed_listings(spark, sf):
    o = ad.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    doc = F.to_json(F.struct(
        k.alias("list_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("list_time"), F.col("o_orderpriority").alias("category_name"), F.col("o_totalprice").alias("price"),
        F.when(k % 5 != 0, F.col("o_custkey").cast("double") + 1).alias("size"), F.when(k % 3 == 0, 7.5).alias("price_million_per_m2"),
        F.when(k % 2 == 0, F.lit("true")).alias("company_ad"), F.when(k % 4 > 0, (k % 4).cast("string")).otherwise(F.lit("")).alias("toilets")))
    rows = ls.listing_rows(o.select(doc.alias("json"), F.lower("o_orderstatus").alias("lane"), F.col("o_orderdate").alias("fetched_at")))
    return rows.select("list_id", "source", "category", "price", "size_m2", rnd("price_per_m2", 8).alias("price_per_m2"), "is_agent", "toilets")


@query("crawl_shortfalls", """WITH e AS (SELECT c_nationkey AS region, count(*) * CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 1 END AS expected FROM customer GROUP BY 1),
g AS (SELECT c_nationkey AS region, count(*) AS got FROM customer GROUP BY 1)
SELECT region, expected, got, CASE WHEN expected >= 60 THEN 'source total saturated' ELSE 'short' END AS status
FROM e JOIN g USING (region) WHERE expected >= 60 OR got < expected * 0.9""")
def q_shortfalls(spark, sf):
    c = ad.table(spark, sf, "customer").select(F.col("c_nationkey").alias("region"))
    e = c.groupBy("region").agg(F.count(F.lit(1)).alias("n")).select("region", F.when(F.col("region") % 2 == 0, F.col("n") * 2).otherwise(F.col("n")).alias("expected"))
    return ls.crawl_shortfalls(e, c, cap=60)


@query("crawl_load_profile", "WITH " + ad.LISTINGS_SQL + " SELECT count(*) AS rows, count(DISTINCT list_id) AS unique_list_ids, round(1 - count(DISTINCT list_id) / count(*), 4) AS duplicate_rate FROM re_listing")
def q_profile(spark, sf):
    return ls.load_profile(ad.listings(spark, sf))[1]


@query("busiest_districts", "WITH " + ad.LISTINGS_SQL + " SELECT region, district, count(*) AS n FROM re_listing GROUP BY 1, 2 ORDER BY n DESC, region, district LIMIT 20")
def q_busiest(spark, sf):
    return ls.load_profile(ad.listings(spark, sf))[0]


@query("code_dictionary", """WITH s AS (SELECT n_nationkey AS code, n_name AS name, 1 AS seen_at FROM nation WHERE n_nationkey % 3 > 0 UNION ALL SELECT n_nationkey, 'old ' || n_name, 0 FROM nation WHERE n_nationkey % 2 = 0)
SELECT code, arg_max(name, seen_at) AS name, max(seen_at) AS seen_at FROM s GROUP BY 1""")
def q_codes(spark, sf):
    n = ad.table(spark, sf, "nation")
    now = n.where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.lit(1).alias("seen_at"))
    old = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("code"), F.concat(F.lit("old "), "n_name").alias("name"), F.lit(0).alias("seen_at"))
    return ls.known_codes(now, old)


@query("unseen_codes", "SELECT n_nationkey AS code FROM nation WHERE n_nationkey % 2 = 0 EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey % 3 > 0")
def q_unseen(spark, sf):
    n = ad.table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"))
    return ls.unseen_codes(n.where("code % 2 = 0"), n.where("code % 3 > 0"))


# --- HTML ------------------------------------------------------------------------------------

def land_pages(spark, sf):
    """One page per province, part size and thousand parts: a few rows, one of them repeated on every page."""
    p = ad.table(spark, sf, "part").join(ad.table(spark, sf, "region"), F.col("p_partkey") % 5 == F.col("r_regionkey"))
    dots = F.format_number(F.col("p_partkey") * 1000 + 20000, 0)
    cells = [F.col("p_partkey").cast("string"), F.col("p_brand"), F.concat(F.lit("Đường <b>Số "), "p_partkey", F.lit("</b>")),
             F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_type")), F.when(F.col("p_partkey") % 7 == 0, "250").otherwise(F.replace(dots, F.lit(","), F.lit("."))),
             F.replace(dots, F.lit(","), F.lit("."))]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td class='x'>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    pages = p.groupBy(F.col("r_name").alias("province"), (F.col("p_size") + 100 * F.floor(F.col("p_partkey") / 1000)).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("_rows"))
    same = "<tr><td>1</td><td>Q</td><td>Phố Chung</td><td></td><td>99.000.000 (x)</td></tr>"
    return pages.select("province", "page", F.lit(0).alias("fetched_at"), F.concat(
        F.lit("<html>Theo 87/2025/NQ-HĐND<table><tr><th>STT</th></tr>"), "_rows", F.lit(same + "</table></html>")).alias("html"))


@query("land_price_pages", """SELECT r_name AS province, p_size + 100 * (p_partkey // 1000) AS page, p_brand AS district, 'so ' || p_partkey AS street_key,
  CASE WHEN p_partkey % 4 = 0 THEN 'TRỌN ĐƯỜNG' ELSE p_type END AS segment, cast(p_partkey * 1000 + 20000 AS double) AS price_residential, '87/2025/NQ-HĐND' AS source_doc
  FROM part JOIN region ON p_partkey % 5 = r_regionkey WHERE p_partkey % 7 > 0
UNION ALL SELECT r_name, page, 'Q', 'chung', 'TRỌN ĐƯỜNG', 99000000.0, '87/2025/NQ-HĐND' FROM (SELECT DISTINCT r_name, p_size + 100 * (p_partkey // 1000) AS page FROM part JOIN region ON p_partkey % 5 = r_regionkey)""")
def q_land_pages(spark, sf):
    r = html_tables.land_price_rows(land_pages(spark, sf))
    return r.select("province", "page", "district", "street_key", "segment", "price_residential", "source_doc")


@query("land_price_first_seen", """SELECT r_name AS province, 'chung' AS street_key, min(p_size + 100 * (p_partkey // 1000)) AS page FROM part JOIN region ON p_partkey % 5 = r_regionkey GROUP BY 1
UNION ALL SELECT r_name, 'so ' || p_partkey, p_size + 100 * (p_partkey // 1000) FROM part JOIN region ON p_partkey % 5 = r_regionkey WHERE p_partkey % 7 > 0""")
def q_first_seen(spark, sf):
    return html_tables.first_seen(html_tables.land_price_rows(land_pages(spark, sf))).select("province", "street_key", "page")


_DAYS = """d AS (SELECT event_type AS asset, cast(ts AS date) AS as_of, round(sum(value) FILTER (user_id % 3 = 0), 2) AS a, round(sum(value) FILTER (user_id % 3 = 1), 2) AS b,
  round(sum(value) FILTER (user_id % 3 = 2), 2) AS c FROM events GROUP BY 1, 2),
g AS (SELECT asset, as_of, -a AS a, CASE WHEN day(as_of) % 4 > 0 THEN b END AS b, c, CASE WHEN day(as_of) % 5 = 0 THEN 0.0 END AS total FROM d)"""


@query("fund_flow_tables", "WITH " + _DAYS + """ SELECT 'etf.' || asset || '.flow.aaaa' AS series, as_of, a AS value FROM g WHERE a IS NOT NULL
UNION ALL SELECT 'etf.' || asset || '.flow.bbbb', as_of, b FROM g WHERE b IS NOT NULL UNION ALL SELECT 'etf.' || asset || '.flow.cccc', as_of, c FROM g WHERE c IS NOT NULL
UNION ALL SELECT 'etf.' || asset || '.net_flow', as_of, coalesce(total, round(a + b + c, 2)) FROM g WHERE total IS NOT NULL OR (a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)""")
def q_fund_tables(spark, sf):
    e = ad.table(spark, sf, "events")
    d = e.groupBy(F.col("event_type").alias("asset"), F.to_date("ts").alias("as_of")).agg(
        *[rnd(F.sum(F.when(F.col("user_id") % 3 == i, F.col("value"))), 2).alias(n) for i, n in enumerate("abc")])
    text = lambda c: F.coalesce(F.format_number(c, 2), F.lit("-"))
    cells = [F.date_format("as_of", "d MMM yyyy"), F.when(F.col("a").isNotNull(), F.concat(F.lit("("), text("a"), F.lit(")"))).otherwise("–"),
             F.when(F.dayofmonth("as_of") % 4 > 0, text("b")).otherwise("-"), text("c"), F.when(F.dayofmonth("as_of") % 5 == 0, "0.0").otherwise("")]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td><span>"), c, F.lit("</span></td>")) for c in cells], F.lit("</tr>"))
    pages = d.groupBy("asset").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("_r")).select("asset", F.lit(0).alias("fetched_at"), F.concat(
        F.lit("<table><tr><th></th><th>Issuer A</th></tr><tr><td></td><td>AAAA</td><td>BBBB</td><td>CCCC</td><td>Total</td></tr><tr><td>Fee</td><td>1</td></tr>"), "_r",
        F.lit("<tr><td>Average</td><td>1.0</td></tr></table>")).alias("html"))
    return html_tables.fund_flow_series(pages).select("series", "as_of", "value")


# --- histories and boards ------------------------------------------------------------------------

def history_documents(spark, sf):
    b = bars(spark, sf)
    t = F.unix_seconds(F.col("as_of").cast("timestamp")).cast("string")
    pt = F.struct("as_of", t.alias("t"), (F.col("price") / 1000).cast("string").alias("c"), F.col("volume").cast("string").alias("v"))
    arr = b.groupBy("symbol").agg(F.array_sort(F.collect_list(pt)).alias("_p"))
    pick = lambda f: F.transform("_p", lambda x: x[f])
    # Opens lie inside the bar except that every bar of a cheap session is broken on purpose.
    return arr.select("symbol", F.to_json(F.struct(F.lit("ok").alias("s"), pick("t").alias("t"), pick("c").alias("o"), pick("c").alias("h"),
                                                   F.transform("_p", lambda x: F.when(x["c"].cast("double") < 1, "-1").otherwise(x["c"])).alias("l"),
                                                   pick("c").alias("c"), pick("v").alias("v"))).alias("json"))


@query("history_arrays_to_quotes", "WITH " + ad.BARS_SQL + """ SELECT symbol, as_of, as_of + INTERVAL 8 HOUR AS fetched_at, round(price, 8) AS price, volume FROM bars WHERE price / 1000 >= 1 AND as_of >= DATE '2000-01-01'""")
def q_history(spark, sf):
    q = px.history_quotes(px.valid_bars(px.history_bars(history_documents(spark, sf))))
    return q.select("symbol", "as_of", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"), rnd("price", 8).alias("price"), "volume")


@query("history_coverage", "WITH " + ad.BARS_SQL + " SELECT symbol, count(*) AS bars, count(*) >= 2 AS ok FROM bars WHERE price / 1000 >= 1 AND as_of >= DATE '2000-01-01' GROUP BY 1")
def q_coverage(spark, sf):
    return px.bar_coverage(px.valid_bars(px.history_bars(history_documents(spark, sf))))


def chart_documents(spark, sf):
    b = bars(spark, sf)
    pt = F.struct("as_of", F.unix_seconds(F.col("as_of").cast("timestamp")).alias("t"), F.when(F.dayofmonth("as_of") % 9 > 0, F.col("price")).alias("c"), F.col("volume").alias("v"))
    arr = b.groupBy("symbol").agg(F.array_sort(F.collect_list(pt)).alias("_p"))
    pick = lambda f: F.transform("_p", lambda x: x[f])
    quote = F.struct(pick("c").alias("open"), pick("c").alias("high"), pick("c").alias("low"), pick("c").alias("close"), pick("v").alias("volume"))
    result = F.struct(F.struct(F.col("symbol").alias("longName"), F.lit("X").alias("exchangeName")).alias("meta"), pick("t").alias("timestamp"),
                      F.struct(F.array(quote).alias("quote")).alias("indicators"))
    return arr.select("symbol", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("json"))


_CHART = """cb AS (SELECT symbol, as_of, price AS close, volume FROM bars WHERE day(as_of) % 9 > 0),
cw AS (SELECT *, lag(close) OVER w AS prev, close - lag(close) OVER w AS chg, lag(close, 21) OVER w AS c21, lag(close, 63) OVER w AS c63, lag(close, 126) OVER w AS c126,
  CASE WHEN count(*) OVER w50 >= 50 THEN sum(close) OVER w50 / 50 END AS s50, CASE WHEN count(*) OVER w200 >= 200 THEN sum(close) OVER w200 / 200 END AS s200,
  max(close) OVER (PARTITION BY symbol) AS hi, min(close) OVER (PARTITION BY symbol) AS lo, row_number() OVER (PARTITION BY symbol ORDER BY as_of DESC) AS back FROM cb
  WINDOW w AS (PARTITION BY symbol ORDER BY as_of), w50 AS (PARTITION BY symbol ORDER BY as_of ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
  w200 AS (PARTITION BY symbol ORDER BY as_of ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
cr AS (SELECT *, sum(greatest(chg, 0)) OVER w14 / 14 AS up, sum(greatest(-chg, 0)) OVER w14 / 14 AS down, count(chg) OVER w14 AS n14 FROM cw
  WINDOW w14 AS (PARTITION BY symbol ORDER BY as_of ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"""


@query("chart_json_bars", "WITH " + ad.BARS_SQL + ", " + _CHART + " SELECT symbol, as_of, close, volume FROM cb")
def q_chart(spark, sf):
    return px.chart_bars(chart_documents(spark, sf)).select("symbol", "as_of", "close", "volume")


@query("market_snapshot_rows", "WITH " + ad.BARS_SQL + ", " + _CHART + """ SELECT symbol AS s, round(close, 3) AS p, round(close - prev, 3) AS ch, round((close / prev - 1) * 100, 2) AS chp,
  round(hi, 3) AS h52, round(lo, 3) AS l52, CASE WHEN n14 >= 14 THEN round(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 1) END AS rsi,
  round((close / c21 - 1) * 100, 2) AS m1, round((close / c63 - 1) * 100, 2) AS m3, round((close / c126 - 1) * 100, 2) AS m6,
  CASE WHEN close >= s50 THEN 'up' ELSE 'down' END AS d, CASE WHEN close >= s200 THEN 'up' ELSE 'down' END AS w, as_of AS asof FROM cr WHERE back = 1""")
def q_snapshot(spark, sf):
    return px.snapshot_rows(px.chart_bars(chart_documents(spark, sf)))


def board(spark, sf):
    """Packed records as they would land; a landed board comes in many files, so the test table's one is dealt out."""
    q = ad.quotes(spark, sf).repartition("symbol")
    k = F.col("part_no")
    level = lambda f, v: F.when(k % 6 == 0, F.concat(F.lit("0|"), v, F.lit("|i"))).otherwise(F.concat((F.col("price") * f / 1000).cast("string"), F.lit("|"), v, F.lit("|d")))
    return q.select(F.col("symbol").alias("sym"), "as_of", "fetched_at", "line_no", "part_no", "value", (F.col("price") / 1000).cast("string").alias("lastPrice"), F.lit("-").alias("r"), F.lit("").alias("openPrice"),
                    F.lit(None).cast("string").alias("highPrice"), F.lit("x").alias("lowPrice"), F.col("volume").cast("string").alias("lot"),
                    (F.col("foreign_buy_value") / 100).cast("string").alias("fBValue"), F.lit(None).cast("string").alias("fSValue"), F.col("foreign_buy_vol").cast("string").alias("fBVol"),
                    F.lit(None).cast("string").alias("fSVolume"), k.cast("string").alias("fRoom"), F.when(k % 5 == 0, "0").otherwise("12").alias("ptVol"),
                    *[level(1 - i / 100, F.lit("5")).alias(f"g{i}") for i in (1, 2, 3)], *[level(1 + i / 100, F.lit("7")).alias(f"g{i + 3}") for i in (1, 2, 3)])


@query("board_depth_unpivot", "WITH " + ad.QUOTES_SQL + """, f AS (SELECT *, unnest(['bid1', 'bid2', 'bid3', 'ask1', 'ask2', 'ask3', 'bid1_vol', 'bid2_vol', 'bid3_vol', 'ask1_vol', 'ask2_vol', 'ask3_vol', 'foreign_room', 'put_through_vol']) AS field FROM eq_quote)
SELECT field, count(*) AS rows, count(DISTINCT symbol) AS symbols FROM f WHERE CASE WHEN field = 'foreign_room' THEN true WHEN field = 'put_through_vol' THEN part_no % 5 > 0 ELSE part_no % 6 > 0 END GROUP BY 1""")
def q_board_metrics(spark, sf):
    m = px.board_metrics(board(spark, sf))
    return m.groupBy(F.split_part("series", F.lit("."), F.lit(4)).alias("field")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.split_part("series", F.lit("."), F.lit(3))).alias("symbols"))


@query("board_quotes", "WITH " + ad.QUOTES_SQL + " SELECT symbol, as_of, round(price, 8) AS price, volume * 10 AS volume, round(foreign_buy_value, 4) AS foreign_buy_value, foreign_buy_vol FROM eq_quote")
def q_board_quotes(spark, sf):
    b = px.board_quotes(board(spark, sf))
    return b.select("symbol", "as_of", rnd("price", 8).alias("price"), "volume", rnd("foreign_buy_value", 4).alias("foreign_buy_value"), "foreign_buy_vol")


@query("board_depth_snapshot", "WITH " + ad.QUOTES_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY as_of DESC, fetched_at DESC) AS rn, count(*) OVER (PARTITION BY symbol, as_of, fetched_at) AS n
  FROM eq_quote WHERE part_no % 6 > 0), t AS (SELECT symbol, as_of, fetched_at FROM k WHERE rn = 1)
SELECT k.symbol, max(k.as_of) AS as_of, round(max(price) * 0.99, 4) AS b1, round(max(price) * 1.03, 4) AS a3, 5.0 AS b1v FROM k JOIN t USING (symbol, as_of, fetched_at) GROUP BY 1""")
def q_depth_snapshot(spark, sf):
    from tidemark.plans.screener import board_depth

    d = board_depth(px.board_metrics(board(spark, sf)))
    return d.select("symbol", "as_of", rnd("b1", 4).alias("b1"), rnd("a3", 4).alias("a3"), "b1v")


@query("foreign_value_audit", "WITH " + ad.QUOTES_SQL + """, u AS (SELECT *, price <> 0 AND foreign_buy_vol > 0 AND foreign_buy_value <> 0 AS ok, foreign_buy_value / foreign_buy_vol / price * CASE WHEN part_no % 50 = 0 THEN 100 ELSE 1 END AS s FROM eq_quote)
SELECT count(*) FILTER (ok) AS checked, count(*) FILTER (ok AND NOT (s > 0.5 AND s < 2)) AS off_vs_price, min(symbol) FILTER (ok AND NOT (s > 0.5 AND s < 2)) AS sample FROM u""")
def q_audit(spark, sf):
    q = ad.quotes(spark, sf).withColumn("foreign_buy_value", F.col("foreign_buy_value") * F.when(F.col("part_no") % 50 == 0, 100).otherwise(1))
    return px.audit_foreign_value(q)


@query("market_wide_foreign_net", "WITH " + ad.QUOTES_SQL + " SELECT count(*) AS rows, round(sum(coalesce(foreign_buy_value, 0) - coalesce(foreign_sell_value, 0)), 0) AS foreign_net FROM eq_quote")
def q_net(spark, sf):
    return px.market_net(ad.quotes(spark, sf)).withColumn("foreign_net", rnd("foreign_net", 0))


def mixed_units(spark, sf):
    return ad.quotes(spark, sf).withColumn("value", F.when(F.col("part_no") % 4 == 0, F.col("value") / 1e6).otherwise(F.col("value")))


@query("turnover_unit_repair", "WITH " + ad.QUOTES_SQL + " SELECT symbol, as_of, part_no, line_no, round(value / 1e6 * 1e6, 2) AS value, volume FROM eq_quote WHERE part_no % 4 = 0")
def q_repair(spark, sf):
    r = px.unit_repairs(mixed_units(spark, sf), F.lit("2030-01-01").cast("timestamp_ntz"))
    return r.select("symbol", "as_of", "part_no", "line_no", rnd("value", 2).alias("value"), "volume")


@query("turnover_unit_split", "SELECT count(*) FILTER (l_partkey % 4 = 0) AS rows_in_millions, count(*) FILTER (l_partkey % 4 > 0) AS rows_already_plain FROM lineitem")
def q_split(spark, sf):
    return px.unit_split(mixed_units(spark, sf))


@query("listing_reference", """SELECT s_suppkey::varchar AS symbol, s_name AS organ_name, 'E' || s_nationkey % 3 AS exchange, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def q_reference(spark, sf):
    s = ad.table(spark, sf, "supplier").join(ad.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        ad.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("symbol", F.concat(F.lit(" "), "s_suppkey", F.lit(" ")))
    ind = s.select("symbol", F.col("r_name").alias("icb_name"), F.lit(1).alias("icb_level"), F.lit(0).alias("pos")).union(
        s.select("symbol", "n_name", F.lit(2), F.lit(1))).union(s.select("symbol", F.lit("later tie"), F.lit(2), F.lit(2)))
    return px.deepest_industry(s.select("symbol", F.col("s_name").alias("organ_name")), s.select("symbol", F.concat(F.lit("E"), (F.col("s_nationkey") % 3).cast("string")).alias("exchange")), ind)


@query("ratio_record_unpivot", """WITH r AS (SELECT l_suppkey::varchar AS symbol, year(l_shipdate) AS y, quarter(l_shipdate) AS q, avg(l_quantity) AS pe, max(l_discount) AS roe, CASE WHEN min(l_tax) > 0 THEN 1.0 END AS npl FROM lineitem GROUP BY 1, 2, 3)
SELECT symbol, y || '-Q' || q AS period, 'pe' AS metric, round(pe, 6) AS value FROM r UNION ALL SELECT symbol, y || '-Q' || q, 'roe', roe FROM r UNION ALL SELECT symbol, y || '-Q' || q, 'npl', npl FROM r WHERE npl IS NOT NULL""")
def q_ratio_records(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    r = li.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter")).agg(
        rnd(F.avg("l_quantity"), 6).cast("string").alias("pe"), F.max("l_discount").cast("string").alias("roe"), F.when(F.min("l_tax") > 0, "1.0").otherwise("n/a").alias("npl"))
    return rc.ratio_rows(r.withColumn("fetched_at", F.lit(0))).drop("fetched_at")


@query("period_columns_unpivot", """SELECT l_suppkey::varchar AS symbol, l_returnflag AS metric, year(l_shipdate) || '-Q' || quarter(l_shipdate) AS period, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY ALL""")
def q_period_columns(spark, sf):
    li = ad.table(spark, sf, "lineitem").withColumn("period", F.concat(F.year("l_shipdate").cast("string"), F.lit("-Q"), F.quarter("l_shipdate").cast("string")))
    wide = li.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.concat(F.lit(" "), "l_returnflag").alias("metric")).pivot("period").agg(rnd(F.sum("l_quantity"), 2))
    return rc.period_columns_rows(wide.withColumn("fetched_at", F.lit(0))).drop("fetched_at")


@query("statement_field_join", """SELECT l_suppkey::varchar AS symbol, year(l_shipdate)::varchar AS period, 'year' AS period_type, 'isa1' AS field, 'Một' AS label_vi, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2
UNION ALL SELECT l_suppkey::varchar, year(l_shipdate) || '-Q' || quarter(l_shipdate), 'quarter', 'isa1', 'Một', round(sum(l_extendedprice), 2) FROM lineitem GROUP BY l_suppkey, year(l_shipdate), quarter(l_shipdate)""")
def q_statements(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    total = rnd(F.sum("l_extendedprice"), 2)
    y = li.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.year("l_shipdate").alias("yearReport")).agg(total.alias("isa1")).withColumn("lengthReport", F.lit(5)).withColumn("period_type", F.lit("year"))
    q = li.groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.year("l_shipdate").alias("yearReport"), F.quarter("l_shipdate").alias("lengthReport")).agg(total.alias("isa1")).withColumn("period_type", F.lit("quarter"))
    r = y.unionByName(q).select("symbol", F.lit("INCOME").alias("section"), F.lit("income").alias("statement"), "period_type", F.lit(0).cast("timestamp").alias("fetched_at"),
                                F.to_json(F.struct("yearReport", "lengthReport", "isa1", F.lit(0).alias("not_declared"))).alias("json"))
    fields = ad.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"), F.lit("INCOME").alias("section"), F.lit("isa1").alias("field"),
                                                    F.lit("Một").alias("titleVi"), F.lit("One").alias("titleEn"), F.lit(1).alias("level"))
    return rc.statement_rows(r, fields).select("symbol", "period", "period_type", "field", "label_vi", "value")


@query("owner_records", """SELECT c_nationkey::varchar AS symbol, c_name AS owner_name, 'Chair' AS position_name, cast(floor(c_acctbal) AS bigint) AS quantity, c_acctbal / 10000 AS percentage, DATE '2026-09-01' AS update_date FROM customer""")
def q_owner_records(spark, sf):
    c = ad.table(spark, sf, "customer")
    o = F.struct(F.concat(F.lit("<b>"), "c_name", F.lit("</b>&nbsp;")).alias("ownerName"), F.lit(" Chair ").alias("positionName"), F.floor("c_acctbal").cast("string").alias("quantity"),
                 (F.col("c_acctbal") / 10000).cast("string").alias("percentage"), F.lit("1-Sep-26").alias("updateDate"))
    return rc.owner_rows(c.select(F.col("c_nationkey").cast("string").alias("symbol"), F.lit(0).cast("timestamp").alias("fetched_at"), F.to_json(F.array(o)).alias("json"))).select(
        "symbol", "owner_name", "position_name", "quantity", "percentage", "update_date")


@query("relationship_records", """SELECT r_name AS symbol, n_name AS related_name, CASE WHEN n_nationkey % 2 = 0 THEN 'subsidiary' ELSE 'affiliate' END AS relation_type, n_nationkey / 100 AS ownership_percent FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q_relationship_records(spark, sf):
    n = ad.table(spark, sf, "nation").join(ad.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    item = F.struct(F.col("n_name").alias("rightOrganNameVi"), F.lit("").alias("rightTicker"), (F.col("n_nationkey") / 100).cast("string").alias("ownedPercentage"))
    even = F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, item))
    odd = F.collect_list(F.when(F.col("n_nationkey") % 2 == 1, item))
    d = n.groupBy(F.col("r_name").alias("symbol")).agg(F.to_json(F.struct(even.alias("subsidiaries"), odd.alias("affiliates"))).alias("json")).withColumn("fetched_at", F.lit(0).cast("timestamp"))
    return rc.relationship_rows(d).select("symbol", "related_name", "relation_type", "ownership_percent")


@query("exchange_board_24h", """WITH p AS (SELECT 'C' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN 'EUR' ELSE 'USDT' END AS sym, p_retailprice AS price, p_retailprice + 5 AS hi, p_retailprice - 7 AS lo, (p_partkey % 1000) * 1e4 AS turnover, p_size AS n FROM part)
SELECT substr(sym, 1, length(sym) - 4) AS s, price AS p, round(turnover / 1e6, 2) AS v, round((price - lo) / (hi - lo) * 100, 0) AS pos, n AS t, round(turnover / n, 0) AS avg FROM p WHERE sym LIKE '%USDT' AND turnover >= 1e6""")
def q_board24(spark, sf):
    p = ad.table(spark, sf, "part")
    raw = p.select(F.concat(F.lit("C"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "EUR").otherwise("USDT")).alias("symbol"), F.col("p_retailprice").cast("string").alias("lastPrice"),
                   F.lit("1.0").alias("priceChangePercent"), ((F.col("p_partkey") % 1000) * 1e4).cast("string").alias("quoteVolume"), (F.col("p_retailprice") + 5).cast("string").alias("highPrice"),
                   (F.col("p_retailprice") - 7).cast("string").alias("lowPrice"), F.col("p_size").alias("count"))
    return rc.board_24h(raw).select("s", "p", "v", "pos", "t", "avg")


@query("series_level_and_change", """WITH d AS (SELECT event_type, cast(ts AS date) AS day, round(sum(value), 2) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS k FROM d)
SELECT event_type, max(v) FILTER (k = 1) AS level, round((max(v) FILTER (k = 1) / max(v) FILTER (k = 8) - 1) * 100, 2) AS change FROM r GROUP BY 1""")
def q_level(spark, sf):
    d = ad.table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(rnd(F.sum("value"), 2).alias("v"))
    return rc.latest_and_change(d, ["event_type"], "day", "v")


@query("coin_identity_check", """SELECT p_partkey::varchar AS symbol, p_partkey % 10 = 0 AS mismatched FROM part""")
def q_identity(spark, sf):
    p = ad.table(spark, sf, "part")
    doc = F.to_json(F.struct(F.col("p_name").alias("name"), F.lit("x").alias("id"), F.struct(
        F.struct((F.col("p_retailprice") * 1000 * F.when(F.col("p_partkey") % 10 == 0, 5).otherwise(1)).alias("usd")).alias("market_cap"), F.lit(1000.0).alias("circulating_supply")).alias("market_data")))
    prof = rc.coin_profiles(p.select(F.col("p_partkey").cast("string").alias("symbol"), doc.alias("json")))
    return rc.identity_check(prof, p.select(F.col("p_partkey").cast("string").alias("s"), F.col("p_retailprice").alias("p"))).select("symbol", "mismatched")


@query("symbol_to_best_id", "SELECT upper(p_brand) AS symbol, arg_min(p_partkey::varchar, p_partkey) AS id FROM part GROUP BY 1")
def q_ids(spark, sf):
    return rc.symbol_ids(ad.table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("rank")))


@query("rss_articles", """SELECT 'https://x.example/' || conv_id || '/' || turn AS url, role AS source, TIMESTAMP '2026-09-18 01:30:00' + to_seconds(turn) AS published_at, 'story ' || conv_id || ' & ' || turn AS title FROM conversations""")
def q_rss(spark, sf):
    c = ad.table(spark, sf, "conversations")
    item = F.concat(F.lit("<item><title>story "), "conv_id", F.lit(" &amp; "), "turn", F.lit("</title><link>https://x.example/"), "conv_id", F.lit("/"), "turn",
                    F.lit("</link><description><![CDATA[<img src='a'/> teaser]]></description><pubDate>Fri, 18 Sep 2026 08:30:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(" +0700</pubDate></item>"))
    d = c.groupBy(F.col("role").alias("source"), F.floor(F.col("conv_id") / 100).alias("_f"), F.floor(F.col("turn") / 50).alias("_g")).agg(F.array_join(F.collect_list(item), "\n").alias("_i")).select(
        "source", F.concat(F.lit("<rss><channel><title>feed</title>"), "_i", F.lit("</channel></rss>")).alias("xml"))
    a = rc.feed_articles(d)
    return a.select("url", "source", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "title")


@query("linked_objects_in_documents", """SELECT 'https://a.example/' || n_nationkey AS url, n_name || ' longer' AS title, 'only here' AS excerpt FROM nation""")
def q_objects(spark, sf):
    n = ad.table(spark, sf, "nation")
    url = F.concat(F.lit("https://a.example/"), "n_nationkey")
    deep = F.struct(F.struct(F.array(F.struct(url.alias("url"), F.concat("n_name", F.lit(" longer")).alias("title"))).alias("items")).alias("section"),
                    F.array(F.struct(url.alias("url"), F.col("n_name").alias("title"), F.lit("only here").alias("excerpt"))).alias("allArticles"),
                    F.struct(F.lit("ftp://no").alias("url"), F.lit("t").alias("title")).alias("other"))
    return rc.linked_objects(n.select(F.to_json(deep).alias("json"))).select("url", "title", "excerpt")


# --- table maintenance ----------------------------------------------------------------------------

@query("append_new_rows", """WITH s AS (SELECT DISTINCT l_suppkey, cast(l_shipdate AS date) AS d FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01 00:00:00'), n AS (SELECT DISTINCT l_suppkey, cast(l_shipdate AS date) AS d FROM lineitem)
SELECT l_suppkey::varchar AS symbol, d AS as_of FROM n EXCEPT SELECT l_suppkey::varchar, d FROM s""")
def q_append(spark, sf):
    q = ad.quotes(spark, sf)
    return pit.new_rows(q, q.where("as_of < date '1998-01-01'"), ["symbol", "as_of"], ad.QUOTE_ORDER).select("symbol", "as_of")


@query("run_log_latest", """SELECT event_type AS run_id, 'c' || user_id % 4 AS collector, arg_max(value, row(ts, event_id)) AS rows_in FROM events GROUP BY 1, 2""")
def q_runs(spark, sf):
    e = ad.table(spark, sf, "events").select(F.col("event_type").alias("run_id"), F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("collector"), F.col("ts").alias("finished_at"),
                                             F.col("event_id").alias("started_at"), F.col("value").alias("rows_in"))
    return pit.latest_runs(e).select("run_id", "collector", "rows_in")


@query("schema_evolution", "SELECT n_nationkey AS k, n_name AS name, NULL::varchar AS added FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def q_evolution(spark, sf):
    return pit.merge_schemas(ad.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")),
                             ad.table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("added")))


@query("null_cleaning", "SELECT l_returnflag, count(*) AS n, count(nullif(l_discount, 0)) AS kept, round(sum(nullif(l_discount, 0)), 2) AS total FROM lineitem GROUP BY 1")
def q_nulls(spark, sf):
    li = ad.table(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("d"))
    return clean_nulls(li).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("d").alias("kept"), rnd(F.sum("d"), 2).alias("total"))


@query("missing_reference_rows", "SELECT s_suppkey::varchar AS symbol FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5 AND l_discount > 0.09)")
def q_missing(spark, sf):
    ref = ad.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return rc.missing_rows(ref, ad.table(spark, sf, "lineitem").where("l_quantity > 49.5 AND l_discount > 0.09").select(F.col("l_suppkey").cast("string").alias("symbol")))


@query("quarter_resume_filter", "WITH " + ad.FUNDAMENTALS_SQL + ", " + ad.COMPANIES_SQL + " SELECT symbol FROM eq_listing WHERE symbol NOT IN (SELECT symbol FROM eq_fundamental WHERE period = '2001-Q4')")
def q_resume(spark, sf):
    return rc.without_quarter(ad.companies(spark, sf), ad.fundamentals(spark, sf), "2002-02-15")


@query("short_history_filter", "WITH " + ad.QUOTES_SQL + ", " + ad.COMPANIES_SQL + " SELECT symbol FROM eq_listing WHERE symbol NOT IN (SELECT symbol FROM eq_quote GROUP BY 1 HAVING count(DISTINCT as_of) >= 530)")
def q_short(spark, sf):
    return rc.short_history(ad.companies(spark, sf), ad.quotes(spark, sf), 530)


@query("stale_company_filter", """WITH r AS (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-09-15 00:00:00')
SELECT s_suppkey::varchar AS symbol FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM r WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM r WHERE l_returnflag = 'R')""")
def q_stale_companies(spark, sf):
    li = ad.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), "l_returnflag", F.col("l_shipdate").alias("fetched_at"))
    sym = ad.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    return rc.not_collected_since(sym, li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), F.lit("2001-09-15").cast("timestamp_ntz"))


@query("changed_shards", """SELECT l_suppkey AS shard, CASE WHEN l_suppkey % 10 = 0 THEN 'added' WHEN l_suppkey % 10 = 1 THEN 'removed' WHEN bool_or(l_suppkey % 10 = 2) THEN 'changed' ELSE 'same' END AS state FROM lineitem GROUP BY 1""")
def q_changed(spark, sf):
    li = ad.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("shard"), "l_orderkey", "l_linenumber", "l_quantity", F.lit("now").alias("updated_at"))
    new = publish.shard_hashes(li.where("shard % 10 <> 1"), ["shard"])
    edited = li.withColumn("l_quantity", F.when(F.col("shard") % 10 == 2, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).withColumn("updated_at", F.lit("before"))
    return publish.changed_shards(new, publish.shard_hashes(edited.where("shard % 10 <> 0"), ["shard"]), ["shard"])


@query("compact_json_rows", "WITH " + ad.COMPANIES_SQL + """ SELECT symbol, '{"n":"' || organ_name || '"' || CASE WHEN balance > 5000 THEN ',"big":1' ELSE '' END || '}' AS json FROM eq_listing""")
def q_json(spark, sf):
    c = ad.companies(spark, sf).select("symbol", F.col("organ_name").alias("n"), F.when(F.col("balance") > 5000, 1).alias("big"), F.lit(float("nan")).alias("x"))
    return publish.compact_json(c, exclude=["symbol"])


# --- boards in plain units --------------------------------------------------------------------------

_IBOARD_FIELDS = [("foreign_room", "p_size * 100.0"), *[x for i in (1, 2, 3) for x in (
    (f"bid{i}", f"p_retailprice - {i}"), (f"bid{i}_vol", f"CASE WHEN (p_size + {i}) % 4 > 0 THEN p_size * {i}.0 END"),
    (f"ask{i}", f"p_retailprice + {i}"), (f"ask{i}_vol", f"p_size + {i}.0"))]]


def iboard(spark, sf):
    """One record per part; every tenth has an unreadable trading date."""
    text = lambda e: F.expr(f"cast({e} AS string)")
    landed = {"foreign_room": "remainForeignQtty"} | {f"{side}{i}{v}": f"best{i}{name}{'Vol' if v else ''}" for i in (1, 2, 3)
                                                      for side, name in (("bid", "Bid"), ("ask", "Offer")) for v in ("", "_vol")}
    return ad.table(spark, sf, "part").select(
        F.concat(F.lit(" P"), "p_partkey").alias("stockSymbol"), F.lit("2026-02-01 09:00:00").cast("timestamp").alias("fetched_at"), F.lit("2026-02-01").cast("date").alias("as_of"),
        F.when(F.col("p_partkey") % 10 == 0, "soon").otherwise(F.concat(F.lit("202601"), F.lpad((1 + F.col("p_partkey") % 28).cast("string"), 2, "0"))).alias("tradingDate"),
        F.col("p_brand").alias("exchange"), text("p_retailprice").alias("matchedPrice"), text("p_retailprice - 1").alias("refPrice"), text("p_retailprice + 2").alias("openPrice"),
        text("p_retailprice + 3").alias("highest"), text("p_retailprice - 3").alias("lowest"), text("p_size * 10").alias("nmTotalTradedQty"), text("p_size * 100.5").alias("nmTotalTradedValue"),
        text("p_size * 2").alias("buyForeignValue"), text("p_size * 3").alias("sellForeignValue"), text("p_size").alias("buyForeignQtty"), text("p_size + 1").alias("sellForeignQtty"),
        *[text(e).alias(landed[k]) for k, e in _IBOARD_FIELDS])


@query("plain_board_quotes", """SELECT 'P' || p_partkey AS symbol, CASE WHEN p_partkey % 10 = 0 THEN DATE '2026-02-01' ELSE make_date(2026, 1, cast(1 + p_partkey % 28 AS int)) END AS as_of,
  p_brand AS exchange, p_retailprice AS price, p_retailprice - 1 AS ref_price, p_retailprice + 2 AS open_price, p_retailprice + 3 AS high, p_retailprice - 3 AS low, p_size * 10 AS volume,
  p_size * 100.5 AS value, p_size * 2.0 AS foreign_buy_value, p_size * 3.0 AS foreign_sell_value, p_size AS foreign_buy_vol, p_size + 1 AS foreign_sell_vol FROM part""")
def q_iboard(spark, sf):
    return px.iboard_quotes(iboard(spark, sf)).drop("fetched_at", "listed_share")


@query("plain_board_depth", "SELECT 'vn.board.P' || p_partkey || '.' || field AS series, value FROM (SELECT p_partkey, unnest(["
       + ", ".join(f"'{k}'" for k, _ in _IBOARD_FIELDS) + "]) AS field, unnest([" + ", ".join(f"cast({e} AS double)" for _, e in _IBOARD_FIELDS) + "]) AS value FROM part) WHERE value IS NOT NULL")
def q_iboard_depth(spark, sf):
    return px.iboard_metrics(iboard(spark, sf)).select("series", "value")


@query("wide_board_quotes", """SELECT 'W' || p_partkey AS symbol, p_brand AS exchange, coalesce(CASE WHEN p_size % 3 > 0 THEN p_retailprice END, CASE WHEN p_size % 2 = 0 THEN p_retailprice - 1 END) AS price,
  p_retailprice + 1 AS ref_price, p_size * 10 AS volume, p_size * 2.5 * 1e6 AS value, p_partkey * 1000 AS listed_share, p_size * 1.0 AS foreign_buy_value, p_size * 2.0 AS foreign_sell_value
  FROM part WHERE p_partkey % 11 > 0""")
def q_wide(spark, sf):
    size = F.col("p_size")
    board = ad.table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 11 > 0, F.concat(F.lit("W"), "p_partkey")).otherwise("").alias("listing.symbol"), F.lit(None).cast("string").alias("symbol"),
        F.lit("2026-02-01").cast("date").alias("as_of"), F.lit("2026-02-01 09:00:00").cast("timestamp").alias("fetched_at"), F.col("p_brand").alias("listing.exchange"),
        F.when(size % 3 > 0, F.col("p_retailprice")).otherwise(F.lit(float("nan"))).alias("match.match_price"), F.when(size % 2 == 0, F.col("p_retailprice") - 1).alias("match.avg_match_price"),
        (F.col("p_retailprice") + 1).alias("listing.ref_price"), (size * 10).alias("match.accumulated_volume"), (size * 2.5).alias("match.accumulated_value"),
        (F.col("p_partkey") * 1000).alias("listing.listed_share"), size.alias("match.foreign_buy_value"), (size * 2).alias("match.foreign_sell_value"))
    return px.wide_board_quotes(board).select("symbol", "exchange", "price", "ref_price", "volume", "value", "listed_share", "foreign_buy_value", "foreign_sell_value")


# --- records of companies, turnover history, restored share counts, run records -----------------------------

@query("profile_records", """SELECT s_suppkey::varchar AS symbol, s_name AS organ_name, s_name AS profile, CASE WHEN s_suppkey % 3 = 0 THEN 'Bank' ELSE 'Other' END AS sector,
  CASE WHEN s_suppkey % 4 > 0 THEN make_date(2000 + s_suppkey % 20, 1 + s_suppkey % 12, 15) END AS listing_date, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal / 10000 END AS state_percent,
  CASE WHEN s_suppkey % 6 > 0 THEN s_acctbal END AS target_price FROM supplier""")
def q_profiles(spark, sf):
    """Profiles as landed: the local sector goes before the general one, dates and numbers are texts, some unreadable."""
    k = F.col("s_suppkey")
    day = F.format_string("%d-%02d-15", 2000 + k % 20, 1 + k % 12)
    doc = F.struct(
        F.col("s_name").alias("viOrganName"), F.concat(F.lit("<p>"), "s_name", F.lit("</p>")).alias("profile"), F.when(k % 3 == 0, "Bank").alias("sectorVn"), F.lit("Other").alias("sector"),
        F.when(k % 4 > 0, day).otherwise("soon").alias("listingDate"), F.when(k % 5 > 0, (F.col("s_acctbal") / 10000).cast("string")).alias("statePercentage"),
        F.when(k % 6 > 0, F.col("s_acctbal").cast("string")).otherwise("n/a").alias("targetPrice"))
    landed = ad.table(spark, sf, "supplier").select(k.cast("string").alias("symbol"), F.lit(0).cast("timestamp").alias("fetched_at"), F.to_json(doc).alias("json"))
    return rc.profile_rows(landed).select("symbol", "organ_name", "profile", "sector", "listing_date", "state_percent", "target_price")


@query("event_records", """SELECT c_nationkey::varchar AS symbol, c_custkey::varchar AS event_id, c_mktsegment AS event_code, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Title ' || c_name END AS title,
  CASE WHEN c_custkey % 4 > 0 THEN DATE '2024-01-01' + cast(c_custkey % 300 AS int) ELSE DATE '2025-06-30' END AS public_date, CASE WHEN c_custkey % 5 > 0 THEN DATE '2024-02-01' + cast(c_custkey % 300 AS int) END AS record_date
FROM customer WHERE c_custkey % 11 > 0""")
def q_event_records(spark, sf):
    """Events in one document per symbol; one without an id is none."""
    k = F.col("c_custkey")
    day = lambda first: F.date_format(F.date_add(F.lit(first).cast("date"), (k % 300).cast("int")), "yyyy-MM-dd")
    item = F.struct(
        F.when(k % 11 > 0, F.concat(F.lit(" "), k.cast("string"))).otherwise(" ").alias("id"), F.col("c_mktsegment").alias("eventCode"),
        F.when(k % 3 > 0, F.concat(F.lit("Title "), "c_name")).alias("eventTitleVi"), F.col("c_name").alias("eventNameVi"), F.when(k % 4 > 0, day("2024-01-01")).alias("publicDate"),
        F.lit("2025-06-30").alias("displayDate1"), F.when(k % 5 > 0, day("2024-02-01")).otherwise("later").alias("recordDate"))
    landed = ad.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("symbol")).agg(F.to_json(F.struct(F.collect_list(item).alias("content"))).alias("json"))
    return rc.event_rows(landed.withColumn("fetched_at", F.lit(0).cast("timestamp"))).select("symbol", "event_id", "event_code", "title", "public_date", "record_date")


@query("turnover_history", f"SELECT 'crypto.' || s || '.turnover_musd' AS series, DATE '2026-02-01' AS as_of, v AS value FROM ({ORACLE['exchange_board_24h']})")
def q_turnover(spark, sf):
    """The day's turnover of every coin on the board as rows of the series table."""
    rows = rc.turnover_series(q_board24(spark, sf), "2026-02-01 07:00:00")
    return rows.select("series", F.to_date("as_of").alias("as_of"), "value")


@query("restored_share_counts", "WITH " + ad.QUOTES_SQL + ", " + ad.COMPANIES_SQL + """, q AS (SELECT symbol, max(CASE WHEN symbol::int % 3 > 0 THEN listed_share END) AS listed_share FROM eq_quote GROUP BY 1)
SELECT symbol, DATE '2026-01-30' AS as_of, floor(balance) AS listed_share FROM eq_listing
WHERE floor(balance) > 0 AND symbol NOT IN (SELECT symbol FROM q WHERE listed_share > 0)""")
def q_restored(spark, sf):
    """A third of the symbols has lost its share counts; the published table still states them."""
    published = ad.companies(spark, sf).select(F.col("symbol").alias("s"), F.floor("balance").alias("sh"))
    quotes = ad.quotes(spark, sf).withColumn("listed_share", F.when(F.col("symbol").cast("int") % 3 > 0, F.col("listed_share")))
    rows = rc.restored_share_counts(published, quotes, "2026-01-30", "2026-01-30 16:00:00")
    return rows.select("symbol", "as_of", "listed_share")


@query("run_records", """SELECT 'r1' AS run_id, event_type AS collector, 'ok' AS status, count(*) AS rows_in, count(DISTINCT user_id) AS rows_new, '{"newest":' || max(event_id) || '}' AS detail FROM events GROUP BY 2""")
def q_run_records(spark, sf):
    """One run-log row per collector from the counts of its job."""
    e = ad.table(spark, sf, "events")
    out = None
    for kind in ("click", "error", "purchase", "signup", "view"):
        counts = e.where(F.col("event_type") == kind).agg(F.count(F.lit(1)).alias("rows_in"), F.count_distinct("user_id").alias("rows_new"), F.max("event_id").alias("newest"))
        row = pit.run_record(counts, "r1", kind, "2026-01-01 00:00:00", "2026-01-01 00:10:00").where("rows_in > 0")
        out = row if out is None else out.unionByName(row)
    return pit.latest_runs(out).select("run_id", "collector", "status", "rows_in", "rows_new", "detail")


_READINGS = """rd AS (SELECT event_type || user_id % 3 AS source, cast(ts AS date) AS as_of, CASE WHEN event_type = 'error' OR day(ts) % 5 = 0 THEN 'n/a' ELSE cast(count(*) AS varchar) END AS value FROM events GROUP BY 1, 2, event_type, day(ts))"""


def readings(spark, sf):
    """A daily reading per source as text; on some days, and for some sources always, it is none."""
    d = ad.table(spark, sf, "events").groupBy(F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("source"), F.to_date("ts").alias("as_of"), "event_type").agg(
        F.count(F.lit(1)).cast("string").alias("value"))
    return d.withColumn("value", F.when((F.col("event_type") == "error") | (F.dayofmonth("as_of") % 5 == 0), "n/a").otherwise(F.col("value")))


@query("sentiment_summary", "WITH " + _READINGS + """, w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY as_of DESC) AS r FROM rd WHERE value <> 'n/a')
SELECT source, max(cast(value AS bigint)) FILTER (r = 1) AS value, max(as_of) AS as_of, cast(round(avg(cast(value AS bigint))) AS bigint) AS mean_7d FROM w WHERE r <= 7 GROUP BY 1""")
def q_sentiment(spark, sf):
    return rc.sentiment_summary(readings(spark, sf))


@query("failed_sources", "WITH " + _READINGS + " SELECT source FROM rd GROUP BY 1 HAVING count(*) FILTER (value <> 'n/a') = 0")
def q_failed(spark, sf):
    r = readings(spark, sf)
    return rc.failed_sources(r, rc.sentiment_summary(r))


@query("fx_snapshot_rows", "WITH " + ad.BARS_SQL + ", " + _CHART + """, z AS (SELECT *, CASE symbol::int % 3 WHEN 0 THEN close * 1.01 WHEN 1 THEN 0 END AS quote FROM cr WHERE back = 1),
f AS (SELECT *, coalesce(nullif(quote, 0), close) AS px FROM z)
SELECT symbol AS s, round(px, 5) AS p, round((px / prev - 1) * 100, 2) AS chp, round((close / c21 - 1) * 100, 2) AS m1, round(hi, 5) AS h52, round(lo, 5) AS l52, as_of AS asof FROM f""")
def q_fx(spark, sf):
    """Rates at the document's own quote where it has one, else at the last close, with five digits."""
    k = F.col("symbol").cast("int") % 3
    b = px.chart_bars(chart_documents(spark, sf)).withColumn("quote", F.when(k == 0, F.col("close") * 1.01).when(k == 1, 0.0))
    return px.snapshot_rows(b, "quote", 5).select("s", "p", "chp", "m1", "h52", "l52", "asof")
