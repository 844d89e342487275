"""Queries that show one building block each on the raw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import adapters as ad
from catalog.registry import query
from tidemark.functions import parsing
from tidemark.functions.numeric import pct, rnd
from tidemark.operators import pit
from tidemark.operators.quantiles import UPPER_MIDDLE, exact_quantiles
from tidemark.operators.rolling import Series
from tidemark.plans import decision, gamma
from tidemark.sources import prices as px


@query("exact_quantiles_hot_groups", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(median(l_extendedprice), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95,
 list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper_mid, round(median(l_quantity), 6) AS q50 FROM lineitem GROUP BY 1""")
def q_quantiles(spark, sf):
    q = exact_quantiles(ad.table(spark, sf, "lineitem"), ["l_returnflag"], {
        "price": ("l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95, "upper_mid": UPPER_MIDDLE}), "qty": ("l_quantity", {"q50": 0.5})})
    return q.select("l_returnflag", *[rnd(c, 6).alias(c) for c in ("p05", "p50", "p95", "q50")], "upper_mid")


@query("filters_and_patterns", """SELECT p_type, count(*) AS n FROM part WHERE p_type IN ('ECONOMY', 'PROMO', 'SMALL') AND p_name LIKE '%ring%' AND p_retailprice BETWEEN 910 AND 990 AND (p_size <> 5 OR p_size IS NULL) GROUP BY 1""")
def q_filters(spark, sf):
    p = ad.table(spark, sf, "part")
    return p.where(F.col("p_type").isin("ECONOMY", "PROMO", "SMALL") & F.col("p_name").like("%ring%") & F.col("p_retailprice").between(910, 990)
                   & ((F.col("p_size") != 5) | F.col("p_size").isNull())).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("last_sessions_filter", "WITH " + ad.QUOTES_SQL + " SELECT symbol, as_of, part_no, line_no FROM eq_quote WHERE as_of >= (SELECT min(d) FROM (SELECT DISTINCT as_of AS d FROM eq_quote ORDER BY d DESC LIMIT 10))")
def q_last_sessions(spark, sf):
    return pit.within_recent_sessions(ad.quotes(spark, sf), "as_of", 10).select("symbol", "as_of", "part_no", "line_no")


@query("top_rows_per_group", """SELECT l_returnflag, rank, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rank FROM lineitem) WHERE rank <= 25""")
def q_top(spark, sf):
    t = pit.top_k(ad.table(spark, sf, "lineitem"), ["l_returnflag"], ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"], 25, "rank")
    return t.select("l_returnflag", "rank", "l_orderkey", "l_extendedprice")


@query("set_operations", """SELECT 'union' AS op, count(*) AS n FROM (SELECT n_regionkey FROM nation UNION SELECT r_regionkey FROM region)
UNION ALL SELECT 'difference', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT 'intersection', count(*) FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT 'tagged', count(*) FROM (SELECT 'n', n_name FROM nation UNION ALL SELECT 'r', r_name FROM region)""")
def q_sets(spark, sf):
    n, r = ad.table(spark, sf, "nation"), ad.table(spark, sf, "region")
    c = ad.table(spark, sf, "customer").where("c_acctbal > 9900").select("c_nationkey")
    s = ad.table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey")
    tagged = n.select(F.lit("n").alias("t"), "n_name").unionByName(r.select(F.lit("r").alias("t"), F.col("r_name").alias("n_name")))
    parts = {"union": n.select("n_regionkey").union(r.select("r_regionkey")).distinct(), "difference": c.subtract(s), "intersection": c.intersect(s), "tagged": tagged}
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n") for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("instrument_names", """SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN p_size * 1000.0 END AS strike, CASE WHEN p_partkey % 9 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END END AS kind,
 CASE WHEN p_partkey % 9 > 0 THEN TIMESTAMP '2026-01-01 08:00:00' + to_days(p_partkey::int % 300) END AS expiry FROM part""")
def q_instruments(spark, sf):
    d = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int"))
    name = F.concat(F.lit("BTC-"), F.upper(F.date_format(d, "dMMMyy")), F.lit("-"), (F.col("p_size") * 1000).cast("string"), F.lit("-"),
                    F.when(F.col("p_partkey") % 9 == 0, "X").when(F.col("p_partkey") % 2 == 0, "C").otherwise("P"))
    i = ad.table(spark, sf, "part").select("p_partkey", parsing.instrument(name).alias("i"))
    return i.select("p_partkey", "i.strike", "i.kind", F.col("i.expiry").cast("timestamp_ntz").alias("expiry"))


@query("landed_numbers", """SELECT l_orderkey, l_linenumber, l_partkey, -l_extendedprice AS paren, CASE WHEN l_quantity > 25 THEN l_quantity END AS dash, l_returnflag = 'A' AS flag,
 CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey * 1000.0 + 1000000 END AS dotted FROM lineitem""")
def q_numbers(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    dots = F.replace(F.format_number(F.col("l_orderkey") * 1000 + 1000000, 0), F.lit(","), F.lit("."))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", parsing.accounting_number(F.concat(F.lit("("), F.format_number("l_extendedprice", 2), F.lit(")"))).alias("paren"),
        parsing.accounting_number(F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("string")).otherwise("–")).alias("dash"),
        parsing.boolean(F.when(F.col("l_returnflag") == "A", "Yes").otherwise("no")).alias("flag"),
        parsing.dotted_price(F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("giá "), dots, F.lit(" đ"))).otherwise("250")).alias("dotted"))


@query("landed_dates", "SELECT o_orderkey, cast(o_orderdate AS date) AS iso, cast(o_orderdate AS date) AS compact, cast(o_orderdate AS date) AS epoch, cast(o_orderdate AS date) AS words, CASE WHEN month(o_orderdate) <= 3 THEN (year(o_orderdate) - 1) || '-Q4' ELSE year(o_orderdate) || '-Q' || (quarter(o_orderdate) - 1) END AS done_quarter FROM orders")
def q_dates(spark, sf):
    o, d = ad.table(spark, sf, "orders"), F.col("o_orderdate")
    return o.select("o_orderkey", parsing.flexible_date(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00:00Z"))).alias("iso"), parsing.flexible_date(F.date_format(d, "yyyyMMdd")).alias("compact"),
                    parsing.flexible_date(F.unix_millis(d.cast("timestamp")).cast("string")).alias("epoch"), parsing.day_month_year(F.date_format(d, "d MMM yyyy")).alias("words"),
                    parsing.latest_completed_quarter(d).alias("done_quarter"))


@query("rates_with_denominator", "SELECT o_orderpriority, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus <> 'P'), 0), 1) AS rate, count(DISTINCT o_custkey) AS customers, any_value(o_orderpriority) AS label FROM orders GROUP BY 1")
def q_rates(spark, sf):
    return ad.table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        pct(F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") != "P")).alias("rate"), F.count_distinct("o_custkey").alias("customers"),
        F.any_value("o_orderpriority").alias("label"))


@query("gap_aware_returns", "WITH " + ad.BARS_SQL + """, r AS (SELECT symbol, as_of, price / lag(price) OVER w - 1 AS ret, as_of - lag(as_of) OVER w AS gap, row_number() OVER (PARTITION BY symbol ORDER BY as_of DESC) AS back FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY as_of))
SELECT symbol, as_of, round(ret, 8) AS ret, gap, back FROM r WHERE gap <= 10""")
def q_gaps(spark, sf):
    from catalog.equity import bars

    s = Series("symbol", "as_of")
    return bars(spark, sf).select("symbol", "as_of", rnd(s.ret("price"), 8).alias("ret"), F.datediff("as_of", s.lag("as_of")).alias("gap"), s.back().alias("back")).where("gap <= 10")


@query("room_audit", "SELECT count(*) AS checked, count(*) FILTER (p_partkey % 10 = 0) AS exceeds_listed, count(*) FILTER (p_partkey % 10 > 0 AND p_partkey % 10 < 3) AS off_vs_published_pct FROM part")
def q_room(spark, sf):
    p, k = ad.table(spark, sf, "part"), F.col("p_partkey") % 10
    rooms = p.select(F.col("p_partkey").alias("symbol"), F.when(k == 0, 2000.0).when(k < 3, 10.0).otherwise(480.0).alias("room"))
    return px.audit_room(rooms, p.select(F.col("p_partkey").alias("s"), F.lit(1000.0).alias("sh"), F.lit(50.0).alias("fr")))


@query("latest_stored_surface", """SELECT lower(event_type) AS symbol, arg_max(event_id, row(ts, event_id)) AS contracts, arg_max(value, row(ts, event_id)) AS spot FROM events GROUP BY 1""")
def q_surface(spark, sf):
    e = ad.table(spark, sf, "events")
    m = e.select(F.concat(F.lit("gex."), F.lower("event_type"), F.lit(".surface")).alias("series"), F.col("ts").alias("as_of"), F.col("event_id").alias("fetched_at"),
                 F.to_json(F.struct(F.col("event_id").alias("contracts"), F.col("value").alias("spot"))).alias("meta"))
    return gamma.latest_surfaces(m).select("symbol", "contracts", "spot")


@query("dollar_bias", """WITH d AS (SELECT event_type, cast(ts AS date) AS day, round(avg(value), 2) AS v FROM events GROUP BY 1, 2), p AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY day) AS prev FROM d)
SELECT event_type, day, CASE WHEN abs((v / prev - 1) * 100) >= 0.2 THEN -cast(sign((v / prev - 1) * 100) AS int) ELSE 0 END AS bias FROM p""")
def q_bias(spark, sf):
    d = ad.table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(rnd(F.avg("value"), 2).alias("v"))
    s = Series("event_type", "day")
    return d.withColumn("prev", s.lag("v")).select("event_type", "day", decision.dollar_bias(F.col("v"), F.col("prev")).alias("bias"))


@query("json_properties", "SELECT event_id, CASE WHEN cast(json_extract(props, '$.k') AS int) BETWEEN 0 AND 50 THEN cast(json_extract(props, '$.k') AS int) END AS k FROM events")
def q_json(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return ad.table(spark, sf, "events").select("event_id", F.when(k.between(0, 50), k).alias("k"))
