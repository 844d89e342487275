"""Quality-gate queries over artifacts built from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import adapters as ad, companies, equity, ingest, markets, realestate as cre, signals
from catalog.registry import ORACLE, query
from tidemark import fixed_values as fv
from tidemark.functions.numeric import rnd
from tidemark.plans import breadth, browse, gamma, quality as q, signals as sg
from tidemark.session import shared, shared_folder, written
from tidemark.sources import artifacts, prices as px, records as rc

_ROW = "SELECT '{a}' AS artifact, '{r}' AS rule, '{s}' AS severity, cast({c} AS bigint) AS n_checked, cast({b} AS bigint) AS n_bad, {f} AS failed, cast({x} AS varchar) AS sample FROM t"


def _rule(a, r, s, applies, bad, allowed=0.0, sample=None):
    c, b = f"count(*) FILTER ({applies})", f"count(*) FILTER (({applies}) AND ({bad}))"
    return _ROW.format(a=a, r=r, s=s, c=c, b=b, f=f"{b} > {c} * {allowed}", x=f"min({sample}::varchar) FILTER (({applies}) AND ({bad}))" if sample else "NULL")


def _total(a, r, s, bad):
    return _ROW.format(a=a, r=r, s=s, c="count(*)", b=f"({bad})::int", f=bad, x="NULL")


_BREADTH_GATE = [_total("breadth", "enough sessions", "error", "count(*) < 20"), _total("breadth", "as_of unique", "error", "count(DISTINCT as_of) < count(*)")]
_BREADTH_GATE += [_rule("breadth", f"{k} is a percentage", "error", f"{k} IS NOT NULL", f"NOT {k} BETWEEN 0 AND 100", sample="as_of") for k in ("a50", "a200", "uv")]
_BREADTH_GATE += [_rule("breadth", "covers the market", "warn", "median_universe > 0", "n < median_universe * 0.6 * 0.5", sample="as_of")]


@query("gate_breadth", f"WITH t AS ({ORACLE['market_breadth']}) " + " UNION ALL ".join(_BREADTH_GATE))
def g_breadth(spark, sf):
    return q.evaluate(breadth.published_breadth(equity.bars(spark, sf)), "breadth", q.breadth_rules())


_SCREEN_GATE = [_total("screener", "not empty", "error", "count(*) < 1"), _rule("screener", "has symbol", "error", "true", "coalesce(s, '') = ''"),
                _rule("screener", "price in range", "error", "p IS NOT NULL", "NOT p BETWEEN 100 AND 5000000", 0.01, "s"), _total("screener", "any price", "error", "count(p) = 0"),
                _total("screener", "enough prices", "warn", "count(p) < 300")]
for _k in ("roic", "dy"):
    _SCREEN_GATE += [_rule("screener", f"{_k} in percent", "error", f"{_k} IS NOT NULL", f"NOT {_k} BETWEEN -200 AND 500", 0.1, "s"),
                     _rule("screener", f"{_k} mostly in percent", "warn", f"{_k} IS NOT NULL", f"NOT {_k} BETWEEN -200 AND 500", 0.01, "s")]


@query("gate_screener", f"WITH t AS ({ORACLE['screener']}) " + " UNION ALL ".join(_SCREEN_GATE))
def g_screener(spark, sf):
    rows = equity.build_screener(spark, sf)
    return q.evaluate(rows, "screener", q.screener_rules(rows.columns))


_CELL_GATE = [_total("cells", "not empty", "error", "count(*) < 1"), _rule("cells", "sample size", "error", "true", "coalesce(n, 0) < 5", sample="slug"),
              _rule("cells", "median in band", "error", "p IS NOT NULL", "NOT p BETWEEN 1 AND 3000", sample="slug"), _rule("cells", "provenance", "error", "true", "u IS NULL OR n = 0")]


@query("gate_cells", f"WITH t AS ({ORACLE['published_cells']}) " + " UNION ALL ".join(_CELL_GATE))
def g_cells(spark, sf):
    rows = cre.cells(spark, sf)
    return q.evaluate(rows, "cells", q.cell_rules(rows.columns, 5))


@query("gate_verdict", f"""WITH r AS (SELECT * FROM ({ORACLE['gate_breadth']}) UNION ALL SELECT * FROM ({ORACLE['gate_screener']}))
SELECT artifact, count(*) FILTER (failed AND severity = 'error') AS errors, count(*) FILTER (failed AND severity = 'warn') AS warnings, count(*) FILTER (failed AND severity = 'error') = 0 AS ok FROM r GROUP BY 1""")
def g_verdict(spark, sf):
    return q.verdict(g_breadth(spark, sf).unionByName(g_screener(spark, sf)))


@query("gate_row_drop", "SELECT 'orders' AS artifact, 'row drop' AS rule, 'error' AS severity, cast(1 AS bigint) AS n_checked, cast(n < 0.95 * p AS bigint) AS n_bad, n < 0.95 * p AS failed, cast(NULL AS varchar) AS sample FROM (SELECT count(*) FILTER (o_orderkey % 10 > 0) AS n, count(*) AS p FROM orders)")
def g_drop(spark, sf):
    o = ad.table(spark, sf, "orders")
    return q.row_drop(o.where("o_orderkey % 10 > 0"), o, "orders")


_SHARD_GATE = [_total("shards", "not empty", "error", "count(*) < 1"), _rule("shards", "price in band", "error", "true", "NOT p BETWEEN 1 AND 3000", sample="k"),
               _rule("shards", "price, size and total agree", "error", "sz > 0", "abs(tp * 1000 / sz / p - 1) > 0.05 AND tp > 0", sample="k")]


@query("gate_shards", f"WITH t AS ({ORACLE['browse_inventory']}) " + " UNION ALL ".join(_SHARD_GATE))
def g_shards(spark, sf):
    return q.evaluate(cre.browse_rows(spark, sf), "shards", q.shard_rules())


_LAND_GATE = [_total("land", "not empty", "error", "count(*) < 1"), _rule("land", "enough streets", "error", "true", "n < 8", sample="d"), _rule("land", "ratio in band", "error", "true", "NOT rr BETWEEN 0.5 AND 100", sample="d"),
              _rule("land", "document named", "error", "true", "coalesce(doc, '') = ''", sample="d"), _rule("land", "document is current", "warn", "true", "doc <> '1/2025/QĐ-UBND'", sample="d")]


@query("gate_land_ratio", f"WITH t AS ({ORACLE['land_price_ratio']}) " + " UNION ALL ".join(_LAND_GATE))
def g_land(spark, sf):
    rows = cre.q_land(spark, sf).withColumn("cited", F.lit("1/2025/QĐ-UBND"))
    return q.evaluate(rows, "land", q.land_ratio_rules())


_NEWS_GATE = [_total("news", "any link", "error", "count(*) < 1"), _rule("news", "symbol is listed", "error", "true", "NOT listed", sample="symbol"), _rule("news", "at most ten per symbol", "error", "true", "rank > 10", sample="symbol"),
              _rule("news", "has title", "error", "true", "coalesce(title, '') = ''", sample="symbol"), _rule("news", "valid address", "error", "true", "NOT regexp_matches(url, '^https?://[^/\\s]+')", sample="url"),
              _rule("news", "known method", "error", "true", "matched_by NOT IN ('name', 'alias', 'symbol')", sample="matched_by"),
              _rule("news", "not in the future", "error", "published_at IS NOT NULL", "cast(published_at AS date) > DATE '2024-01-20'", sample="url")]


@query("gate_news", f"WITH t AS (SELECT *, symbol <> 'view' AS listed FROM ({ORACLE['news_per_symbol']})) " + " UNION ALL ".join(_NEWS_GATE))
def g_news(spark, sf):
    rows = companies.q_per_symbol(spark, sf).withColumn("listed", F.col("symbol") != "view")
    return q.evaluate(rows, "news", q.news_rules(F.lit("2024-01-20").cast("date")))


_FLOW_GATE = [_total("flows", "any asset", "error", "count(*) < 1"), _rule("flows", "has values", "error", "true", "len(v) = 0", sample="asset"),
              _rule("flows", "dates match values", "error", "true", "len(d) <> len(v)", sample="asset"),
              _rule("flows", "daily flow plausible", "error", "true", f"len(list_filter(v, lambda x: x < {fv.FLOW_DAY_RANGE[0]} OR x > {fv.FLOW_DAY_RANGE[1]})) > 0", sample="asset"),
              _rule("flows", "issuers present", "error", "true", "coalesce(issuers, 0) = 0", sample="asset"),
              _rule("flows", "issuer arrays match", "error", "true", "coalesce(uneven, false)", sample="asset")]


@query("gate_flows", "WITH " + markets._OBS + """, per AS (SELECT asset, issuer, count(as_of) AS d, count(v) AS v FROM iss GROUP BY ALL),
i AS (SELECT asset, count(*) AS issuers, bool_or(d <> v) AS uneven FROM per GROUP BY asset),
t AS (SELECT net.asset, list(v ORDER BY as_of) AS v, list(as_of ORDER BY as_of) AS d, any_value(issuers) AS issuers, any_value(uneven) AS uneven
  FROM net LEFT JOIN i ON i.asset = net.asset GROUP BY net.asset) """ + " UNION ALL ".join(_FLOW_GATE))
def g_flows(spark, sf):
    from tidemark.plans.flows import flow_document

    return q.evaluate(flow_document(markets.net(spark, sf), markets.issuers(spark, sf)), "flows", q.flow_rules())


def _market_rows(spark, sf):
    bars = px.chart_bars(ingest.chart_documents(spark, sf))
    rows = px.snapshot_rows(bars).select("s", "p")
    return rows.join(px.published_history(bars).withColumnRenamed("symbol", "s"), "s", "left")


# The test documents carry the close as open, high and low, so candles are upright; a symbol's days are distinct and in order.
def _market_gate(artifact, least, points, gap, severity):
    rules = [_total(artifact, "enough rows" if artifact == "us" else "not empty", "error", f"count(*) < {least}"), _total(artifact, "s unique", "error", "count(DISTINCT s) < count(*)"),
             _rule(artifact, "positive price", "error", "true", "coalesce(p <= 0, true)", sample="s"), _rule(artifact, "history long enough", "error", "true", f"coalesce(n < {points}, true)", sample="s"),
             _rule(artifact, "history in order", "error", "true", "days < n", sample="s"), _rule(artifact, "quote near last close", severity, "true", f"abs(p / nullif(last, 0) - 1) > {gap}", sample="s")]
    return rules + ([_rule(artifact, "candles upright", "error", "true", "false", sample="s")] if artifact == "us" else [])


_MARKET_GATE = [*_market_gate("us", fv.US_MIN_ROWS, fv.US_MIN_SESSIONS, 0.10, "warn"), *_market_gate("fx", 1, 20, 0.20, "error")]


@query("gate_market_rows", "WITH " + ad.BARS_SQL + ", " + ingest._CHART + """, h AS (SELECT symbol, least(count(*), 260) AS n, least(count(DISTINCT as_of), 260) AS days, round(arg_max(close, as_of), 3) AS last FROM cb GROUP BY 1),
t AS (SELECT x.s, x.p, n, days, last FROM (""" + ORACLE["market_snapshot_rows"] + ") x LEFT JOIN h ON h.symbol = x.s) " + " UNION ALL ".join(_MARKET_GATE))
def g_us(spark, sf):
    rows = written(_market_rows(spark, sf))  # read by both sets of rules
    return q.evaluate(rows, "us", q.us_rules()).unionByName(q.evaluate(rows, "fx", q.fx_rules()))


_COIN_GATE = [_total("coins", "enough rows", "error", "count(*) < 20"), _total("coins", "s unique", "error", "count(DISTINCT s) < count(*)"),
              _rule("coins", "positive price", "error", "true", "coalesce(p <= 0, true)", sample="s"),
              _total("coins", "board moves", "error", "count(*) FILTER (abs(coalesce(chp, 0)) > 0.01) < count(*) * 0.5"),
              _rule("coins", "range position", "error", "pos IS NOT NULL", "NOT pos BETWEEN 0 AND 100", sample="s")]


# The day's move is taken from where the price stands in its range.
@query("gate_coin_board", f"WITH t AS (SELECT *, pos - 58 AS chp FROM ({ORACLE['exchange_board_24h']})) " + " UNION ALL ".join(_COIN_GATE))
def g_coins(spark, sf):
    return q.evaluate(ingest.q_board24(spark, sf).withColumn("chp", F.col("pos") - 58), "coins", q.coin_board_rules())


_PROFILE_GATE = [_total("profiles", "not empty", "error", "count(*) < 1"), _total("profiles", "symbol unique", "error", "count(DISTINCT symbol) < count(*)"),
                 _rule("profiles", "supply within maximum", "error", "max_supply > 0", "supply > max_supply * 1.01", sample="symbol"),
                 _rule("profiles", "value within diluted value", "error", "fdv > 0", "mc > fdv * 1.01", sample="symbol"),
                 _rule("profiles", "same coin", "error", "true", "mismatched", sample="symbol"),
                 _total("profiles", "mostly described", "warn", "count(description) < count(*) * 0.5")]


@query("gate_coin_profiles", f"""WITH t AS (SELECT i.*, p_size * 20.0 AS supply, p_retailprice AS max_supply, p_retailprice AS mc, p_retailprice - p_size + 12 AS fdv, p_name AS description
  FROM ({ORACLE['coin_identity_check']}) i JOIN part ON p_partkey::varchar = i.symbol) """ + " UNION ALL ".join(_PROFILE_GATE))
def g_profiles(spark, sf):
    p = ad.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("symbol"), (F.col("p_size") * 20.0).alias("supply"), F.col("p_retailprice").alias("max_supply"), F.col("p_retailprice").alias("mc"),
        (F.col("p_retailprice") - F.col("p_size") + 12).alias("fdv"), F.col("p_name").alias("description"))
    return q.evaluate(ingest.q_identity(spark, sf).join(p, "symbol"), "profiles", q.profile_rules())


_BANDS = " OR ".join(f"(sym = '{k}' AND spot BETWEEN {lo} AND {hi})" for k, (lo, hi) in fv.GEX_SPOT_RANGE.items())
_GAMMA_GATE = [_total("gex_btc", "not empty", "error", "count(*) < 1"),
               _rule("gex_btc", "numbers present", "error", "true", "spot IS NULL OR net_gex IS NULL OR gamma_flip IS NULL OR max_pain IS NULL", sample="sym"),
               _rule("gex_btc", "known symbol", "error", "true", f"sym NOT IN ({', '.join(repr(k) for k in fv.GEX_SPOT_RANGE)})", sample="sym"),
               _rule("gex_btc", "spot in band", "error", "spot IS NOT NULL", f"NOT ({_BANDS})", sample="sym"),
               _rule("gex_btc", "has contracts", "error", "true", "coalesce(contracts <= 0, true)"),
               _rule("gex_btc", "symbol matches file", "error", "true", "sym <> 'btc'", sample="sym")]


@query("gate_surfaces", f"WITH t AS (SELECT *, CASE WHEN contracts % 2 = 0 THEN 'eth' ELSE 'btc' END AS sym FROM ({ORACLE['gamma_surface']})) " + " UNION ALL ".join(_GAMMA_GATE))
def g_gamma(spark, sf):
    rows = gamma.surface(ad.options(spark, sf)).withColumn("sym", F.when(F.col("contracts") % 2 == 0, "eth").otherwise("btc"))
    return q.evaluate(rows, "gex_btc", q.gamma_rules("btc"))


_INDEX_GATE = [_total("index", "not empty", "error", "count(*) < 1"), _total("index", "k unique", "error", "count(DISTINCT k) < count(*)"),
               _rule("index", "shard exists", "error", "true", "rows IS NULL", sample="k"), _rule("index", "count agrees", "error", "rows IS NOT NULL", "rows <> n", sample="k")]


@query("gate_shard_index", f"""WITH t AS (SELECT x.*, y.rows FROM ({ORACLE['browse_shard_index']}) x
  LEFT JOIN (SELECT k, count(*) AS rows FROM ({ORACLE['browse_inventory']}) GROUP BY k) y ON y.k = x.k) """ + " UNION ALL ".join(_INDEX_GATE))
def g_index(spark, sf):
    rows = cre.browse_rows(spark, sf)
    have = rows.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    return q.evaluate(browse.shard_index(rows, 10, cre.dimension(spark, sf)).join(have, "k", "left"), "index", q.shard_index_rules())


_DOSSIER_GATE = [_total("dossiers", "s unique", "error", "count(DISTINCT s) < count(*)"), _rule("dossiers", "has ratios", "error", "true", "keys = 0", sample="s"),
                 _rule("dossiers", "points have a cadence", "error", "true", "points = 0", sample="s")]
_MANIFEST_GATE = [_rule("manifest", name, "error", "true", bad) for name, bad in (
    ("count matches files", "count <> files"), ("broad coverage", "count < 1500"), ("dossier coverage", "dossiers < count * 0.95"),
    ("statement coverage", "statements < count * 0.90"), ("plausible counts", "dossiers > count OR statements > count"))]


@query("gate_dossiers", f"""WITH t AS (SELECT symbol AS s, count(DISTINCT key) AS keys, min(n) AS points FROM
  (SELECT symbol, key, count(*) AS n FROM ({ORACLE['dossier_ratio_points']}) GROUP BY ALL) GROUP BY symbol),
m AS (SELECT x.*, (SELECT count(DISTINCT symbol) FROM ({ORACLE['dossier_ratio_points']})) AS files FROM ({ORACLE['dossier_manifest']}) x) """
       + " UNION ALL ".join([*_DOSSIER_GATE, *[g.replace("FROM t", "FROM m") for g in _MANIFEST_GATE]]))
def g_dossiers(spark, sf):
    """The manifest is held against the shards that a write of the same rows would make, one per symbol."""
    from tidemark.plans.dossier import manifest
    from tidemark.sources.publish import shard_hashes

    d, _ = companies.build_dossiers(spark, sf)
    files = shard_hashes(d, ["s"]).agg(F.count(F.lit(1)).alias("files"))
    m = manifest(d).crossJoin(F.broadcast(files))  # one row each
    return q.evaluate(d, "dossiers", q.dossier_rules()).unionByName(q.evaluate(m, "manifest", q.manifest_rules()))


_SIGNAL_GATE = [_total("signals", "has statistics", "error", "count(trades) = 0"), _rule("signals", "universe not empty", "error", "true", "coalesce(universe <= 0, true)"),
                _rule("signals", "rules stated", "error", "true", "coalesce(rules, '') = ''"), _rule("signals", "benchmark present", "warn", "true", "benchmark IS NULL")]


@query("gate_signals", f"""WITH t AS (SELECT r.trades, r.variant AS rules, (SELECT count(*) FROM ({ORACLE['eligible_universe']})) AS universe,
  (SELECT median_return_pct FROM ({ORACLE['benchmark_return']})) AS benchmark FROM ({ORACLE['track_record']}) r) """ + " UNION ALL ".join(_SIGNAL_GATE))
def g_signals(spark, sf):
    prices, caps = shared(equity.bars(spark, sf).select("symbol", "as_of", "price")), written(signals.caps(spark, sf))
    universe = sg.eligible(prices, caps, min_cap=1, limit=25).agg(F.count(F.lit(1)).alias("universe"))
    benchmark = sg.benchmark(prices).select(F.col("median_return_pct").alias("benchmark"))
    rec = sg.summary(signals.walked(signals.series(spark, sf)), caps).withColumn("rules", F.col("variant"))
    return q.evaluate(rec.crossJoin(F.broadcast(universe)).crossJoin(F.broadcast(benchmark)), "signals", q.signal_rules())  # one row each


_CONTEXT = "SELECT CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{p.split('.')[0]}'" for i, (p, _, _) in enumerate(fv.CONTEXT_BOUNDS)) + " END AS section, CASE c_custkey % 8 " + " ".join(
    f"WHEN {i} THEN '{p.split('.')[1]}'" for i, (p, _, _) in enumerate(fv.CONTEXT_BOUNDS)) + " END AS key, CASE c_custkey % 8 " + " ".join(
    f"WHEN {i} THEN c_acctbal / 9000 * {float(hi)}" for i, (_, _, hi) in enumerate(fv.CONTEXT_BOUNDS)) + """ END AS value, c_acctbal < -900 AS failed
FROM customer
"""
_CONTEXT_GATE = [_rule("context", p, "error", f"section || '.' || key = '{p}' AND value IS NOT NULL", f"NOT value BETWEEN {float(lo)} AND {float(hi)}") for p, lo, hi in fv.CONTEXT_BOUNDS]
_CONTEXT_GATE += [_total("context", "enough sections", "error", "count(DISTINCT section) FILTER (section IN ('network', 'market', 'mvrv', 'tvl', 'fng') AND value IS NOT NULL) < 3"),
                  _rule("context", "sources answered", "warn", "true", "failed", sample="section")]


@query("gate_context", f"WITH t AS ({_CONTEXT}) " + " UNION ALL ".join(_CONTEXT_GATE))
def g_context(spark, sf):
    return q.evaluate(ad._sql(spark, sf, _CONTEXT, ["customer"]), "context", q.context_rules())


_CITATIONS = """SELECT s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN concat(s_suppkey, '/QD') ELSE concat(s_suppkey % 9999, '/QĐ-TTg') END AS planning_decision,
  CASE WHEN s_suppkey % 7 = 0 THEN 'soon' ELSE concat('202', s_suppkey % 9, '-03-15') END AS planning_date, CASE WHEN s_suppkey % 6 > 0 THEN s_name END AS planning_title, s_name AS planning_source,
  CASE WHEN s_suppkey % 4 > 0 THEN concat(s_suppkey % 999, '/2025/', CASE WHEN s_suppkey % 3 = 0 THEN 'QĐ-BTC' ELSE 'QĐ-UBND' END) END AS land_decision,
  concat('2025-0', 1 + s_suppkey % 9, '-01') AS land_date, s_name AS land_issuer, '2025-01-01' AS effective_from, concat('202', 4 + s_suppkey % 5, '-12-31') AS effective_to,
  CASE s_suppkey % 3 WHEN 0 THEN 'gazette' WHEN 1 THEN 'secondary' ELSE 'hearsay' END AS verified, CASE WHEN s_suppkey % 2 = 0 THEN 'https://x.example' ELSE '' END AS url
FROM supplier
"""
_TODAY = "DATE '2026-06-30'"
_CITED, _LAND = "planning_decision IS NOT NULL", "land_decision IS NOT NULL"
_PROVINCE_GATE = [_total("provinces", "all provinces", "error", f"count(*) <> {fv.PROVINCE_COUNT}"), _total("provinces", "some planning cited", "error", "count(planning_decision) = 0")]
_PROVINCE_GATE += [_rule("provinces", name, "error", applies, bad, sample="name") for name, applies, bad in (
    ("planning number", _CITED, f"NOT regexp_matches(planning_decision, '{fv.PLANNING_DOCUMENT}')"),
    ("planning date", _CITED, f"try_cast(planning_date AS date) IS NULL OR try_cast(planning_date AS date) > {_TODAY}"),
    ("planning title and source", _CITED, "coalesce(planning_title, '') = '' OR coalesce(planning_source, '') = ''"),
    ("land number", _LAND, f"NOT regexp_matches(land_decision, '^{fv.LAND_DOCUMENT}$')"),
    ("land date", _LAND, f"try_cast(land_date AS date) IS NULL OR try_cast(land_date AS date) > {_TODAY}"), ("land issuer", _LAND, "coalesce(land_issuer, '') = ''"),
    ("land period", _LAND, "effective_from > effective_to"), ("land not expired", _LAND, f"try_cast(effective_to AS date) < {_TODAY}"),
    ("land verification", _LAND, "coalesce(verified, '') NOT IN ('gazette', 'secondary') OR verified = 'gazette' AND coalesce(url, '') = ''"))]


@query("gate_provinces", f"WITH t AS ({_CITATIONS}) " + " UNION ALL ".join(_PROVINCE_GATE))
def g_provinces(spark, sf):
    return q.evaluate(ad._sql(spark, sf, _CITATIONS, ["supplier"]), "provinces", q.province_rules(F.lit("2026-06-30").cast("date")))


_BROKER = f"""SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'BTC' ELSE 'XAU' END AS asset, CASE WHEN s_suppkey % 8 = 0 THEN 'old' ELSE '{fv.GATE_VERSION}' END AS version,
  CASE WHEN s_suppkey % 7 > 0 THEN 'broker-xauusd' END AS kind, CASE s_suppkey % 4 WHEN 0 THEN 'not_connected' WHEN 1 THEN 'lost' ELSE 'snapshot' END AS status,
  CASE WHEN s_suppkey % 6 > 0 THEN s_acctbal END AS price, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey END AS quote_at, 250 + s_suppkey % 60 AS h1_count, 300 AS h4_count,
  s_acctbal AS h1_atr, CASE WHEN s_suppkey % 10 > 0 THEN s_acctbal END AS h4_atr
FROM supplier
"""
_BROKER_GATE = [_rule("broker", name, "error", applies, bad) for name, applies, bad in (
    ("asset and rule version", "true", f"asset <> 'XAU' OR version <> '{fv.GATE_VERSION}'"), ("broker named", "true", "coalesce(kind <> 'broker-xauusd', true)"),
    ("known status", "true", "coalesce(status, '') NOT IN ('not_connected', 'snapshot')"), ("no data without a connection", "status = 'not_connected'", "price IS NOT NULL"),
    ("quote complete", "status = 'snapshot'", "price IS NULL OR quote_at IS NULL"),
    ("frames complete", "status = 'snapshot'", f"h1_count < {fv.GATE['min_bars']} OR h4_count < {fv.GATE['min_bars']} OR h1_atr IS NULL OR h4_atr IS NULL"))]


@query("gate_broker", f"WITH t AS ({_BROKER}) " + " UNION ALL ".join(_BROKER_GATE))
def g_broker(spark, sf):
    return q.evaluate(ad._sql(spark, sf, _BROKER, ["supplier"]), "broker", q.broker_rules())


# --- builds against the build before, both read back from stored versions -----------------------------

def two_builds(spark, before, now, name, by=()):
    """Publishes two builds of an artifact and gives back (current, previous) as readers find them."""
    store = artifacts.Artifact(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    store.write(before, name, "yesterday", by, 5000)
    store.write(now, name, "today", by, 5000)
    return store.read(spark, now.schema), store.previous(spark, before.schema), store


_SHARD_BUILD = "cast(floor(p) AS bigint) % 3 > 0"


@query("artifact_district_shards", f"SELECT k, count(*) AS n, count(*) FILTER ({_SHARD_BUILD}) AS n_before, round(sum(p), 3) AS total FROM ({ORACLE['browse_inventory']}) GROUP BY k")
def g_district_shards(spark, sf):
    """District shards in two versions: what the current one and the one before hold of every district."""
    rows = cre.browse_rows(spark, sf)
    now, before, _ = two_builds(spark, rows.where(_SHARD_BUILD), rows, "districts", ["k"])
    both = artifacts.compared(now, before, ["k"], {"n": F.count(F.lit(1)), "total": F.sum("p")})
    return both.select("k", "n", F.coalesce("n_before", F.lit(0)).alias("n_before"), rnd("total", 3).alias("total"))


@query("artifact_ticker_shards", f"SELECT symbol AS s, count(DISTINCT key) AS metrics, count(*) AS points FROM ({ORACLE['dossier_ratio_points']}) GROUP BY 1")
def g_ticker_shards(spark, sf):
    """One shard per ticker, written and read back with its nested parts."""
    d, _ = companies.build_dossiers(spark, sf)
    d = d.select("s", "n", "m")
    now, _, _ = two_builds(spark, d.limit(0), d, "tickers", ["s"])
    points = now.select("s", F.explode("m").alias("key", "g")).select("s", "key", F.size("g.q").alias("n"))
    return points.groupBy("s").agg(F.count(F.lit(1)).alias("metrics"), F.sum("n").cast("long").alias("points"))


@query("artifact_provenance", "SELECT 'orders' AS source, 'today' AS updated_at, count(*) AS n, count(*) FILTER (o_orderkey % 10 > 0) AS n_before FROM orders")
def g_provenance(spark, sf):
    o = ad.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    _, before, store = two_builds(spark, o.where("o_orderkey % 10 > 0"), o, "orders", ["o_orderpriority"])
    return store.provenance(spark).crossJoin(F.broadcast(before.agg(F.count(F.lit(1)).alias("n_before"))))  # one row each


def _coverage(artifact, severity, sql, key, kept, limit=fv.MAX_ROW_DROP, name="coverage against the previous build", bad=None):
    """SQL of a rule over the keys of an artifact, of which the current build has those that `kept` says."""
    counts = f"SELECT count(DISTINCT {key}) AS p, count(DISTINCT {key}) FILTER ({kept}) AS c FROM ({sql})"
    bad = bad or f"1 - c / p > {limit}"
    return (f"SELECT '{artifact}' AS artifact, '{name}' AS rule, '{severity}' AS severity, cast(p AS bigint) AS n_checked, cast(({bad}) AS bigint) AS n_bad, "
            f"({bad}) AS failed, cast(NULL AS varchar) AS sample FROM ({counts})")


_SNAPSHOT = ORACLE["market_snapshot_rows"]
_KEPT = {"cells": "n % 9 > 0", "us": "ascii(right(s, 1)) % 10 > 0", "fx": "s <> (SELECT min(s) FROM ({}))", "coins": "ascii(right(s, 1)) % 9 > 0", "shards": "n > 3"}


@query("gate_coverage", " UNION ALL ".join([
    _coverage("cells", "warn", ORACLE["published_cells"], "slug", _KEPT["cells"]), _coverage("us", "error", _SNAPSHOT, "s", _KEPT["us"]),
    _coverage("fx", "warn", _SNAPSHOT, "s", _KEPT["us"], bad="c < p"), _coverage("coins", "error", ORACLE["exchange_board_24h"], "s", _KEPT["coins"]),
    _coverage("shards", "error", ORACLE["browse_shard_index"], "k", _KEPT["shards"])]))
def g_coverage(spark, sf):
    """Cells, series, coins and districts that the current build has lost."""
    # Every table is read by two builds, the snapshot by four: each is written once.
    snapshot = written(ingest.q_snapshot(spark, sf).select("s", "p"))
    index = browse.shard_index(cre.browse_rows(spark, sf), 10, cre.dimension(spark, sf)).select("k", "n")
    parts = [("cells", cre.cells(spark, sf).select("slug", "n"), "slug", _KEPT["cells"], q.coverage_rules("warn")), ("us", snapshot, "s", _KEPT["us"], q.coverage_rules()),
             ("fx", snapshot, "s", _KEPT["us"], q.fx_coverage_rules()), ("coins", ingest.q_board24(spark, sf).select("s", "p"), "s", _KEPT["coins"], q.coverage_rules()),
             ("shards", index, "k", _KEPT["shards"], q.coverage_rules())]
    out = None
    for name, rows, key, kept, rules in parts:
        rows = rows if rows is snapshot else written(rows)
        now, before, _ = two_builds(spark, rows, rows.where(kept), name)
        report = q.evaluate(artifacts.compared(now, before, [key]), name, rules)
        out = report if out is None else out.unionByName(report)
    return out


@query("gate_breadth_history", f"""WITH t AS (SELECT *, lag(as_of) OVER (ORDER BY as_of) AS after FROM ({ORACLE['market_breadth']})), m AS (SELECT max(as_of) AS last FROM t)
SELECT 'breadth' AS artifact, 'history shrank' AS rule, 'error' AS severity, count(*) AS n_checked, cast(count(*) FILTER (as_of < last - 9) < count(*) - 5 AS bigint) AS n_bad,
  count(*) FILTER (as_of < last - 9) < count(*) - 5 AS failed, cast(NULL AS varchar) AS sample FROM t, m
UNION ALL SELECT 'breadth', 'sessions in order', 'error', count(*) FILTER (after IS NOT NULL), 0, false, NULL FROM t, m WHERE as_of < last - 9""")
def g_breadth_history(spark, sf):
    """The current build lacks the last sessions; its own are in order."""
    rows = breadth.published_breadth(equity.bars(spark, sf)).select("as_of", "n")
    last = rows.agg(F.date_sub(F.max("as_of"), 9).alias("last"))
    now, before, _ = two_builds(spark, rows, rows.where(F.col("as_of") < last.scalar()), "breadth")
    order = now.withColumn("after", F.lag("as_of").over(Window.orderBy("as_of")))  # one row a session: bounded by the calendar
    in_order = [r for r in q.breadth_rules(["after"]) if r.name == "sessions in order"]
    return q.evaluate(artifacts.compared(now, before, ["as_of"]), "breadth", q.breadth_history_rules()).unionByName(q.evaluate(order, "breadth", in_order))


_FELL = """SELECT '{a}' AS artifact, '{r}' AS rule, 'warn' AS severity, count(*) FILTER (here) AS n_checked, count(*) FILTER (here AND c < p) AS n_bad,
  count(*) FILTER (here AND c < p) > 0 AS failed, min({k}) FILTER (here AND c < p) AS sample FROM {t}"""


@query("gate_flow_days", "WITH " + markets._OBS + """, lim AS (SELECT max(as_of) AS last, min(asset) AS one FROM net),
t AS (SELECT asset, count(*) AS p, count(*) FILTER (as_of < last - 3 OR asset <> one) AS c, count(*) FILTER (as_of < last - 3 OR asset <> one) > 0 AS here FROM net, lim GROUP BY asset)
""" + _FELL.format(a="flows", r="days fell", k="asset", t="t"))
def g_flow_days(spark, sf):
    """One asset has lost its last days."""
    rows = markets.net(spark, sf).select("asset", "as_of", "v")
    lim = rows.agg(F.date_sub(F.max("as_of"), 3).alias("last"), F.min("asset").alias("one"))
    now, before, _ = two_builds(spark, rows, rows.crossJoin(F.broadcast(lim)).where("as_of < last OR asset <> one").drop("last", "one"), "flows")  # one row
    return q.evaluate(artifacts.compared(now, before, ["asset"], {"n": F.count(F.lit(1))}), "flows", q.fell_rules("n", "days fell", "asset"))


@query("gate_signal_trades", f"""WITH t AS (SELECT variant, trades AS p, CASE WHEN length(variant) % 2 = 0 THEN trades - 1 ELSE trades + 1 END AS c, true AS here FROM ({ORACLE['track_record']}) WHERE trades > 0)
""" + _FELL.format(a="signals", r="trades fell", k="variant", t="t"))
def g_signal_trades(spark, sf):
    rows = written(sg.summary(signals.walked(signals.series(spark, sf)), signals.caps(spark, sf)).select("variant", "trades"))  # read by two builds
    edited = rows.withColumn("trades", F.when(F.length("variant") % 2 == 0, F.col("trades") - 1).otherwise(F.col("trades") + 1))
    now, before, _ = two_builds(spark, rows, edited, "signals")
    return q.evaluate(artifacts.compared(now, before, ["variant"], {"trades": F.max("trades")}), "signals", q.fell_rules("trades", "trades fell", "variant"))


_SHAPE_GATE = [_rule("shapes", name, "error", applies, bad, sample="s") for name, applies, bad in (
    ("company part has a profile", "has_company", "ascii(right(s, 1)) % 5 = 0"), ("statements not empty", "lines > 0", "false"),
    ("statements have label and series", "lines > 0", "ascii(right(s, 1)) % 7 = 0"))]


@query("gate_dossier_shapes", f"""WITH t AS (SELECT r.s, true AS has_company, l.lines FROM (SELECT DISTINCT symbol AS s FROM ({ORACLE['dossier_ratio_points']})) r
  LEFT JOIN (SELECT symbol, count(DISTINCT field) AS lines FROM ({ORACLE['dossier_statements']}) GROUP BY 1) l ON l.symbol = r.s) """ + " UNION ALL ".join(_SHAPE_GATE))
def g_shapes(spark, sf):
    """Some companies have lost their profile, some statement lines their label."""
    d, _ = companies.build_dossiers(spark, sf)
    last = F.ascii(F.right("s", F.lit(1)))
    label = lambda k, x: x.withField("label", F.when(last % 7 == 0, "").otherwise(F.concat(F.lit("line "), k)))
    rows = d.select("s", "m", F.col("co").isNotNull().alias("has_company"), F.when(last % 5 > 0, F.lit("makes things")).alias("profile"), F.transform_values("st", label).alias("st"))
    return q.evaluate(rows, "shapes", q.dossier_rules(rows.columns)[3:])


_FIELD_GATE = [_rule("broker fields", f"only allowed fields in {section}", "error", "true", bad, sample="asset") for section, bad in (
    ("snapshot", "s_suppkey % 11 = 0"), ("source", "s_suppkey % 7 = 0"), ("quote", "s_suppkey % 5 = 0"))]


@query("gate_broker_fields", "WITH t AS (SELECT *, s_name AS asset FROM supplier) " + " UNION ALL ".join(_FIELD_GATE))
def g_fields(spark, sf):
    """Snapshots as landed: some carry account data."""
    names = lambda base, every, extra: F.when(F.col("s_suppkey") % every == 0, F.array(*[F.lit(x) for x in (*base, extra)])).otherwise(F.array(*[F.lit(x) for x in base]))
    s = ad.table(spark, sf, "supplier")
    rows = s.select(F.col("s_name").alias("asset"), F.lit("live").alias("status"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("kind"),
                    F.lit(None).cast("double").alias("price"), F.lit(None).cast("long").alias("quote_at"), *[F.lit(None).cast("double").alias(c) for c in ("h1_count", "h4_count", "h1_atr", "h4_atr")],
                    F.create_map(F.lit("snapshot"), names(["asset", "status"], 11, "account"), F.lit("source"), names(["kind"], 7, "login"),
                                 F.lit("quote"), names(["price", "at"], 5, "balance")).alias("fields"))
    return q.evaluate(rows, "broker fields", q.broker_rules(rows.columns)[:3])


_PANEL_GATE = [*_CELL_GATE]
_PANEL_GATE += [_rule("cells", f"{k} in range", "error", f"{k} IS NOT NULL", f"NOT {k} BETWEEN {lo} AND {hi}", sample="slug") for k, lo, hi in (
    ("pc", 0, 100), ("gr", 0, 100), ("grx", 0, 100), ("dmc", 0, 100), ("pcm", -100, 0))]
_PANEL_GATE += [_rule("cells", "time on market", "error", "dm IS NOT NULL", "dm < 0"), _rule("cells", "cut rate has a denominator", "error", "pc IS NOT NULL", "coalesce(pcn, 0) = 0")]


@query("gate_cells_panel", f"WITH t AS ({ORACLE['published_cells_panel']}) " + " UNION ALL ".join(_PANEL_GATE))
def g_panel_cells(spark, sf):
    rows = cre.panel_cells(spark, sf)
    return q.evaluate(rows, "cells", q.cell_rules(rows.columns, 5))
