"""Signal queries: features, walk-forward trades per variant, track record, benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import adapters as ad
from catalog.equity import _ORDER, bars
from catalog.registry import query
from tidemark.functions.numeric import rnd
from tidemark.plans import breadth, screener, signals as sg
from tidemark.session import shared

_FEATURES = """fx AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY as_of) - 1 AS i, lag(price) OVER w AS pp FROM bars
   WINDOW w AS (PARTITION BY symbol ORDER BY as_of)),
fy AS (SELECT *, price / pp - 1 AS ret, CASE WHEN price > pp THEN volume WHEN price < pp THEN -volume ELSE 0 END AS step FROM fx),
fz AS (SELECT *, CASE WHEN count(*) OVER w20 >= 20 THEN sum(price) OVER w20 / 20 END AS fast,
  CASE WHEN count(*) OVER w50 >= 50 THEN sum(price) OVER w50 / 50 END AS slow,
  max(price) OVER w120 AS hi, min(price) OVER w120 AS lo,
  median(nullif(volume, 0)) OVER wp AS base_volume, median(nullif(turnover, 0)) OVER wp AS base_turnover,
  CASE WHEN count(foreign_net) OVER w5 >= 3 THEN sum(foreign_net) OVER w5 END AS foreign_week,
  coalesce(stddev_samp(ret) OVER w59, 0) AS sd, cast(sum(step) OVER wc AS double) AS obv FROM fy
  WINDOW w20 AS (PARTITION BY symbol ORDER BY as_of ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
   w50 AS (PARTITION BY symbol ORDER BY as_of ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
   w120 AS (PARTITION BY symbol ORDER BY as_of ROWS BETWEEN 119 PRECEDING AND CURRENT ROW),
   w59 AS (PARTITION BY symbol ORDER BY as_of ROWS BETWEEN 58 PRECEDING AND CURRENT ROW),
   w5 AS (PARTITION BY symbol ORDER BY as_of ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
   wp AS (PARTITION BY symbol ORDER BY as_of ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
   wc AS (PARTITION BY symbol ORDER BY as_of ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
feat AS (SELECT *, lag(obv, 10) OVER w AS obv_back, lag(fast) OVER w <= lag(slow) OVER w AND fast > slow AS crossed,
  CASE WHEN volume <> 0 AND base_volume <> 0 THEN volume >= base_volume * 1.5 END AS volume_ok,
  CASE WHEN turnover <> 0 AND base_turnover <> 0 THEN turnover >= base_turnover * 1.5 END AS money_ok,
  CASE WHEN foreign_week IS NOT NULL THEN foreign_week > 0 END AS foreign_ok,
  CASE WHEN i >= 10 THEN obv > lag(obv, 10) OVER w END AS accumulation_ok
  FROM fz WINDOW w AS (PARTITION BY symbol ORDER BY as_of)),
fs AS (SELECT *, coalesce(volume_ok::int, 0) + coalesce(money_ok::int, 0) + coalesce(foreign_ok::int, 0) + coalesce(accumulation_ok::int, 0) AS score,
  (volume_ok IS NOT NULL)::int + (money_ok IS NOT NULL)::int + (foreign_ok IS NOT NULL)::int + (accumulation_ok IS NOT NULL)::int AS scored FROM feat)"""
_HEAD = "WITH RECURSIVE " + ad.BARS_SQL + ", " + _FEATURES


@query("signal_features", _HEAD + """ SELECT symbol, as_of, i, round(fast, 6) AS fast, round(slow, 6) AS slow, hi, lo,
  round(base_volume, 6) AS base_volume, round(base_turnover, 6) AS base_turnover, round(foreign_week, 2) AS foreign_week, obv,
  round(sd, 8) AS sd, score, scored FROM fs""")
def q_features(spark, sf):
    f = sg.confirmation_layers(sg.bar_features(bars(spark, sf)))
    return f.select("symbol", "as_of", "i", rnd("fast", 6).alias("fast"), rnd("slow", 6).alias("slow"), "hi", "lo",
                    rnd("base_volume", 6).alias("base_volume"), rnd("base_turnover", 6).alias("base_turnover"),
                    rnd("foreign_week", 2).alias("foreign_week"), "obv", rnd("sd", 8).alias("sd"), "score", "scored")


# The oracle walks bar by bar; the Spark job never does.
_WALK = """vars AS (SELECT 'layers_' || k AS variant, k AS need, false AS gate FROM range(5) t(k) UNION ALL SELECT 'market_filter', 3, true),
trend AS (SELECT as_of, count(*) FILTER (price > slow) / count(*) > 0.5 AS rising FROM fs WHERE slow IS NOT NULL GROUP BY 1 HAVING count(*) >= 30),
sig AS MATERIALIZED (SELECT f.symbol, f.i, f.as_of, f.price, score, sd, rising, i >= 120 AND crossed AND hi > lo AND (price - lo) / (hi - lo) >= 0.5 AND sd > 0 AS buy
  FROM fs f LEFT JOIN trend USING (as_of)),
walk AS (
  SELECT variant, need, gate, symbol, cast(119 AS bigint) AS i, false AS open, cast(NULL AS bigint) AS ei, cast(NULL AS double) AS entry,
    cast(NULL AS double) AS stop, cast(NULL AS double) AS target, cast(NULL AS varchar) AS ev, cast(NULL AS double) AS px
  FROM vars, (SELECT DISTINCT symbol FROM sig)
  UNION ALL
  SELECT variant, need, gate, w.symbol, s.i,
    CASE WHEN w.open THEN NOT (s.price <= w.stop OR s.price >= w.target OR s.i - w.ei >= 30)
         ELSE s.buy AND s.score >= need AND (NOT gate OR coalesce(rising, true)) END,
    CASE WHEN w.open THEN w.ei ELSE s.i END,
    CASE WHEN w.open THEN w.entry ELSE s.price END,
    CASE WHEN w.open THEN w.stop ELSE round(s.price - s.price * s.sd * 2.0, 1) END,
    CASE WHEN w.open THEN w.target ELSE round(s.price + s.price * s.sd * 2.0 * 2.0, 1) END,
    CASE WHEN w.open AND s.price <= w.stop THEN 'stop' WHEN w.open AND s.price >= w.target THEN 'target' WHEN w.open AND s.i - w.ei >= 30 THEN 'time' END,
    s.price
  FROM walk w JOIN sig s ON s.symbol = w.symbol AND s.i = w.i + 1),
ends AS (SELECT *, row_number() OVER (PARTITION BY variant, symbol ORDER BY i DESC) AS rn FROM walk),
tr AS (SELECT variant, symbol, ei AS i, entry, stop, target, i AS exit_i, px AS exit, ev AS reason FROM walk WHERE ev IS NOT NULL
  UNION ALL SELECT variant, symbol, ei, entry, stop, target, NULL, NULL, NULL FROM ends WHERE rn = 1 AND open),
trades AS (SELECT tr.*, b.as_of AS entry_date, x.as_of AS exit_date, (exit - entry) / nullif(abs(entry - stop), 0) AS r,
  (exit - entry) / nullif(abs(entry - stop), 0) - entry * 0.004 / nullif(abs(entry - stop), 0) AS net
  FROM tr JOIN sig b ON tr.symbol = b.symbol AND tr.i = b.i LEFT JOIN sig x ON tr.symbol = x.symbol AND tr.exit_i = x.i)"""


def series(spark, sf):
    """Bars dealt by symbol once, for all that read them."""
    return shared(bars(spark, sf).repartition("symbol"), ["symbol"])


def walked(b):
    return sg.walk_forward(sg.candidates(b), breadth.market_trend(b), sg.LADDER)


def caps(spark, sf):
    return screener.market_caps(ad.quotes(spark, sf), ad.QUOTE_ORDER)


@query("walk_forward_trades", _HEAD + ", " + _WALK + """ SELECT variant, symbol, i, entry_date, entry, stop, target, exit_i, exit_date, exit, reason,
  round(r, 6) AS r, round(net, 6) AS net FROM trades""")
def q_trades(spark, sf):
    return walked(series(spark, sf)).select("variant", "symbol", "i", "entry_date", "entry", "stop", "target", "exit_i", "exit_date", "exit",
                                    "reason", rnd("r", 6).alias("r"), rnd("net", 6).alias("net"))


_CAPS = f"""caps AS (SELECT symbol, arg_max(price, row(fetched_at, line_no, part_no, volume, value)) FILTER (WHERE price IS NOT NULL)
  * arg_max(listed_share, row(fetched_at, line_no, part_no, volume, value)) FILTER (WHERE listed_share IS NOT NULL) / 1e9 AS cap
  FROM eq_quote GROUP BY symbol HAVING count(listed_share) > 0)"""


@query("track_record", _HEAD + ", " + _WALK + ", " + _CAPS + """, o AS (SELECT t.*, row_number() OVER (PARTITION BY variant ORDER BY coalesce(cap, 0) DESC, symbol, i) AS k
  FROM trades t LEFT JOIN caps USING (symbol) WHERE r IS NOT NULL),
e AS (SELECT *, sum(r) OVER w AS eq, sum(net) OVER w AS neq, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) OVER w AS grp FROM o WINDOW w AS (PARTITION BY variant ORDER BY k)),
p AS (SELECT *, greatest(0, max(eq) OVER w) AS peak, greatest(0, max(neq) OVER w) AS npeak FROM e WINDOW w AS (PARTITION BY variant ORDER BY k)),
st AS (SELECT variant, max(c) AS streak FROM (SELECT variant, grp, count(*) FILTER (r <= 0) AS c FROM e GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT variant, count(*) AS n, count(*) FILTER (r > 0) AS wins, sum(r) AS s, sum(r) FILTER (r > 0) AS gain, coalesce(sum(r) FILTER (r <= 0), 0) AS loss,
  min(least(0, eq - peak)) AS dd, sum(net) AS ns, count(*) FILTER (net > 0) AS nw, min(least(0, neq - npeak)) AS ndd,
  count(*) FILTER (reason = 'stop') AS stop, count(*) FILTER (reason = 'target') AS target, count(*) FILTER (reason = 'time') AS time FROM p GROUP BY 1)
SELECT variant, n AS trades, round(wins / n * 100, 1) AS hit_rate, round(s / n, 3) AS avg_r, round(s, 1) AS total_r, round(dd, 1) AS max_drawdown_r,
  CASE WHEN wins > 0 THEN round(gain / wins, 2) END AS avg_win_r, round(coalesce(loss / nullif(n - wins, 0), 0), 2) AS avg_loss_r,
  round(wins / n * coalesce(gain / nullif(wins, 0), 0) + (1 - wins / n) * coalesce(loss / nullif(n - wins, 0), 0), 3) AS expectancy_r,
  round(coalesce(gain, 0) / nullif(abs(loss), 0), 2) AS profit_factor, streak AS worst_losing_streak,
  round(ns, 1) AS net_total_r, round(ns / n, 3) AS net_avg_r, round(nw / n * 100, 1) AS net_hit_rate, round(ndd, 1) AS net_max_drawdown_r,
  stop, target, time FROM a JOIN st USING (variant)""")
def q_record(spark, sf):
    return sg.summary(walked(series(spark, sf)), caps(spark, sf))


@query("open_positions", _HEAD + ", " + _WALK + """ SELECT t.variant, t.symbol, t.entry_date, round(t.entry, 1) AS entry, t.stop, t.target,
  round(arg_max(b.price, b.as_of), 1) AS now, round((arg_max(b.price, b.as_of) - any_value(t.entry)) / abs(any_value(t.entry) - any_value(t.stop)), 2) AS ur,
  count(*) FILTER (b.as_of >= t.entry_date) AS held, max(b.as_of) AS as_of
  FROM trades t JOIN bars b USING (symbol) WHERE t.exit IS NULL GROUP BY ALL""")
def q_open(spark, sf):
    return sg.open_positions(walked(series(spark, sf)), bars(spark, sf)).drop("layers")


@query("benchmark_return", "WITH " + ad.BARS_SQL + """, g AS (SELECT symbol, arg_max(price, as_of) / arg_min(price, as_of) - 1 AS c, min(as_of) AS s, max(as_of) AS e
  FROM bars GROUP BY 1 HAVING count(*) >= 120)
SELECT round(list_sort(list(c))[count(*) // 2 + 1] * 100, 1) AS median_return_pct, count(*) AS tickers, min(s) AS "from", max(e) AS "to" FROM g""")
def q_benchmark(spark, sf):
    return sg.benchmark(bars(spark, sf))


@query("eligible_universe", "WITH " + ad.BARS_SQL + ", " + _CAPS + """
SELECT symbol, count(*) AS bars, any_value(cap) AS cap FROM bars JOIN caps USING (symbol) WHERE cap >= 1
GROUP BY symbol HAVING count(*) >= 120 ORDER BY cap DESC, symbol LIMIT 25""")
def q_eligible(spark, sf):
    return sg.eligible(bars(spark, sf), caps(spark, sf), min_cap=1, limit=25)
