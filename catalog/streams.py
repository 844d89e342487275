"""Streaming queries: the event table read as a stream, run to its end, compared with the batch answer."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import adapters as ad
from catalog.registry import query
from tidemark.functions.numeric import rnd
from tidemark.operators.pit import changes_only
from tidemark.session import shared_folder, spread
from tidemark.streaming import bars, keyed, stores


def _run_folder(spark, name):
    """A new folder per run in the cluster's shared checkpoint directory."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Three deliveries by time; with late rows, a fortieth of the first third arrives with the last delivery.
_THIRD = "CASE WHEN epoch_us(ts) < lo + (hi - lo) // 3 THEN {first} WHEN epoch_us(ts) < lo + 2 * ((hi - lo) // 3) THEN 1 ELSE 2 END"
_PARTS = """lim AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
e AS (SELECT events.*, """ + _THIRD.format(first="CASE WHEN event_id % 40 = 0 THEN 2 ELSE 0 END") + """ AS part FROM events, lim)"""


def deliveries(spark, sf, out, late=False):
    """Yields the stream over the folder three times, each time with one more delivery in it: three micro-batches."""
    events = ad.table(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    third = (hi - lo) // 3
    first = F.when(F.col("event_id") % 40 == 0, 2).otherwise(0) if late else F.lit(0)
    part = F.when(at < lo + third, first).when(at < lo + 2 * third, 1).otherwise(2)
    for k in range(3):
        events.where(part == k).write.mode("append").parquet(f"{out}/in")
        yield spark.readStream.schema(events.schema).parquet(f"{out}/in").withColumn("ts", F.col("ts").cast("timestamp"))


def ticks(df):
    return df.select(F.col("event_type").alias("asset"), "ts", F.col("value").alias("price"), F.lit(1).alias("volume"))




@query("streaming_closed_bars", """WITH w AS (SELECT event_type AS asset, time_bucket(INTERVAL 1 HOUR, ts) AS start, arg_min(value, row(ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, value)) AS close, count(*) AS ticks FROM events GROUP BY 1, 2)
SELECT asset, start, open, high, low, close, ticks FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def s_bars(spark, sf):
    out = _run_folder(spark, "bars")
    for events in deliveries(spark, sf, out):
        stores.run_available(bars.closed_bars(ticks(events), 3600), f"{out}/data", f"{out}/checkpoint")
    r = spark.read.parquet(f"{out}/data")
    return r.select("asset", F.col("start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "ticks")


@query("streaming_four_hour_bars", """WITH w AS (SELECT event_type AS asset, time_bucket(INTERVAL 4 HOUR, ts) AS start, arg_min(value, row(ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, value)) AS close, count(*) AS ticks FROM events GROUP BY 1, 2)
SELECT asset, start, open, high, low, close, ticks FROM w WHERE start + INTERVAL 4 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def s_bars_4h(spark, sf):
    """The longer timeframe from ticks, as the shorter one."""
    out = _run_folder(spark, "bars4")
    for events in deliveries(spark, sf, out):
        stores.run_available(bars.closed_bars(ticks(events), 14400), f"{out}/data", f"{out}/checkpoint")
    r = spark.read.parquet(f"{out}/data")
    return r.select("asset", F.col("start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "ticks")


@query("streaming_sliding_totals", """WITH o AS (SELECT event_type AS asset, ts, value, unnest(range(0, 24)) AS k FROM events),
w AS (SELECT asset, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start, sum(value) AS total, count(*) AS n FROM o GROUP BY 1, 2)
SELECT asset, start, round(total, 2) AS total, n FROM w WHERE start + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def s_sliding(spark, sf):
    out = _run_folder(spark, "sliding")
    for events in deliveries(spark, sf, out):
        e = events.select(F.col("event_type").alias("asset"), "ts", "value")
        stores.run_available(bars.sliding_totals(e), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").select("asset", F.col("start").cast("timestamp_ntz").alias("start"), rnd("total", 2).alias("total"), "n")


@query("streaming_append_by_key", "WITH " + _PARTS + " SELECT user_id, event_type, first(event_id ORDER BY part, event_id) AS event_id FROM e GROUP BY 1, 2")
def s_append(spark, sf):
    """Every delivery once, then all of them again by a job that starts over with a new checkpoint."""
    out = _run_folder(spark, "append")
    store = stores.AppendStore(f"{out}/data", ["user_id", "event_type"], ["event_id"])
    for events in deliveries(spark, sf, out, late=True):
        stores.run_available(events, store, f"{out}/first")
    stores.run_available(events, store, f"{out}/again")
    return store.read(spark).select("user_id", "event_type", "event_id")


@query("streaming_append_by_day", "SELECT cast(ts AS date) AS day, count(*) AS rows, sum(event_id) AS ids FROM events GROUP BY 1")
def s_append_day(spark, sf):
    """Three deliveries, the last two of which bring rows again; each is compared with its own days and slots only."""
    out = _run_folder(spark, "append")
    store = stores.AppendStore(f"{out}/data", ["event_id"], ["ts"], time="ts", slots=4)
    events = ad.table(spark, sf, "events")
    for k in range(3):
        store.write(events.where((F.col("event_id") % 3 <= k) & (F.col("event_id") % 7 != 6 - k) | (F.lit(k) == 2)), "job", k)
    return store.read(spark).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))


@query("streaming_latest_view", "SELECT event_type, user_id, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY 1, 2")
def s_latest(spark, sf):
    out = _run_folder(spark, "latest")
    view = stores.LatestView(f"{out}/data", ["event_type", "user_id"], ["ts", "event_id"])
    for events in deliveries(spark, sf, out, late=True):
        stores.run_available(events, view, f"{out}/checkpoint")
    return view.read(spark).select("event_type", "user_id", "value")


@query("streaming_latest_view_folded", "SELECT event_type, user_id, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY 1, 2")
def s_latest_folded(spark, sf):
    """The same view, folded after every delivery but the last."""
    out = _run_folder(spark, "latest")
    view = stores.LatestView(f"{out}/data", ["event_type", "user_id"], ["ts", "event_id"])
    for k, events in enumerate(deliveries(spark, sf, out, late=True)):
        stores.run_available(events, view, f"{out}/checkpoint")
        if k < 2:
            view.fold(spark)
    return view.read(spark).select("event_type", "user_id", "value")


_CHANGES = """WITH c AS (SELECT event_id, event_type, user_id, value > 40 AS high, lag(value > 40) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT event_id, event_type, user_id, high FROM c WHERE prev IS NULL OR high <> prev"""


def disordered(spark, rows, ts, late, folder):
    """Yields the stream over the folder four times: three deliveries by time, and a heartbeat that closes them.

    Rows of the last two days before a boundary for which `late` holds arrive with the next delivery. The heartbeat is a row
    of nulls, a month later: the watermark passes all rows.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    third, days = (hi - lo) // 3, 2 * 86_400_000_000
    part = F.least(F.floor((at - lo) / third), F.lit(2))
    part = F.when(late & (part < 2) & (at >= lo + (part + 1) * third - days), part + 1).otherwise(part)
    for k in range(4):
        if k < 3:
            spread(rows.where(part == k)).write.mode("append").parquet(f"{folder}/in")
        else:
            last = F.timestamp_micros(F.lit(hi + 15 * days)).cast(rows.schema[ts].dataType)
            spark.range(1).select(*[last.alias(c) if c == ts else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]).write.mode("append").parquet(f"{folder}/in")
        yield spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


@query("streaming_change_log", _CHANGES)
def s_changes(spark, sf):
    """Deliveries with late rows: each counts where its time puts it."""
    out = _run_folder(spark, "changes")
    events = ad.table(spark, sf, "events").withColumn("high", F.col("value") > 40)
    for stream in disordered(spark, events, "ts", F.col("event_id") % 40 == 0, out):
        stream = stream.select("event_id", "event_type", "user_id", "ts", "high")  # what is held until the watermark
        log = keyed.changes(stream, ["event_type", "user_id"], "ts", ["high"], ["event_id"], "3 days")
        keyed.run_stateful(log, f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").where("event_type IS NOT NULL").select("event_id", "event_type", "user_id", "high")


# Hour bars of thirty series, some with their high under their low, some twice.
_FAULTY = """b AS (SELECT event_type || user_id % 6 AS asset, cast(floor(epoch(ts) / 3600) * 3600 AS bigint) AS time, arg_min(value, row(ts, event_id)) AS open,
  max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close FROM events GROUP BY 1, 2),
f AS (SELECT asset, time, open, CASE WHEN time // 3600 % 89 = 0 THEN low - 1 ELSE high END AS high, low, close, unnest(CASE WHEN time // 3600 % 97 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM b),
p AS (SELECT *, lag(time) OVER (PARTITION BY asset ORDER BY time, copy) AS prev FROM f),
r AS (SELECT asset, time, CASE WHEN low <= 0 OR high < greatest(open, close) OR low > least(open, close) THEN 'malformed'
  WHEN time <= prev THEN 'duplicate' WHEN time - prev <> 3600 THEN 'gap' END AS problem FROM p)"""


def rejected(spark, sf, name):
    out = _run_folder(spark, name)
    order = F.struct("ts", "event_id")
    hour = F.col("time") / 3600
    b = ad.table(spark, sf, "events").groupBy(
        F.concat("event_type", (F.col("user_id") % 6).cast("string")).alias("asset"), (F.floor(F.unix_timestamp("ts") / 3600) * 3600).alias("time")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"))
    copies = F.when(hour % 97 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    b = b.withColumn("high", F.when(hour % 89 == 0, F.col("low") - 1).otherwise(F.col("high"))).withColumn("copy", F.explode(copies)).drop("copy")
    b = b.withColumn("seconds", F.lit(3600).cast("long")).withColumn("at", F.timestamp_seconds("time"))
    for stream in disordered(spark, b, "at", hour % 5 == 0, out):
        # The heartbeat has no bar time; it only moves the watermark.
        stream = stream.withColumn("time", F.coalesce("time", F.unix_seconds("at"))).withColumn("seconds", F.lit(3600).cast("long"))
        keyed.run_stateful(keyed.rejected_series(stream.drop("at"), "3 days"), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").where("asset IS NOT NULL")


@query("streaming_rejected_series", "WITH " + _FAULTY + " SELECT asset, time, problem FROM r WHERE problem IS NOT NULL")
def s_rejected(spark, sf):
    return rejected(spark, sf, "rejected").select("asset", "time", "problem")


@query("streaming_series_health", "WITH " + _FAULTY + """ SELECT asset, count(*) FILTER (problem = 'malformed') AS malformed, count(*) FILTER (problem = 'duplicate') AS duplicates,
  count(*) FILTER (problem = 'gap') AS gaps, CASE WHEN count(*) FILTER (problem IN ('malformed', 'duplicate')) > 0 THEN 'malformed' ELSE 'gaps' END AS problem
FROM r WHERE problem IS NOT NULL GROUP BY asset""")
def s_health(spark, sf):
    """The unusable series, named as `series_health` names them."""
    n = lambda kind: F.count_if(F.col("problem") == kind)
    return rejected(spark, sf, "health").groupBy("asset").agg(
        n("malformed").alias("malformed"), n("duplicate").alias("duplicates"), n("gap").alias("gaps"),
        F.when(n("malformed") + n("duplicate") > 0, "malformed").otherwise("gaps").alias("problem"))


_SIX_HOURS = 21_600_000
# Facts seen an hour late, some two hours early, some a day and more late, some without a value; time to live by label.
_FACTS = """f AS (SELECT event_type AS asset, user_id % 7 AS label, epoch_ms(ts) AS fetched, (user_id % 7 + 1) * 7200000 AS ttl,
  epoch_ms(ts) + CASE WHEN event_id % 11 = 0 THEN 7200000 WHEN event_id % 13 = 0 THEN -108000000 ELSE -3600000 END AS observed,
  CASE WHEN event_id % 17 > 0 THEN value END AS value, cast(sign(value - 40) AS int) AS bias FROM events),
n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY asset, label, fetched ORDER BY observed DESC NULLS LAST, value DESC NULLS LAST, bias DESC NULLS LAST) = 1),
i AS (SELECT unnest(generate_series((SELECT min(fetched) // 21600000 FROM f), (SELECT max(fetched) // 21600000 FROM f))) * 21600000 AS at_ms)"""


@query("streaming_fact_statuses", "WITH " + _FACTS + """, k AS (SELECT i.at_ms, s.asset, s.label FROM i, (SELECT DISTINCT asset, label FROM n) AS s),
a AS (SELECT k.*, n.fetched, n.observed, n.ttl, n.value, n.bias FROM k ASOF JOIN n ON n.asset = k.asset AND n.label = k.label AND k.at_ms >= n.fetched),
s AS (SELECT *, CASE WHEN value IS NULL OR observed IS NULL THEN 'missing' WHEN observed > at_ms THEN 'future'
  WHEN at_ms - observed > ttl OR at_ms - fetched > ttl THEN 'stale' ELSE 'ok' END AS status FROM a)
SELECT asset, label, at_ms, status, value, CASE WHEN status = 'ok' THEN bias ELSE 0 END AS bias FROM s""")
def s_statuses(spark, sf):
    """What the log says of every fact at given instants, six hours apart."""
    out = _run_folder(spark, "statuses")
    events = ad.table(spark, sf, "events")
    label, at = F.col("user_id") % 7, F.unix_millis(F.col("ts").cast("timestamp"))
    shift = F.when(F.col("event_id") % 11 == 0, 7_200_000).when(F.col("event_id") % 13 == 0, -108_000_000).otherwise(-3_600_000)
    facts = events.select(
        "event_id", F.col("event_type").alias("asset"), label.alias("label"), F.col("ts").cast("timestamp").alias("fetched"), F.timestamp_millis(at + shift).alias("observed"),
        F.when(F.col("event_id") % 17 > 0, F.col("value")).alias("value"), F.signum(F.col("value") - 40).cast("int").alias("bias"), ((label + 1) * 7_200_000).alias("ttl_ms"))
    for stream in disordered(spark, facts, "fetched", F.col("event_id") % 40 == 0, out):
        log = keyed.fact_statuses(stream.withColumn("ttl_ms", F.coalesce("ttl_ms", F.lit(0))), delay="3 days")
        keyed.run_stateful(log, f"{out}/data", f"{out}/checkpoint")
    log = spark.read.parquet(f"{out}/data").where("asset IS NOT NULL")
    last = facts.agg(F.max(F.floor(F.unix_millis("fetched") / _SIX_HOURS))).first()[0]
    until = F.lead("at_ms").over(Window.partitionBy("asset", "label").orderBy("at_ms")) - 1
    spans = log.withColumn("from", F.ceil(F.col("at_ms") / _SIX_HOURS)).withColumn("to", F.least(F.floor(F.coalesce(until, F.lit(last * _SIX_HOURS)) / _SIX_HOURS), F.lit(last)))
    said = spans.where(F.col("from") <= F.col("to")).withColumn("step", F.explode(F.sequence("from", "to")))
    return said.select("asset", "label", (F.col("step") * _SIX_HOURS).alias("at_ms"), "status", "value", "bias")


@query("changes_only", _CHANGES)
def b_changes(spark, sf):
    e = ad.table(spark, sf, "events").withColumn("high", F.col("value") > 40)
    return changes_only(e, ["event_type", "user_id"], "ts", ["high"], ["event_id"]).select("event_id", "event_type", "user_id", "high")


@query("streaming_dedupe_within_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def s_dedupe(spark, sf):
    out = _run_folder(spark, "dedupe")
    for events in deliveries(spark, sf, out):
        stores.run_available(stores.deduplicated(events, ["user_id", "event_type"], "ts", "60 days"), f"{out}/data", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/data").select("user_id", "event_type")


@query("streaming_observations", "WITH " + _PARTS + """, newest AS (SELECT max(epoch_us(ts) // 1000000) AS s FROM e WHERE part < 2)
SELECT count(*) AS rows, count(*) FILTER (part = 2 AND newest.s - epoch_us(ts) // 1000000 > 3600) AS late, round(sum(value), 2) AS total FROM e, newest""")
def s_observations(spark, sf):
    out = _run_folder(spark, "observations")
    store = stores.ObservationStore(f"{out}/data", "ts", 3600)
    for events in deliveries(spark, sf, out, late=True):
        stores.run_available(events, store, f"{out}/checkpoint")
    return store.read(spark).agg(F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"), rnd(F.sum("value"), 2).alias("total"))


@query("rejected_bars", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS open, l_quantity + l_tax * 100 AS high, l_quantity - l_discount * 300 AS low, l_quantity + 4 AS close FROM lineitem)
SELECT CASE WHEN low <= 0 THEN 'not positive' ELSE 'inverted' END AS problem, count(*) AS n FROM b WHERE low <= 0 OR high < greatest(open, close) OR low > least(open, close) GROUP BY 1""")
def b_rejected(spark, sf):
    q = F.col("l_quantity")
    b = ad.table(spark, sf, "lineitem").select(q.alias("open"), (q + F.col("l_tax") * 100).alias("high"), (q - F.col("l_discount") * 300).alias("low"), (q + 4).alias("close"))
    return bars.split_valid(b)[1].groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
