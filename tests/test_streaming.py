from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.pit import changes_only, stored_or_none
from tidemark.plans import decision
from tidemark.streaming import bars, keyed, stores


def write_batches(spark, folder, frames):
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, "asset string, ts timestamp, price double, volume int").coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema("asset string, ts timestamp, price double, volume int").option("maxFilesPerTrigger", 1).parquet(folder)


T0 = datetime(2026, 1, 1)


def test_closed_bars_equal_the_batch_answer(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ticks = [("A", T0 + timedelta(minutes=7 * i), 100.0 + (i * 13) % 17, 1) for i in range(120)]
    write_batches(spark, src, [ticks[:60], ticks[60:]])
    stores.run_available(bars.closed_bars(stream(spark, src), 3600), f"{out}/data", f"{out}/cp")
    got = sorted(map(tuple, spark.read.parquet(f"{out}/data").select("start", "open", "high", "low", "close").collect()))
    end = max(t[1] for t in ticks) - timedelta(minutes=10)
    whole = bars.closed_bars(spark.createDataFrame(ticks, "asset string, ts timestamp, price double, volume int"), 3600)
    want = sorted(map(tuple, whole.where(F.col("closed_at") <= F.lit(end)).select("start", "open", "high", "low", "close").collect()))
    assert got == want and got


def test_retried_batch_leaves_the_same_rows(spark, tmp_path):
    store = stores.AppendStore(str(tmp_path / "s"), ["k"], ["v"])
    a = spark.createDataFrame([("x", 1), ("y", 1)], "k string, v int")
    b = spark.createDataFrame([("y", 2), ("z", 2)], "k string, v int")
    for batch, i in ((a, 0), (b, 1), (b, 1), (a, 2)):
        store.write(batch, "run", i)
    assert sorted(map(tuple, store.read(spark).collect())) == [("x", 1), ("y", 1), ("z", 2)]


def test_new_checkpoint_keeps_what_an_earlier_one_stored(spark, tmp_path):
    schema = "k string, v int, ts timestamp"
    for time in (None, "ts"):
        store = stores.AppendStore(str(tmp_path / f"store{time}"), ["k"], ["v"], time)
        for name, rows in (("one", [("x", 1, T0), ("y", 1, T0)]), ("two", [("z", 5, T0), ("x", 7, T0)])):
            folder = str(tmp_path / f"{name}{time}")
            spark.createDataFrame(rows, schema).write.parquet(f"{folder}/in")
            stores.run_available(spark.readStream.schema(schema).parquet(f"{folder}/in"), store, f"{folder}/checkpoint")
        assert sorted((r.k, r.v) for r in store.read(spark).collect()) == [("x", 1), ("y", 1), ("z", 5)]


def test_a_batch_is_compared_with_its_days_and_slots_only(spark, tmp_path):
    store = stores.AppendStore(str(tmp_path / "s"), ["k"], ["v"], "ts", 8)
    rows = [(f"k{i}", i, T0 + timedelta(days=i % 5)) for i in range(200)]
    schema = "k string, v int, ts timestamp"
    for n, part in enumerate((rows[:90], rows[40:150], rows[100:])):
        store.write(spark.createDataFrame(part, schema), "run", n)
    assert sorted((r.k, r.v) for r in store.read(spark).collect()) == sorted((k, v) for k, v, _ in rows)
    again = spark.createDataFrame([r for r in rows if r[2] == T0][:1], schema)
    plan = store.known(again, "run", 9)._jdf.queryExecution().toString()
    scan = plan[plan.rindex("PartitionFilters"):].split("PushedFilters")[0]
    assert "day" in scan and "slot" in scan
    with pytest.raises(ValueError, match="different days"):
        store.write(spark.createDataFrame([("x", 1, T0), ("x", 2, T0 + timedelta(days=1))], schema), "run", 5)


def test_a_folded_view_reads_only_later_batches(spark, tmp_path):
    view = stores.LatestView(str(tmp_path / "v"), ["k"], ["v"])
    mk = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    view.write(mk(("a", 1), ("b", 5)), "run", 0)
    view.write(mk(("a", 3)), "run", 1)
    view.fold(spark)
    view.write(mk(("a", 2), ("c", 1)), "run", 2)
    view.fold(spark)
    view.write(mk(("b", 9)), "again", 0)
    assert sorted(map(tuple, view.read(spark).collect())) == [("a", 3), ("b", 9), ("c", 1)]
    fold, rest = view._parts(spark)
    assert fold.count() == 3 and [(r.k, r.v) for r in rest.collect()] == [("b", 9)]


def test_only_a_missing_path_counts_as_empty(spark, tmp_path):
    with pytest.raises(AnalysisException):
        stored_or_none(lambda: spark.range(1).select("no_such_column"))
    assert stored_or_none(lambda: spark.read.parquet(str(tmp_path / "nothing"))) is None


def test_late_rows_become_corrections(spark, tmp_path):
    store = stores.ObservationStore(str(tmp_path / "o"), "ts", 3600)
    mk = lambda h: spark.createDataFrame([("A", T0 + timedelta(hours=h), 1.0)], "k string, ts timestamp, v double")
    for i, h in enumerate((5, 1, 6)):
        store.write(mk(h), "run", i)
    assert [r.ts for r in store.corrections(spark).collect()] == [T0 + timedelta(hours=1)] and store.read(spark).count() == 3


def run_disordered(spark, tmp_path, rows, schema, parts, build):
    """Feeds parts (lists of row numbers) one after the other to a stateful stream and returns what came out."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.mode("append").parquet(src)
        keyed.run_stateful(build(spark.readStream.schema(schema).parquet(src)), f"{out}/data", f"{out}/cp")
    return spark.read.parquet(f"{out}/data")


def test_change_log_with_late_rows_equals_one_pass(spark, tmp_path):
    schema = "k string, ts timestamp, n int, s string"
    rows = [("k", T0 + timedelta(minutes=11 * i), i, ["up", "down", None][(i // 4) % 3]) for i in range(40)]
    rows.append((None, T0 + timedelta(days=9), None, None))  # moves the watermark
    late = {3, 5, 9, 12}
    parts = [[i for i in range(20) if i not in late], [*range(20, 33), 5, 3], [12, *range(33, 40), 9], [40]]
    out = run_disordered(spark, tmp_path, rows, schema, parts, lambda s: keyed.changes(s, ["k"], "ts", ["s"], ["n"], "1 day"))
    want = changes_only(spark.createDataFrame(rows[:40], schema), ["k"], "ts", ["s"], ["n"])
    assert sorted((r.n, r.s) for r in out.where("k IS NOT NULL").collect()) == sorted((r.n, r.s) for r in want.collect())


def test_bad_bars_of_a_stream_are_named_in_order_of_time(spark, tmp_path):
    schema = "asset string, seconds long, time long, open double, high double, low double, close double"
    bar = lambda t, o=5.0, h=6.0, l=4.0, c=5.0: ("A", 3600, t * 3600, o, h, l, c)
    rows = [bar(0), bar(1), bar(1), bar(2, h=1.0), bar(3, l=0.0), bar(5), bar(6, o=float("nan")), bar(7), bar(8, c=None), bar(9), bar(4000)]
    out = run_disordered(spark, tmp_path, rows, schema, [[0, 3, 5, 7], [1, 9, 2], [4, 6, 8], [10]], lambda s: keyed.rejected_series(s, "1 day"))
    got = sorted((r.time // 3600, r.problem) for r in out.collect())
    assert got == [(1, "duplicate"), (2, "malformed"), (3, "malformed"), (5, "gap"), (6, "malformed"), (8, "malformed")]


def test_facts_go_stale_without_new_rows(spark, tmp_path):
    schema = "asset string, label string, fetched timestamp, observed timestamp, value double, bias int, ttl_ms long"
    hour = lambda h: T0 + timedelta(hours=h)
    fact = lambda f, o, v=1.0, b=1, ttl=4: ("A", "x", hour(f), None if o is None else hour(o), v, b, ttl * 3_600_000)
    rows = [fact(0, 0), fact(2, 1), fact(20, 22), fact(30, 20), fact(40, None), fact(41, 41, v=None), fact(42, 42, v=0.0, b=-1), fact(50, 60, ttl=1), (None, None, hour(900), None, None, None, 0)]
    out = run_disordered(spark, tmp_path, rows, schema, [[0, 2], [1, 3, 5], [4, 6, 7], [8]], lambda s: keyed.fact_statuses(s, delay="3 days"))
    at = lambda h, ms=0: int((hour(h) - datetime(1970, 1, 1)).total_seconds() * 1000) + ms
    got = sorted((r.at_ms, r.status, r.bias) for r in out.where("asset IS NOT NULL").collect())
    assert got == [(at(0), "ok", 1), (at(2), "ok", 1), (at(5, 1), "stale", 0), (at(20), "future", 0), (at(22), "ok", 1), (at(24, 1), "stale", 0),
                   (at(30), "stale", 0), (at(40), "missing", 0), (at(41), "missing", 0), (at(42), "ok", -1), (at(46, 1), "stale", 0), (at(50), "future", 0), (at(60), "stale", 0)]


def test_statuses_are_those_of_the_batch_rule(spark):
    schema = "fetched timestamp, observed timestamp, now timestamp, value double, bias int, ttl_ms long"
    hours = [timedelta(hours=h) for h in (-30, -5, -1, 0, 1, 3, 30)]
    rows = [(T0, T0 + o, T0 + n, v, 1, ttl) for o in hours for n in hours if n >= timedelta(0) for v in (None, 1.0) for ttl in (0, 3_600_000, 7_200_000)]
    for row in decision.fact_status(spark.createDataFrame(rows, schema)).collect():
        ms = lambda t: int(t.timestamp() * 1000)
        told = keyed._Facts.statuses(ms(row.fetched), ms(row.observed), row.value, row.ttl_ms)
        assert [s for at, s in told if at <= ms(row.now)][-1] == row.status


def test_keys_share_groups_of_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "GROUPS", 2)
    schema = "k string, f double, ts timestamp, n bigint, s double"
    nan, big = float("nan"), (1 << 60) + 1
    states = [1.5, None, 2.5, 0.0]
    rows = [(None if i % 7 == 0 else f"k{i % 7}", [0.0, -0.0, nan, None][i % 4 if i % 3 else 0], T0 + timedelta(minutes=11 * i), big + i if i % 5 else None,
             states[(i // 40) % 4]) for i in range(400)]
    rows.append(("end", None, T0 + timedelta(days=90), None, None))  # moves the watermark
    late = set(range(150, 200, 3))
    parts = [[i for i in range(200) if i not in late], [*range(200, 401), *sorted(late, reverse=True)]]
    out = run_disordered(spark, tmp_path, rows, schema, parts, lambda s: keyed.changes(s, ["k", "f"], "ts", ["s"], ["n"], "2 days"))
    previous = F.lag(F.struct("s")).over(Window.partitionBy("k", "f").orderBy("ts", "n"))
    want = spark.createDataFrame(rows[:400], schema).withColumn("p", previous).where("p IS NULL OR NOT p.s <=> s")
    told = lambda df: sorted(map(repr, df.select("k", (F.col("f") + 0.0).alias("f"), "n", "s").collect()))
    assert told(out.where("k IS NULL OR k <> 'end'")) == told(want)
    assert out.count() > 40
