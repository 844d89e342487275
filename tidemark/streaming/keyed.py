"""Keyed state on streams: rows of a key in order of their event time, however they arrive.

A row is held in its key's state until the watermark has passed it and is then handed over in order, so
late rows inside the watermark's delay count where they belong and nothing stored has to be read back.
What a key keeps is its last row and the rows of the delay; rows that come after the watermark are
dropped by Spark before they get here. Timers are event-time timers: a run that is repeated after a
failure gives the same rows. (Spark's own time to live of a state runs on the machine's clock and so
would not.)
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from itertools import islice
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Value, list and map states with timers need this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_AT = "_at_us"


#: Keys share this many groups of state. A call to the state costs far more than a row, so it is made for a group, not for a key.
GROUPS = 1 << 10
#: Rows that leave or are held as one block.
BLOCK_ROWS = 4096

# Spark hands columns over by these names; it would replace names that begin with an underscore.
_GROUP, _HELD_AT, _KEY, _ROW = "held_group", "held_at", "held_key", "held_row"


class InOrder(StatefulProcessor):
    """Hands each key's rows over in order of (event time, tie) once the watermark has passed them.

    State belongs to a group of keys: its held rows, packed in blocks, and what is remembered of each key. A subclass says
    in `due` what one key gives; the last thing it returns is the instant (ms) at which it wants to be called again without rows.
    """

    def __init__(self, keys: Sequence[str], held: str, tie: Sequence[str]):
        self.keys, self.names = list(keys), StructType.fromDDL(held).fieldNames()
        self.tie = [self.names.index(c) for c in (_AT, *tie)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "block binary")
        self.known = handle.getValueState("known", "keys binary")
        self.served: set[tuple[Any, int]] = set()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            at = frame[_HELD_AT].astype("int64").tolist()
            self._hold(list(zip(at, frame[_KEY], frame[_ROW], strict=True)))
            first = min(at) if first is None else min(first, *at)
        self.handle.registerTimer(_millis(first))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        if (tuple(key), mark) in self.served:  # another timer of the group, of the same micro-batch
            return iter(())
        self.served.add((tuple(key), mark))
        packed: dict[bytes, list[tuple]] = {}
        rest = []
        for (block,) in self.held.get():
            for at, of, row in pickle.loads(block):
                if at <= mark * 1000:
                    packed.setdefault(of, []).append((at, *pickle.loads(row)))
                else:
                    rest.append((at, of, row))
        if packed:
            self.held.clear()
            self._hold(rest)
            if rest:
                self.handle.registerTimer(_millis(min(at for at, _, _ in rest)))
        ready: dict[str, tuple[tuple, list[tuple]]] = {}
        for of, found in packed.items():
            of = pickle.loads(of)
            ready.setdefault(_identity(of), (of, []))[1].extend(found)
        before = pickle.loads(self.known.get()[0]) if self.known.exists() else {}
        given = self._handed_over(ready, before, mark)
        return iter([pd.DataFrame({_ROW: [pickle.dumps(r, -1) for r in block]}) for block in iter(lambda: list(islice(given, BLOCK_ROWS)), [])])

    def _handed_over(self, ready: dict, known: dict, mark: int) -> Iterator[dict]:
        # A key without rows may have asked to be woken, and the group does not know which one did.
        wakes, changed = [], False
        for name, (of, rows) in (ready | {k: (of, []) for k, (of, _) in known.items() if k not in ready} if self.wakes else ready).items():
            before = known[name][1] if name in known else None
            out, after, wake = self.due(sorted(rows, key=self._order), before, mark)
            if after is not None and after != before:
                known[name], changed = (of, after), True
            if wake is not None and wake > mark:
                wakes.append(wake)
            named = dict(zip(self.keys, of, strict=True))
            for r in out:
                yield named | r
        if changed:
            self.known.update((pickle.dumps(known, -1),))
        if wakes:
            self.handle.registerTimer(min(wakes))

    def _hold(self, rows: list[tuple]) -> None:
        if rows:
            self.held.appendList([(pickle.dumps(rows[k:k + BLOCK_ROWS], -1),) for k in range(0, len(rows), BLOCK_ROWS)])

    def _order(self, row: tuple) -> tuple:
        # Null before any value, as Spark sorts.
        return tuple((row[k] is not None, row[k]) if row[k] is not None else (False, 0) for k in self.tie)

    def _named(self, rows: list[tuple]) -> list[Row]:
        named = Row(*self.names)
        return [named(*r) for r in rows]

    #: Whether `due` ever asks to be called without rows.
    wakes = False

    def due(self, rows: list[tuple], before: tuple | None, mark: int) -> tuple[list[dict], tuple | None, int | None]:
        """(rows to emit, what is remembered of the key, instant to wake at) for a key's rows that are due at the watermark."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _identity(key: tuple) -> str:
    """Equal for keys that Spark groups together, also for values that Python finds unequal or cannot hash."""
    return repr(tuple(v + 0.0 if isinstance(v, float) else v for v in key))


def _millis(micros: int) -> int:
    return -(-micros // 1000)


def _ordered(stream: DataFrame, keys: Sequence[str], ts: str, delay: str, columns: Sequence[str]) -> tuple[DataFrame, str]:
    """The stream, its rows packed behind their group and their time with its watermark, and the schema of what is held of a row.

    A packed row goes through the state as it is: no value is turned into another type on its way.
    """
    keys, columns = list(keys), list(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [pa.array([pickle.dumps(v, -1) for v in zip(*(b.column(c).to_pylist() for c in names), strict=True)], pa.binary())
                     if names else pa.array([pickle.dumps((), -1)] * b.num_rows, pa.binary()) for names in (keys, columns)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (_GROUP, ts, _HELD_AT)), *parts], names=[_GROUP, ts, _HELD_AT, _KEY, _ROW])

    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withColumns({_HELD_AT: F.unix_micros(ts), _GROUP: F.pmod(F.xxhash64(*keys), F.lit(GROUPS))})
    kinds = dict(rows.dtypes)
    held = ", ".join([f"{_AT} bigint", *(f"`{c}` {kinds[c]}" for c in columns)])
    packed = rows.select(_GROUP, ts, _HELD_AT, *keys, *columns).mapInArrow(
        pack, f"{_GROUP} bigint, `{ts}` timestamp, {_HELD_AT} bigint, {_KEY} binary, {_ROW} binary")
    return packed.withWatermark(ts, delay), held


def _with_state(stream: DataFrame, rows: DataFrame, keys: Sequence[str], processor: InOrder, out: str) -> DataFrame:
    kinds = dict(stream.dtypes)
    schema = StructType.fromDDL(", ".join([*(f"`{k}` {kinds[k]}" for k in keys), out]))
    arrow = to_arrow_schema(schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([pickle.loads(r) for r in b.column(0).to_pylist()], schema=arrow)

    return rows.groupBy(_GROUP).transformWithStateInPandas(processor, f"{_ROW} binary", "Append", "EventTime").mapInArrow(unpack, schema)


class _Changes(InOrder):
    def __init__(self, keys: Sequence[str], held: str, tie: Sequence[str], fields: Sequence[str], columns: Sequence[str]):
        super().__init__(keys, held, tie)
        self.fields = [self.names.index(c) for c in fields]
        self.columns = [(c, self.names.index(c)) for c in columns]

    def due(self, rows, before, mark):
        out = []
        for row in rows:
            state = tuple(row[k] for k in self.fields)
            if state != before:
                out.append({c: row[k] for c, k in self.columns})
            before = state
        return out, before, None


def changes(stream: DataFrame, keys: Sequence[str], ts: str, fields: Sequence[str], tie: Sequence[str] = (), delay: str = "1 day") -> DataFrame:
    """Rows whose fields differ from their key's previous row in event time; the first row of a key counts.

    What `changes_only` gives for a whole table, for every row within the watermark's delay. Columns: all but the event time.
    """
    columns = [c for c in stream.columns if c not in (*keys, ts)]
    rows, held = _ordered(stream, keys, ts, delay, columns)
    kinds = dict(stream.dtypes)
    out = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return _with_state(stream, rows, keys, _Changes(keys, held, tie, fields, columns), out)


class _Series(InOrder):
    """Bars of a series: one that is malformed, repeats an instant or leaves out an interval is named."""

    def due(self, rows, before, mark):
        out = []
        previous = None if before is None else before[0]
        for row in self._named(rows):
            prices = [row.open, row.high, row.low, row.close]
            problem = None
            # A price that is not a number compares with nothing.
            if any(p is None or p != p or abs(p) == float("inf") for p in prices) or row.low <= 0 \
                    or row.high < max(row.open, row.close) or row.low > min(row.open, row.close):
                problem = "malformed"
            elif previous is not None and row.time <= previous:
                problem = "duplicate"
            elif previous is not None and row.time - previous != row.step:
                problem = "gap"
            if problem:
                out.append({"time": row.time, "problem": problem})
            previous = row.time
        return out, None if previous is None else (previous,), None


def rejected_series(bars: DataFrame, delay: str = "1 day", keys: Sequence[str] = ("asset", "seconds")) -> DataFrame:
    """(keys, time, problem) of bars (keys, time and seconds in seconds, open, high, low, close) that make their series unusable.

    A bar counts once the watermark has passed its exclusive close; bars of one instant come in order of their prices.
    """
    closed = bars.withColumn("closed_at", F.timestamp_seconds(F.col("time") + F.col("seconds"))).withColumn("step", F.col("seconds"))
    prices = ["open", "high", "low", "close"]
    rows, held = _ordered(closed, keys, "closed_at", delay, ["time", "step", *prices])
    return _with_state(closed, rows, keys, _Series(keys, held, ["time", *prices]), "time bigint, problem string")


class _Facts(InOrder):
    """The newest fact of a key (fetched, observed, value, bias, ttl, told) and the instants at which its status changes."""

    wakes = True

    @staticmethod
    def statuses(fetched: int, observed: int | None, value: float | None, ttl: int) -> list[tuple[int, str]]:
        """(instant, status) from retrieval on, in ms; each holds until the next."""
        if observed is None or value is None:
            return [(fetched, "missing")]
        last = min(observed, fetched) + ttl
        out = [(fetched, "future"), (observed, "ok")] if observed > fetched else [(fetched, "ok")]
        # A fact that is too old when it arrives, or before its own time comes, is never "ok".
        out = [(at, s) for at, s in out if s == "future" or at <= last]
        return [*out, (max(last + 1, observed, fetched), "stale")]

    def due(self, rows, before, mark):
        out: list[dict] = []

        def told(until: int, strictly: bool) -> None:
            """Statuses of the fact in memory that begin by `until` and have not been told yet."""
            nonlocal before
            fetched, observed, value, bias, ttl, last = before
            for at, status in self.statuses(fetched, observed, value, ttl):
                if at > last and (at < until or (at == until and not strictly)):
                    ok = status == "ok"
                    out.append({"at_ms": at, "status": status, "value": value, "observed_ms": observed, "fetched_ms": fetched, "bias": (bias or 0) if ok else 0})
                    last = at
            before = (fetched, observed, value, bias, ttl, last)

        newest: dict[int, Row] = {}
        for row in self._named(rows):  # of one instant the last in order
            newest[row._at_us // 1000] = row
        for at, row in newest.items():
            if before is not None:
                told(at, strictly=True)
            before = (at, row.observed_ms, row.value, row.bias, row.ttl_ms, at - 1)
        if before is None:
            return out, None, None
        told(mark, strictly=False)
        later = [at for at, _ in self.statuses(before[0], before[1], before[2], before[4]) if at > mark]
        return out, before, min(later, default=None)


def fact_statuses(facts: DataFrame, keys: Sequence[str] = ("asset", "label"), delay: str = "1 day") -> DataFrame:
    """Status log of the newest fact of every key: (keys, at_ms, status, value, observed_ms, fetched_ms, bias).

    `facts`: keys, fetched, observed, value, bias, ttl_ms. A fact's own clock goes on without new rows: when the
    watermark passes its end of life, "stale" is told. The status at an instant is the last one told by then;
    statuses and ties are those of `fact_status` and of `facts_as_known`.
    """
    rows = facts.select(*keys, F.col("fetched").cast("timestamp").alias("fetched"), F.unix_millis(F.col("observed").cast("timestamp")).alias("observed_ms"),
                        F.col("value").cast("double").alias("value"), F.col("bias").cast("int").alias("bias"), F.col("ttl_ms").cast("long").alias("ttl_ms"))
    # Whole milliseconds, so that facts of one instant are told apart by the tie alone.
    rows = rows.where(F.col("fetched").isNotNull()).withColumn("fetched", F.timestamp_millis(F.unix_millis("fetched")))
    packed, held = _ordered(rows, keys, "fetched", delay, ["observed_ms", "value", "bias", "ttl_ms"])
    out = "at_ms bigint, status string, value double, observed_ms bigint, fetched_ms bigint, bias int"
    return _with_state(rows, packed, keys, _Facts(keys, held, ["observed_ms", "value", "bias"]), out)


def run_stateful(stream: DataFrame, folder: str, checkpoint: str, partitions: int | None = None) -> None:
    """Process everything that is there and stop; rows go to Parquet files in `folder`.

    The state has as many partitions as the cluster has cores, or `partitions`; the checkpoint keeps the first run's number.
    """
    spark = stream.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE,
              "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).format("parquet").option(
            "path", folder).start().awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
