"""Micro-batch sinks that survive retries and restarts.

Every batch of every streaming query owns the folder `run=<query id>/batch=<id>` of its store and
replaces it as a whole, so a batch that is run again after a failure leaves the same files. The query
id belongs to the checkpoint: a job that starts over with a new checkpoint numbers its batches from
zero again, but in a folder of its own. Nothing is updated in place.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.pit import latest, stored_or_none, top_k

_OWN = ("run", "batch")


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the streaming query that a checkpoint folder belongs to."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


class _Store:
    def __init__(self, path: str):
        self.path = path

    def _write(self, df: DataFrame, run: str, batch_id: int, part: str = "rows", by: Sequence[str] = ()) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{part}/run={run}/batch={batch_id}")

    def _others(self, spark: SparkSession, run: str, batch_id: int, part: str = "rows") -> DataFrame | None:
        """What other batches of this and of other runs stored; None for an empty store."""
        stored = stored_or_none(lambda: spark.read.option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}"))
        return stored if stored is None else stored.where((F.col("run") != run) | (F.col("batch") != batch_id))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows").drop(*_OWN)


class AppendStore(_Store):
    """Append by key: a key stored by any other batch is ignored, also across restarts.

    Files lie by a hash of the key (`slots`) and, with `time`, a column that rows of one key agree in, by its day. A batch
    is compared with the days and slots that it holds only: these are constants of the plan, so files of other folders are
    not read. A batch in which rows of one key lie on different days is refused: its key would be stored under both.
    """

    def __init__(self, path: str, key: Sequence[str], order: Sequence[str], time: str | None = None, slots: int = 1):
        super().__init__(path)
        self.key, self.order, self.time, self.slots = list(key), list(order), time, slots

    def _placed(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        by = {}
        if self.time:
            by["day"] = F.to_date(self.time)
        if self.slots > 1:
            by["slot"] = F.pmod(F.xxhash64(*self.key), F.lit(self.slots)).cast("int")
        return rows.withColumns(by) if by else rows, list(by)

    def known(self, batch: DataFrame, run: str, batch_id: int) -> DataFrame | None:
        """Keys that other batches have stored in the batch's days and slots."""
        stored = self._others(batch.sparkSession, run, batch_id)
        if stored is None:
            return None
        rows, by = self._placed(batch)
        if by:
            places = rows.select(*by).distinct().collect()  # at most the days of the batch times the slots
            for c in by:
                values = sorted({p[c] for p in places if p[c] is not None})
                blank = F.col(c).isNull() if any(p[c] is None for p in places) else F.lit(False)
                stored = stored.where(F.col(c).isin(values) | blank)
        return stored.select(*self.key)

    def write(self, batch: DataFrame, run: str, batch_id: int) -> None:
        if self.time:
            torn = batch.groupBy(*self.key).agg(F.min(F.to_date(self.time)).alias("a"), F.max(F.to_date(self.time)).alias("b")).where("a < b")
            if not torn.isEmpty():
                raise ValueError(f"rows of one key lie on different days of {self.time}: {torn.first().asDict()}")
        rows, by = self._placed(top_k(batch, self.key, [F.col(c).asc() for c in self.order], 1))
        known = self.known(batch, run, batch_id)
        if known is not None:
            rows = rows.join(known, self.key, "left_anti")
        self._write(rows, run, batch_id, by=by)

    def read(self, spark: SparkSession) -> DataFrame:
        return super().read(spark).drop(*self._placed_by())

    def _placed_by(self) -> list[str]:
        return [c for c, used in (("day", self.time), ("slot", self.slots > 1)) if used]


class LatestView(_Store):
    """Newest row per key, maintained by appending each batch's own newest rows; reading takes the newest of those, of
    batches before the last `fold` only what that has left."""

    def __init__(self, path: str, key: Sequence[str], order: Sequence[str]):
        super().__init__(path)
        self.key, self.order = list(key), list(order)

    def write(self, batch: DataFrame, run: str, batch_id: int) -> None:
        self._write(latest(batch, self.key, self.order), run, batch_id)

    def _parts(self, spark: SparkSession) -> tuple[DataFrame | None, DataFrame | None]:
        """The newest fold with what it covers, and the rows of batches that it does not."""
        rows = stored_or_none(lambda: spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows"))
        folds = stored_or_none(lambda: spark.read.option("basePath", f"{self.path}/folds").parquet(f"{self.path}/folds"))
        if rows is None or folds is None:
            return None, rows
        number = folds.agg(F.max("number")).first()[0]
        fold = folds.where(F.col("number") == number).drop("number")
        covered = spark.read.parquet(f"{self.path}/covered/number={number}")
        return fold, rows.join(covered, list(_OWN), "left_anti")

    def read(self, spark: SparkSession) -> DataFrame:
        fold, rest = self._parts(spark)
        if rest is None:
            return super().read(spark)  # fails as a read of nothing does
        rest = rest.drop(*_OWN)
        return latest(rest if fold is None else fold.unionByName(rest), self.key, self.order)

    def fold(self, spark: SparkSession) -> None:
        """Writes the newest row of every key as one part, which later reads take instead of the batches that it covers.

        Nothing is removed: a fold is a new folder, and what it covers is written before it appears.
        """
        rows = stored_or_none(lambda: spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows"))
        if rows is None:
            return
        folds = stored_or_none(lambda: spark.read.option("basePath", f"{self.path}/folds").parquet(f"{self.path}/folds"))
        number = 0 if folds is None else folds.agg(F.max("number")).first()[0] + 1
        rows.select(*[F.col(c).cast("string").alias(c) for c in _OWN]).distinct().write.mode("overwrite").parquet(f"{self.path}/covered/number={number}")
        self.read(spark).write.mode("overwrite").parquet(f"{self.path}/folds/number={number}")


class ObservationStore(_Store):
    """Append-only observations; ones older than the newest of other batches by more than `delay_seconds` are also
    listed as corrections.

    Each batch leaves one row with its newest event time; only those rows are read to judge the next batch.
    A late observation never rewrites anything: views that read the store again simply see it.
    """

    def __init__(self, path: str, event_time: str, delay_seconds: int):
        super().__init__(path)
        self.event_time, self.delay = event_time, delay_seconds

    def write(self, batch: DataFrame, run: str, batch_id: int) -> None:
        at = F.unix_seconds(F.col(self.event_time).cast("timestamp"))
        marks = self._others(batch.sparkSession, run, batch_id, "marks")
        newest = None if marks is None else marks.agg(F.max("newest")).first()[0]
        late = F.lit(False) if newest is None else F.coalesce(F.lit(newest) - at > self.delay, F.lit(False))
        self._write(batch.withColumn("late", late), run, batch_id)
        self._write(batch.agg(F.max(at).alias("newest")), run, batch_id, "marks")

    def corrections(self, spark: SparkSession) -> DataFrame:
        return self.read(spark).where("late").drop("late")


def deduplicated(stream: DataFrame, key: Sequence[str], event_time: str = "fetched_at", delay: str = "1 day") -> DataFrame:
    """Drop repeats of a key inside the watermark, with state that expires."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))


def run_available(stream: DataFrame, sink: _Store | str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there and stop. `sink` is a store or a folder for Parquet files."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if isinstance(sink, str):
        query = writer.format("parquet").option("path", sink).start()
    else:
        query = writer.foreachBatch(lambda batch, batch_id: sink.write(batch, run_id(batch.sparkSession, checkpoint), batch_id)).start()
    query.awaitTermination()
