"""Point-in-time reads over append-only observations, and the append itself."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.functions.numeric import clean_nulls
from tidemark.schemas import TABLES, conform


def _desc(columns: Sequence[str | Column]) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c).desc_nulls_last() for c in columns]


def known_at(df: DataFrame, at, column: str = "fetched_at") -> DataFrame:
    """What was known at an instant; apply before any latest-per-key."""
    return df.where(F.col(column) <= F.lit(at))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows of each key.

    The rank filter lets Spark limit each key inside every input partition before the shuffle,
    so one key holding a third of the rows still reaches its task as a few rows per partition.
    """
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*_desc(order)))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Newest observation per key; ties go down the order list."""
    return top_k(df, keys, order, 1)


#: Keys share this many slots; one number a slot is sent with the tasks.
SLOTS = 1 << 14


def maybe_newest(df: DataFrame, keys: Sequence[str | Column], at: Column, slots: int = SLOTS) -> DataFrame:
    """The rows without most of those that are older than their key's newest by `at`, a whole number; never without a newest one.

    A slot knows the least of its keys' newest instants; what is older there is newest of no key. Rows without an instant stay.
    Rows that are left are few where keys go on for as long as each other, so what reads them may sort and shuffle them.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots))
    newest = df.select(*[(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)], at.cast("long").alias("_at")).groupBy(
        *[f"_k{i}" for i in range(len(keys))]).agg(F.max("_at").alias("_at"))
    known = [-(1 << 63)] * slots
    for row in newest.groupBy(F.pmod(F.xxhash64(*[f"_k{i}" for i in range(len(keys))]), F.lit(slots)).alias("slot")).agg(
            F.min("_at").alias("at")).where("at IS NOT NULL").collect():  # at most one row a slot
        known[row["slot"]] = row["at"]
    least = F.element_at(F.split(F.lit(",".join(map(str, known))), ",").cast("array<bigint>"), (slot + 1).cast("int"))
    return df.where(at.isNull() | (at >= least))


def field_latest(df: DataFrame, keys: Sequence[str], fields: dict[str, str | None], order: Sequence[str]) -> list[Column]:
    """Aggregates giving, column by column, the newest value that satisfies its condition.

    `fields` maps a column to an SQL condition (None: not null).  Use inside one groupBy.
    """
    ordering = ", ".join(order)
    return [
        F.expr(f"max_by({name}, struct({ordering})) FILTER (WHERE {condition or name + ' IS NOT NULL'})").alias(name)
        for name, condition in fields.items()
    ]


def pit_latest(df: DataFrame, keys: Sequence[str], at, order: Sequence[str] = ("fetched_at",), column: str = "fetched_at") -> DataFrame:
    return latest(known_at(df, at, column), keys, order)


def recent_sessions(df: DataFrame, column: str, n: int) -> DataFrame:
    """One-row frame with the earliest of the newest n distinct values."""
    newest = df.select(column).distinct().orderBy(F.col(column).desc()).limit(n)
    return newest.agg(F.min(column).alias("_floor"))


def within_recent_sessions(df: DataFrame, column: str, n: int) -> DataFrame:
    # A scalar subquery: its value reaches the scan, so older partitions and row groups are not read.
    return df.where(F.col(column) >= recent_sessions(df, column, n).scalar())


def new_rows(incoming: DataFrame, existing: DataFrame | None, key: Sequence[str], order: Sequence[str | Column] | None = None) -> DataFrame:
    """Incoming rows whose key is stored nowhere yet; one row per key of the batch itself.

    With `order` the batch's first row in that order is the one kept.
    """
    batch = incoming.dropDuplicates(list(key)) if order is None else top_k(incoming, key, order, 1)
    return batch if existing is None else batch.join(existing.select(*key), list(key), "left_anti")


def append_observations(spark: SparkSession, path: str, table: str, rows: DataFrame, order: Sequence[str | Column] | None = None) -> DataFrame:
    """Append a batch to a stored table, ignoring keys already there; returns a one-row count.

    Files are partitioned by the day of observation; only those days of the stored table are
    compared.  Running the same batch again adds nothing.
    """
    t = TABLES[table]
    incoming = conform(clean_nulls(rows), t).withColumn("fetched_date", F.to_date(t.partition))
    stored = _stored_keys(spark, path, t)
    if stored is not None:
        days = incoming.select("fetched_date").distinct()
        stored = stored.join(days, "fetched_date", "left_semi").select(*t.key)
    fresh = new_rows(incoming, stored, t.key, order)
    counted = Observation()
    fresh.observe(counted, F.count(F.lit(1)).alias("rows_new")).write.mode("append").partitionBy("fetched_date").parquet(path)
    return spark.createDataFrame([(table, counted.get["rows_new"])], "table string, rows_new long")


def stored_or_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What a reader finds, or None where nothing was stored yet; any other error is one."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _stored_keys(spark: SparkSession, path: str, t) -> DataFrame | None:
    stored = stored_or_none(lambda: spark.read.parquet(path))
    return stored if stored is None else stored.select(*t.key, "fetched_date")


def latest_runs(run_log: DataFrame) -> DataFrame:
    """Run log as upserts: the last record per (run, collector)."""
    return latest(run_log, ["run_id", "collector"], ["finished_at", "started_at"])


def run_record(df: DataFrame, run_id: str, collector: str, started_at, finished_at, status: str = "ok") -> DataFrame:
    """Run-log row for a job's output counts: `df` is one row with rows_in, rows_new and any detail columns."""
    detail = [c for c in df.columns if c not in ("rows_in", "rows_new")]
    body = F.to_json(F.struct(*detail)) if detail else F.lit("{}")
    return df.select(
        F.lit(run_id).alias("run_id"), F.lit(collector).alias("collector"),
        F.lit(started_at).cast("timestamp").alias("started_at"), F.lit(finished_at).cast("timestamp").alias("finished_at"),
        F.lit(status).alias("status"), F.col("rows_in").cast("long").alias("rows_in"),
        F.col("rows_new").cast("long").alias("rows_new"), body.alias("detail"))


def merge_schemas(*frames: DataFrame) -> DataFrame:
    """Union of table versions; a column one of them lacks is NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


#: Rows of one (key, time bucket) that are ordered together; a fuller one is cut into CUTS + 1 pieces by time.
PIECE_ROWS = 100_000
CUTS = 255


def _pieces(df: DataFrame, keys: Sequence[str], at: str, bucket_seconds: int, piece_rows: int, cuts: int) -> DataFrame:
    """Rows with `_bucket`, and `_piece`: never falls with time inside a bucket, 0 in all but overfull buckets.

    A mergeable sketch of an overfull bucket's instants says where its pieces end, so a burst is spread over tasks
    by rank, not by the clock. Rows of one instant lie in one piece.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    df = df.withColumn("_bucket", F.floor(micros / F.lit(bucket_seconds * 1_000_000)))
    counted = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > piece_rows).drop("_n")
    crowded = df.join(counted, [*keys, "_bucket"], "left_semi").groupBy(*keys, "_bucket").agg(
        F.percentile_approx(micros, [k / (cuts + 1) for k in range(1, cuts + 1)], 10 * (cuts + 1)).alias("_cuts"))
    marked = df.join(crowded, [*keys, "_bucket"], "left")
    return marked.withColumn("_piece", F.coalesce(F.size(F.filter("_cuts", lambda c: c < micros)), F.lit(0))).drop("_cuts")


def asof_latest(probes: DataFrame, facts: DataFrame, keys: Sequence[str], probe_ts: str, fact_ts: str, fields: Sequence[str],
                tie: Sequence[str] = (), bucket_seconds: int = 3600, piece_rows: int = PIECE_ROWS, cuts: int = CUTS) -> DataFrame:
    """For every probe, the newest fact of its key at or before the probe's instant; a null key knows nothing.

    No key is gathered whole. Facts of one instant are reduced to the last of them and probes to their instants,
    both before the shuffle. These meet inside (key, time bucket, piece), see `_pieces`; what earlier pieces
    and buckets knew arrives as one carried row a piece: a prefix scan in segments.
    """
    keys, cols = list(keys), probes.columns
    payload = F.struct(F.col(fact_ts).cast("timestamp").alias("_t"), *[F.col(c).alias(c) for c in fields])
    order = F.struct(F.lit(0), *[F.col(c) for c in tie])
    known = facts.withColumn("_at", F.col(fact_ts).cast("timestamp")).groupBy(*keys, "_at").agg(F.max_by(payload, order).alias("_fact"))
    asked = probes.select(*keys, F.col(probe_ts).cast("timestamp").alias("_at")).distinct()
    events = _pieces(known.unionByName(asked.withColumn("_asks", F.lit(True)), allowMissingColumns=True), keys, "_at", bucket_seconds, piece_rows, cuts)
    place = ["_bucket", "_piece"]
    # What each piece leaves behind, and so what the next one starts with: one row a piece.
    ends = events.groupBy(*keys, *place).agg(F.expr("max_by(_fact, _at) FILTER (WHERE _fact IS NOT NULL)").alias("_end"))
    before = Window.partitionBy(*keys).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    # Of one instant the fact comes before the question.
    within = Window.partitionBy(*keys, *place).orderBy("_at", F.col("_asks").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    told = events.withColumn("_fact", F.last("_fact", ignorenulls=True).over(within)).where("_asks").join(carried, [*keys, *place], "left")
    hit = told.select(*keys, "_at", F.coalesce("_fact", "_carry").alias("_hit"))
    found = probes.withColumn("_at", F.col(probe_ts).cast("timestamp")).join(hit, [*keys, "_at"], "left")
    kind = dict(facts.dtypes)[fact_ts]
    return found.select(*[found[c] for c in cols], F.col("_hit._t").cast(kind).alias(f"{fact_ts}_found"), *[F.col(f"_hit.{c}").alias(c) for c in fields])


def changes_only(df: DataFrame, keys: Sequence[str], ts: str, fields: Sequence[str], tie: Sequence[str] = (),
                 bucket_seconds: int = 3600, piece_rows: int = PIECE_ROWS, cuts: int = CUTS) -> DataFrame:
    """Rows whose fields differ from their key's previous row (the first row of a key always counts).

    Rows are compared inside (key, time bucket, piece), see `_pieces`; a piece's first row is compared with the last
    row of the piece before, one row a piece.
    """
    keys, fields = list(keys), list(fields)
    state, place = F.struct(*fields), ["_bucket", "_piece"]
    d = _pieces(df, keys, ts, bucket_seconds, piece_rows, cuts)
    w = Window.partitionBy(*keys, *place).orderBy(ts, *tie)
    d = d.withColumn("_prev", F.lag(state).over(w))
    ends = d.groupBy(*keys, *place).agg(F.max_by(state, F.struct(ts, *tie)).alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy(*place))).select(*keys, *place, "_before")
    joined = d.join(before, [*keys, *place], "left").withColumn("_prev", F.coalesce("_prev", "_before"))
    return joined.where(F.col("_prev").isNull() | ~state.eqNullSafe(F.col("_prev"))).select(*df.columns)
