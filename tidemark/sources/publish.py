"""Published artifacts: compact JSON, shards, and writing only what changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import clean_nulls
from tidemark.operators.pit import stored_or_none


def compact_json(df: DataFrame, out: str = "json", exclude: Sequence[str] = ()) -> DataFrame:
    """Each row as one JSON text without absent keys; non-finite numbers count as absent."""
    clean = clean_nulls(df, keep_infinite=False)
    body = F.struct(*[c for c in clean.columns if c not in exclude])
    return clean.select(*exclude, F.to_json(body, {"ignoreNullFields": "true"}).alias(out))


def shard_hashes(df: DataFrame, shard: Sequence[str], ignore: Sequence[str] = ("updated_at",)) -> DataFrame:
    """One fingerprint per shard that does not depend on row order or on the timestamp.

    Row hashes are added up as numbers, so a shard of any size reduces to one row map-side.
    """
    body = [c for c in df.columns if c not in (*shard, *ignore)]
    digest = F.sha2(F.to_json(F.struct(*body)), 256)
    part = lambda i: F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    rows = df.select(*shard, *[part(i).alias(f"_h{i}") for i in range(3)])
    g = rows.groupBy(*shard).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_h{i}").alias(f"_h{i}") for i in range(3)])
    return g.select(*shard, "n", F.sha2(F.concat_ws("|", "n", "_h0", "_h1", "_h2"), 256).alias("hash"))


def changed_shards(current: DataFrame, previous: DataFrame, shard: Sequence[str]) -> DataFrame:
    """Shards to write, drop or leave, from two manifests of fingerprints."""
    c = current.select(*shard, F.col("hash").alias("_new"))
    p = previous.select(*shard, F.col("hash").alias("_old"))
    state = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_new") == F.col("_old"), "same").otherwise("changed"))
    return c.join(p, list(shard), "full_outer").select(*shard, state.alias("state"))


def write_changed_shards(spark: SparkSession, df: DataFrame, path: str, shard: str, hash_ignore: Sequence[str] = ("updated_at",)) -> DataFrame:
    """Write only shards whose content differs from the stored manifest; returns the shard states.

    Each shard is a partition folder, replaced as a whole.  Manifests are versions next to them, none
    ever overwritten; the new one appears last, so an interrupted run is simply repeated.
    """
    manifest = f"{path}/_manifest"
    now = shard_hashes(df, [shard], hash_ignore)
    stored = stored_or_none(lambda: spark.read.option("basePath", manifest).parquet(manifest))
    version = 0 if stored is None else stored.agg(F.max("v")).first()[0]
    before = now.where(F.lit(False)) if stored is None else stored.where(F.col("v") == version)
    states_path = f"{path}/_states/v={version + 1}"
    changed_shards(now, before.select(shard, "hash"), [shard]).write.mode("overwrite").parquet(states_path)
    states = spark.read.parquet(states_path)
    todo = states.where("state IN ('added', 'changed')").select(shard)
    (df.join(todo, shard, "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .option("ignoreNullFields", "true").partitionBy(shard).json(f"{path}/shards"))
    now.write.mode("overwrite").parquet(f"{manifest}/v={version + 1}")
    return states
