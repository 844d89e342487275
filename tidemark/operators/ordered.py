"""Order-dependent summaries (running peak, drawdown, streaks) as mergeable pieces.

A drawdown over all trades looks like one long pass.  Instead each stretch of trades becomes a small
record that can be merged with the next stretch; stretches are per symbol, then per slice of the
ordering key, then the whole.  No task ever holds more than one stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_TRACKS = ("r", "net")


def leaf(r: Column, net: Column, reason: Column) -> Column:
    """Record of a single trade."""
    loss = (r <= 0).cast("long")
    fields = [F.lit(1).cast("long").alias("n")]
    for name, x in zip(_TRACKS, (r, net)):
        fields += [x.alias(f"{name}_sum"), (x > 0).cast("long").alias(f"{name}_wins"), x.alias(f"{name}_low"),
                   F.greatest(x, F.lit(0.0)).alias(f"{name}_peak"), F.least(x, F.lit(0.0)).alias(f"{name}_dd")]
    fields += [F.greatest(r, F.lit(0.0)).alias("gain"), F.least(r, F.lit(0.0)).alias("loss")]
    fields += [loss.alias("lead"), loss.alias("tail"), loss.alias("streak")]
    fields += [F.coalesce((reason == x).cast("long"), F.lit(0).cast("long")).alias(x) for x in ("stop", "target", "time")]
    return F.struct(*fields)


def merge(a: Column, b: Column) -> Column:
    """Record of stretch a followed by stretch b."""
    fields = [(a["n"] + b["n"]).alias("n")]
    for t in _TRACKS:
        fields += [
            (a[f"{t}_sum"] + b[f"{t}_sum"]).alias(f"{t}_sum"), (a[f"{t}_wins"] + b[f"{t}_wins"]).alias(f"{t}_wins"),
            F.least(a[f"{t}_low"], a[f"{t}_sum"] + b[f"{t}_low"]).alias(f"{t}_low"),
            F.greatest(a[f"{t}_peak"], a[f"{t}_sum"] + b[f"{t}_peak"]).alias(f"{t}_peak"),
            F.least(a[f"{t}_dd"], b[f"{t}_dd"], a[f"{t}_sum"] + b[f"{t}_low"] - a[f"{t}_peak"]).alias(f"{t}_dd"),
        ]
    fields += [(a["gain"] + b["gain"]).alias("gain"), (a["loss"] + b["loss"]).alias("loss")]
    fields += [
        F.when(a["lead"] == a["n"], a["n"] + b["lead"]).otherwise(a["lead"]).alias("lead"),
        F.when(b["tail"] == b["n"], b["n"] + a["tail"]).otherwise(b["tail"]).alias("tail"),
        F.greatest(a["streak"], b["streak"], a["tail"] + b["lead"]).alias("streak"),
    ]
    fields += [(a[x] + b[x]).alias(x) for x in ("stop", "target", "time")]
    return F.struct(*fields)


def _fold(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.col("_rec").alias("rec"))))
    g = df.groupBy(*keys).agg(parts.alias("_parts"))
    recs = F.transform("_parts", lambda p: p["rec"])
    return g.select(*keys, recs.alias("_recs")).select(*keys, F.aggregate(
        F.slice("_recs", 2, F.size("_recs")), F.element_at("_recs", 1), merge).alias("_rec"))


def track_record(trades: DataFrame, group: Sequence[str], series: str, weight: str, step: str) -> DataFrame:
    """One merged record per group; order is weight descending, then series, then step.

    `trades` carries r, net and reason.  A series' trades are bounded by the calendar. Series are dealt
    into ranges of that order with about as many series each, so equal or unknown weights share no slice.
    """
    rows = trades.withColumn("_rec", leaf(F.col("r"), F.col("net"), F.col("reason")))
    per_series = _fold(rows.withColumn("_w", F.coalesce(F.col(weight), F.lit(0.0))), [*group, "_w", series], [F.col(step)])
    ranges = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = per_series.repartitionByRange(ranges, *group, -F.col("_w"), F.col(series)).withColumn("_slice", F.spark_partition_id())
    per_slice = _fold(sliced, [*group, "_slice"], [-F.col("_w"), F.col(series)])
    return _fold(per_slice, list(group), [F.col("_slice")]).select(*group, "_rec.*")
