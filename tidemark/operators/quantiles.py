"""Exact order statistics per group, without gathering any group in one task.

`percentile` keeps every distinct value of a group in one buffer, which a cell holding a third of
all rows would not survive.  Here values are first counted (map-side) per group. A mergeable sketch
of each group (map-side too, of bounded size) names values just below and above every wanted rank;
they cut the group into buckets that keep its order. The few buckets holding a wanted rank are found
from exact bucket counts, and only those, a small share of the group whatever its values, are sorted.
The sketch decides how much is sorted, never the result: linear-interpolation quantiles, exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import col

UPPER_MIDDLE = "upper_middle"   # the element at index n // 2 of the sorted values


#: Accuracy of the sketch: its ranks are off by less than one in so many rows of the group.
SKETCH_ACCURACY = 5_000


def _cuts(probabilities: Sequence[float]) -> list[float]:
    """Probabilities just below and above each wanted one, further than the sketch may err."""
    margin = 4 / SKETCH_ACCURACY
    return sorted({min(1.0, max(0.0, p + side)) for p in probabilities for side in (-margin, margin)})


def bucket_of(value: Column, cuts: Column) -> Column:
    """How many of the sorted cuts lie at or below the value: never falls as the value rises."""
    return F.size(F.filter(cuts, lambda c: c <= value))


def exact_quantiles(df: DataFrame, keys: Sequence[str], measures: dict[str, tuple[str | Column, dict[str, float | str]]]) -> DataFrame:
    """One row per key with every requested statistic.

    `measures`: name -> (value column, {output name: probability in 0..1, or UPPER_MIDDLE}).
    """
    keys = list(keys)
    long = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_m"), col(value).cast("double").alias("_v"))
        for i, (value, _) in enumerate(measures.values())
    ]))).where("_v IS NOT NULL")
    probabilities = [0.5 if p == UPPER_MIDDLE else float(p) for _, specs in measures.values() for p in specs.values()]
    sketch = long.groupBy(*keys, "_m").agg(F.percentile_approx("_v", _cuts(probabilities), SKETCH_ACCURACY).alias("_cuts"))
    counted = long.groupBy(*keys, "_m", "_v").agg(F.count(F.lit(1)).alias("_c")).join(sketch, [*keys, "_m"]).select(
        *keys, "_m", "_v", "_c", bucket_of(F.col("_v"), F.col("_cuts")).alias("_b"))

    group = Window.partitionBy(*keys, "_m")
    running = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = (
        counted.groupBy(*keys, "_m", "_b").agg(F.sum("_c").alias("_bc"))
        .withColumn("_n", F.sum("_bc").over(group))
        .withColumn("_start", F.sum("_bc").over(running) - F.col("_bc"))
    )

    def wanted(i: int, specs: dict[str, float | str]) -> list[Column]:
        out = []
        for name, spec in specs.items():
            if spec == UPPER_MIDDLE:
                lo, frac = F.floor(F.col("_n") / 2), F.lit(0.0)
            else:
                position = (F.col("_n") - 1) * F.lit(float(spec))
                lo, frac = F.floor(position), position - F.floor(position)
            for side in (0, 1):
                out.append(F.struct(
                    F.lit(i).alias("m"), F.lit(name).alias("out"), F.lit(side).alias("side"),
                    F.least(lo + side, F.col("_n") - 1).alias("rank"), frac.alias("frac")))
        return out

    everything = F.array(*[w for i, (_, specs) in enumerate(measures.values()) for w in wanted(i, specs)])
    hit = F.filter(everything, lambda w: (w["m"] == F.col("_m")) & (w["rank"] >= F.col("_start"))
                   & (w["rank"] < F.col("_start") + F.col("_bc")))
    targets = buckets.withColumn("_w", hit).where(F.size("_w") > 0).select(*keys, "_m", "_b", "_start", "_w")

    inside = Window.partitionBy(*keys, "_m", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(targets, [*keys, "_m", "_b"]).withColumn("_end", F.col("_start") + F.sum("_c").over(inside))
    picked = ranked.select(*keys, "_v", F.explode(F.filter(
        "_w", lambda w: (w["rank"] >= F.col("_end") - F.col("_c")) & (w["rank"] < F.col("_end")))).alias("_w"))

    def statistic(name: str) -> Column:
        mine = F.col("_w.out") == name
        lo = F.max(F.when(mine & (F.col("_w.side") == 0), F.col("_v")))
        hi = F.max(F.when(mine & (F.col("_w.side") == 1), F.col("_v")))
        return (lo + (hi - lo) * F.max(F.when(mine, F.col("_w.frac")))).alias(name)

    outputs = [name for _, specs in measures.values() for name in specs]
    return picked.groupBy(*keys).agg(*[statistic(name) for name in outputs])


def clip_between(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies between its group's two quantiles, bounds included."""
    bounds = exact_quantiles(df, keys, {"v": (value, {"_lo": low, "_hi": high})})
    return df.join(bounds, list(keys)).where(F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
