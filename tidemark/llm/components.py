"""Connected components of a graph of long ids, by alternating large-star and small-star rounds.

Each round is two aggregates and two joins over the edges; a node that holds a large share of the
edges is combined before its shuffle and split by the skew join. Edges of a round are written to
the shared checkpoint folder, so a round never recomputes the ones before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable number of each of 0..n-1 over the links a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (before == label).all():
            break
    return label


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u long, v long) links -> (node, root): every linked node with the least node it reaches."""
    current = cut_lineage(_clean(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
    state = None
    while True:
        current = cut_lineage(_clean(_small_star(_clean(_large_star(current)))))
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
