"""Frame-based statistics over ordered series.

Every window here is partitioned by a series key whose rows were first reduced to one per
time step, so a partition is bounded by the calendar however many raw rows a key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numeric import col, ratio


class Series:
    """Columns over one ordered series: `Series(["symbol"], "as_of")`."""

    def __init__(self, keys: str | Sequence[str], order: str | Sequence[str]):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.order = [order] if isinstance(order, str) else list(order)
        self.window: WindowSpec = Window.partitionBy(*self.keys).orderBy(*self.order)

    def rows(self, start: int, end: int = 0) -> WindowSpec:
        return self.window.rowsBetween(start, end)

    @property
    def so_far(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    def index(self) -> Column:
        return F.row_number().over(self.window) - 1

    def back(self) -> Column:
        """1 for the newest row."""
        return F.row_number().over(Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in self.order]))

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(col(c), n).over(self.window)

    def ret(self, c) -> Column:
        return ratio(c, self.lag(c)) - 1

    def change_percent(self, c, n: int) -> Column:
        return (ratio(c, self.lag(c, n)) - 1) * 100

    def sma(self, c, n: int) -> Column:
        """Mean of the last n, NULL until there are n."""
        w = self.rows(-(n - 1))
        return F.when(F.count(F.lit(1)).over(w) >= n, F.sum(col(c)).over(w) / F.lit(float(n)))

    def high(self, c, n: int) -> Column:
        return F.max(col(c)).over(self.rows(-(n - 1)))

    def low(self, c, n: int) -> Column:
        return F.min(col(c)).over(self.rows(-(n - 1)))

    def count(self, n: int) -> Column:
        return F.count(F.lit(1)).over(self.rows(-(n - 1)))

    def sum_min_obs(self, c, n: int, at_least: int) -> Column:
        w = self.rows(-(n - 1))
        return F.when(F.count(col(c)).over(w) >= at_least, F.sum(col(c)).over(w))

    def prior_values(self, c, n: int) -> Column:
        """The previous n values that are neither missing nor zero; the current one is left out.

        Materialise as a column before deriving from it: every mention of a frame is evaluated anew.
        """
        return F.collect_list(F.when(col(c) != 0, col(c))).over(self.rows(-n, -1))

    def stdev_of_returns(self, ret, prices: int) -> Column:
        """Sample deviation of the returns inside the last `prices` prices; 0 for fewer than two."""
        w = self.rows(-(prices - 2))
        return F.coalesce(F.when(F.count(col(ret)).over(w) >= 2, F.stddev_samp(col(ret)).over(w)), F.lit(0.0))

    def cumulative(self, c) -> Column:
        return F.sum(col(c)).over(self.so_far)

    def crossed_up(self, fast: str, slow: str) -> Column:
        return (self.lag(fast) <= self.lag(slow)) & (F.col(fast) > F.col(slow))

    def rsi(self, change: str, n: int = 14) -> Column:
        """Simple-average RSI over the last n changes; 100 when nothing fell."""
        w = self.rows(-(n - 1))
        up = F.sum(F.greatest(F.col(change), F.lit(0.0))).over(w) / F.lit(float(n))
        down = F.sum(F.greatest(-F.col(change), F.lit(0.0))).over(w) / F.lit(float(n))
        value = F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))))
        return F.when(F.count(F.col(change)).over(w) >= n, value)


def median_of(values: Column) -> Column:
    """Median of an array, NULL when empty."""
    ordered = F.array_sort(values)
    mid = F.floor(F.size(values) / 2).cast("int")
    odd = F.size(values) % 2 == 1
    return F.when(odd, F.get(ordered, mid)).when(F.size(values) > 0, (F.get(ordered, mid - 1) + F.get(ordered, mid)) / 2)


def sample_deviation(values: Column) -> Column:
    """Sample deviation of an array without nulls, by the steps of `stddev_samp`; NULL for fewer than two."""
    def step(s, x):
        n = s["n"] + 1
        delta = x - s["mean"]
        return F.struct(n.alias("n"), (s["mean"] + delta / n).alias("mean"), (s["m2"] + delta * (delta - delta / n)).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(values, start, step, lambda s: F.when(s["n"] >= 2, F.sqrt(s["m2"] / (s["n"] - 1))))


def with_obv(df, series: Series, price: str = "price", volume: str = "volume", out: str = "obv"):
    step = F.signum(F.col(price) - series.lag(price)) * F.coalesce(F.col(volume).cast("double"), F.lit(0.0))
    return df.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn(out, series.cumulative("_step")).drop("_step")


def smoothed(values: Column, n: int, alpha: float) -> Column:
    """Exponential smoothing seeded with the mean of the first n; NULL before. Array in, array out."""
    seed = F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x) / F.lit(float(n))
    blanks = F.array_repeat(F.lit(None).cast("double"), n - 1)
    start = F.concat(blanks, F.array(seed))
    rest = F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))
    run = F.aggregate(rest, start, lambda acc, x: F.concat(acc, F.array(
        F.element_at(acc, -1) + F.lit(alpha) * (x - F.element_at(acc, -1)))))
    return F.when(F.size(values) >= n, run)
