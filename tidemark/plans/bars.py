"""Daily equity bars: one row per (symbol, session) out of many observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pit import latest


def daily_bars(quotes: DataFrame, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """Newest priced observation of each session, with turnover and net foreign value.

    Turnover falls back to price x volume where a source published none.
    """
    priced = quotes.where("price > 0").select(
        "symbol", "as_of", "price", "volume",
        F.coalesce("value", F.col("price") * F.col("volume")).alias("turnover"),
        (F.coalesce("foreign_buy_value", F.lit(0.0)) - F.coalesce("foreign_sell_value", F.lit(0.0))).alias("foreign_net"),
        *[c for c in dict.fromkeys([*order, "value"]) if c not in ("symbol", "as_of", "price", "volume")],
    )
    return latest(priced, ["symbol", "as_of"], list(order)).select(
        "symbol", "as_of", "price", "volume", "turnover", "foreign_net")
