"""One row per listed company: quote, flow, history, room, depth, ratios and own-history percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.numeric import ratio, rnd
from tidemark.functions.text import exchange_name
from tidemark.operators.pit import field_latest, latest, maybe_newest, within_recent_sessions
from tidemark.operators.rolling import Series
from tidemark.session import shared, written

_POSITIVE = ("price", "open_price", "high", "low")
_ANY = ("ref_price", "volume", "value", "foreign_buy_value", "foreign_sell_value", "exchange")


def latest_quotes(quotes: DataFrame, order: Sequence[str] = ("fetched_at",), sessions: int = fv.QUOTE_WINDOW_SESSIONS) -> DataFrame:
    """Each column's newest real value inside the last sessions: sources carry different columns."""
    recent = within_recent_sessions(quotes, "as_of", sessions)
    ordering = list(dict.fromkeys(["as_of", *order]))
    fields = {c: f"{c} IS NOT NULL AND {c} > 0" for c in _POSITIVE} | {c: None for c in _ANY}
    quoted = F.expr(f"max_by(as_of, struct({', '.join(ordering)})) FILTER (WHERE price IS NOT NULL AND price > 0)")
    return recent.groupBy("symbol").agg(quoted.alias("as_of"), *field_latest(recent, ["symbol"], fields, ordering),
                                        F.max("fetched_at").alias("fetched_at"))


def share_counts(quotes: DataFrame, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    return latest(quotes.where("listed_share IS NOT NULL"), ["symbol"], list(order)).select("symbol", "listed_share")


def market_caps(quotes: DataFrame, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """Latest price times latest share count, in billions: two filtered aggregates, no join."""
    g = quotes.groupBy("symbol").agg(*field_latest(quotes, ["symbol"], {"price": None, "listed_share": None}, list(order)))
    return g.where("price IS NOT NULL AND listed_share IS NOT NULL").select(
        "symbol", (F.col("price") * F.col("listed_share") / 1e9).alias("cap"))


def foreign_flow(quotes: DataFrame, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """Net foreign value over the last 1, 5 and 20 observed days of each symbol."""
    ordering = list(order)
    return _flow_totals(quotes.where("foreign_buy_value IS NOT NULL OR foreign_sell_value IS NOT NULL").groupBy("symbol", "as_of").agg(
        *field_latest(quotes, [], {"foreign_buy_value": None, "foreign_sell_value": None}, ordering)))


def _flow_totals(stated: DataFrame) -> DataFrame:
    daily = stated.select("symbol", "as_of", (F.coalesce("foreign_buy_value", F.lit(0.0))
                                              - F.coalesce("foreign_sell_value", F.lit(0.0))).alias("net"))
    back = daily.withColumn("back", Series("symbol", "as_of").back())
    return back.groupBy("symbol").agg(
        *[F.sum(F.when(F.col("back") <= k, F.col("net"))).alias(f"net_{k}d") for k in (1, 5, 20)],
        F.count(F.lit(1)).alias("observed_days"))


def session_quotes(quotes: DataFrame, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """One row per symbol and session: its bar (newest priced observation), newest foreign values and newest share count.

    What `daily_bars`, `foreign_flow` and `share_counts` each take from all observations, in one shuffle and one order.
    """
    ordering = f"struct({', '.join(order)})"
    rows = quotes.select("symbol", "as_of", *dict.fromkeys([*order, "price", "volume", "foreign_buy_value", "foreign_sell_value", "listed_share"]))
    # Most sessions of a symbol have one observation: rows are dealt out before they are ordered, and so ordered once.
    daily = rows.repartition("symbol", "as_of").groupBy("symbol", "as_of").agg(
        F.expr(f"max_by(struct(price, volume), {ordering}) FILTER (WHERE price > 0)").alias("bar"),
        *field_latest(rows, [], {"foreign_buy_value": None, "foreign_sell_value": None}, list(order)),
        F.expr(f"max_by(struct({ordering} AS at, listed_share), {ordering}) FILTER (WHERE listed_share IS NOT NULL)").alias("share"))
    # The symbol's sessions meet once for their readers, as many as the calendar has.
    return shared(daily.repartition("symbol"), ["symbol"])


def price_history(bars: DataFrame, min_days: int = fv.MIN_PRICE_DAYS, max_gap: int = fv.MAX_GAP_DAYS) -> DataFrame:
    """Momentum, range, median volume and the last move against its own volatility.

    Returns across a gap longer than `max_gap` days are not one-day moves and are left out.
    """
    s = Series("symbol", "as_of")
    b = bars.select("symbol", "as_of", "price", "volume", s.back().alias("back"), s.ret("price").alias("ret"),
                    F.datediff("as_of", s.lag("as_of")).alias("gap"))
    usable = (F.col("gap") <= max_gap) & F.col("ret").isNotNull()

    def at(k: int) -> Column:
        return F.max(F.when(F.col("back") == k, F.col("price")))

    return b.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"), at(1).alias("last_price"),
        F.max(F.when(F.col("back") == 1, F.col("as_of"))).alias("last_price_date"),
        at(22).alias("price_1m"), at(64).alias("price_3m"), at(127).alias("price_6m"),
        F.max("price").alias("high_52w"), F.min("price").alias("low_52w"),
        F.median("volume").alias("median_volume"),
        F.stddev_samp(F.when(usable, F.col("ret"))).alias("ret_sd"),
        F.max(F.when(usable & (F.col("back") == 1), F.col("ret"))).alias("last_ret"),
    ).where(F.col("days") >= min_days)


def fundamental_percentiles(fundamentals: DataFrame, order: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """Latest value per (symbol, metric) and where it stands in that metric's own history.

    Dividend yield is zero until a payment is declared, so there the newest non-zero period wins.
    """
    observed = latest(fundamentals, ["symbol", "period", "metric"], list(order)).select("symbol", "period", "metric", "value")
    undeclared = (F.col("metric") == "dividend_yield") & (F.coalesce("value", F.lit(0.0)) == 0)
    w = Window.partitionBy("symbol", "metric")
    ranked = observed.withColumn("_rank", F.row_number().over(w.orderBy(undeclared, F.col("period").desc())))
    marked = ranked.withColumn("latest_value", F.max(F.when(F.col("_rank") == 1, F.col("value"))).over(w))
    return marked.groupBy("symbol", "metric").agg(
        F.max("latest_value").alias("latest_value"),
        F.max(F.when(F.col("_rank") == 1, F.col("period"))).alias("latest_period"),
        F.avg(F.when(F.col("value") <= F.col("latest_value"), 1.0).otherwise(0.0)).alias("percentile"),
        F.count(F.lit(1)).alias("history_n"))


def _board_part(n: int) -> Column:
    return F.split_part("series", F.lit("."), F.lit(n))


def _instant(metrics: DataFrame, column: str) -> Column:
    """A whole number that never falls as the instants of a column rise."""
    kind = dict(metrics.dtypes)[column]
    return F.unix_micros(column) if kind == "timestamp" else F.unix_date(F.col(column).cast("date")).cast("long")


def newest_board(metrics: DataFrame, fields: Sequence[str] = tuple(fv.DEPTH_FIELDS), prefix: str = "vn.board.") -> DataFrame:
    """Rows of the board that may tell a symbol's newest room or depth, written once for all that read them.

    Rooms are newest by retrieval, levels by observation; two passes over the board, whatever reads the rows.
    """
    room = F.col("series").endswith(".foreign_room")
    # The symbol and what stands before it, and up to the field: found without taking the name of every row to pieces.
    symbol, upto = F.substring_index("series", ".", 3), F.substring_index("series", ".", 4)
    level = (upto != symbol) & F.substring_index(upto, ".", -1).isin(list(fields))
    board = metrics.where(F.col("series").startswith(prefix) & (room | level))
    at = F.when(room, _instant(metrics, "fetched_at")).otherwise(_instant(metrics, "as_of"))
    return written(maybe_newest(board, [F.when(room, F.col("series")).otherwise(symbol), room], at))


def foreign_room(metrics: DataFrame) -> DataFrame:
    rooms = latest(metrics.where("series LIKE 'vn.board.%.foreign_room'"), ["series"], ["fetched_at"])
    return rooms.select(_board_part(3).alias("symbol"), F.col("value").alias("room"))


def board_depth(metrics: DataFrame, fields: Sequence[str] = tuple(fv.DEPTH_FIELDS), prefix: str = "vn.board.") -> DataFrame:
    """All depth levels of a symbol from one instant: the newest snapshot that carried any."""
    board = metrics.where(F.col("series").startswith(prefix)).select(
        F.split_part("series", F.lit("."), F.lit(3)).alias("symbol"),
        F.split_part("series", F.lit("."), F.lit(4)).alias("field"), "value", "as_of", "fetched_at",
    ).where(F.col("field").isin(list(fields)))
    # Levels are kept per instant, then the last instant wins; of older days most are left out before.
    board = maybe_newest(board, ["symbol"], _instant(board, "as_of"))
    instant = board.groupBy("symbol", "as_of", "fetched_at").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(_depth_key(f)) for f in fields])
    return latest(instant, ["symbol"], ["as_of", "fetched_at"])


def _depth_key(name: str) -> str:
    side, level = name[0], name[3]
    return f"{side}{level}" + ("v" if name.endswith("_vol") else "")


def metric_rules(keys: dict[str, str] = fv.METRIC_KEYS) -> list[tuple]:
    """metric, key, scale, zero means missing, low, high, publishes a percentile."""
    return [(metric, key, 100.0 if key in fv.PERCENT_KEYS else 1.0,
             key in fv.BANK_ONLY_KEYS or key in fv.ZERO_MISSING_KEYS,
             *fv.SANE_RANGES.get(key, (None, None)), key in fv.PERCENTILE_KEYS) for metric, key in keys.items()]


def published_ratios(percentiles: DataFrame, keys: dict[str, str] = fv.METRIC_KEYS, min_history: int = fv.MIN_PERCENTILE_HISTORY) -> DataFrame:
    """Wide ratios per symbol: renamed, in percent, false zeros and absurd values withheld."""
    rules = percentiles.sparkSession.createDataFrame(
        metric_rules(keys), "metric string, key string, scale double, zero_missing boolean, lo double, hi double, ranked boolean")
    joined = percentiles.join(F.broadcast(rules), "metric")        # one row per known metric, a fixed list
    value = F.col("latest_value") * F.col("scale")
    shown = joined.withColumn("v", value).where(
        F.col("latest_value").isNotNull()
        & ~((F.col("latest_value") == 0) & F.col("zero_missing"))
        & (F.col("lo").isNull() | F.col("v").between(F.col("lo"), F.col("hi"))))
    place = F.when(F.col("ranked") & (F.col("history_n") >= min_history) & ~((F.col("key") == "dy") & (F.col("v") == 0)),
                   rnd(F.col("percentile") * 100, 0))
    out = []
    for key in keys.values():
        mine = F.col("key") == key
        out.append(F.max(F.when(mine, rnd("v", 2))).alias(key))
        if key in fv.PERCENTILE_KEYS:
            out.append(F.max(F.when(mine, place)).alias(f"{key}_p"))
    return shown.groupBy("symbol").agg(*out)


def screener(listings: DataFrame, quotes: DataFrame, fundamentals: DataFrame, metrics: DataFrame | None = None,
             sectors: DataFrame | None = None, bars: DataFrame | None = None, listing_order: Sequence[str] = ("fetched_at",),
             quote_order: Sequence[str] = ("fetched_at",), fund_order: Sequence[str] = ("fetched_at",),
             keys: dict[str, str] = fv.METRIC_KEYS) -> DataFrame:
    """The published table. A missing input leaves its columns NULL, never zero."""
    base = latest(listings, ["symbol"], list(listing_order)).select("symbol", "organ_name", F.col("exchange").alias("_lx"), "industry")
    q = latest_quotes(quotes, quote_order).select("symbol", "as_of", "price", "ref_price", "open_price", "high", "low",
                                                  "volume", F.col("exchange").alias("_qx"))
    daily = session_quotes(quotes, quote_order)
    h = price_history(daily.where("bar IS NOT NULL").select("symbol", "as_of", "bar.price", "bar.volume") if bars is None else bars)
    shares = daily.groupBy("symbol").agg(F.max_by("share.listed_share", "share.at").alias("listed_share"))
    flows = _flow_totals(daily.where("foreign_buy_value IS NOT NULL OR foreign_sell_value IS NOT NULL"))
    t = (base.join(q, "symbol", "left").join(h, "symbol", "left")
         .join(shares, "symbol", "left").join(flows, "symbol", "left")
         .join(published_ratios(fundamental_percentiles(fundamentals, fund_order), keys), "symbol", "left"))
    if sectors is not None:  # the company table gets a row for each refetch: the newest stated sector counts
        stated = sectors.where("sector IS NOT NULL")
        newest = latest(stated, ["symbol"], ["fetched_at"]) if "fetched_at" in sectors.columns else stated.groupBy("symbol").agg(F.min("sector").alias("sector"))
        sectors = newest.select("symbol", "sector")
    t = t.join(sectors, "symbol", "left") if sectors is not None else t.withColumn("sector", F.lit(None).cast("string"))
    depth_cols: list[str] = []
    if metrics is not None:
        metrics = newest_board(metrics)
        d = board_depth(metrics).drop("as_of", "fetched_at")
        depth_cols = [c for c in d.columns if c != "symbol"]
        t = t.join(foreign_room(metrics), "symbol", "left").join(d, "symbol", "left")
    else:
        t = t.withColumn("room", F.lit(None).cast("double"))
    session = quotes.agg(F.max("as_of").alias("_session"))
    t = t.crossJoin(F.broadcast(session))                            # one row

    quoted = F.coalesce(F.col("price"), F.lit(0.0)) != 0
    from_history = ~quoted & F.col("last_price").isNotNull()
    reference_only = ~quoted & F.col("last_price").isNull() & (F.col("ref_price") != 0)
    p = F.when(quoted, F.col("price")).when(from_history, F.col("last_price")).when(reference_only, F.col("ref_price"))
    traded_on = F.when(quoted, F.col("as_of")).when(from_history, F.col("last_price_date"))
    last = F.col("last_price")

    def flow(src, need):
        return F.when((F.col(src) != 0) & (F.col("observed_days") >= need), rnd(F.col(src) / 1e9, 2))

    wide = F.col("high_52w") > F.col("low_52w")
    return t.withColumn("_p", p).select(
        F.col("symbol").alias("s"), F.col("organ_name").alias("n"),
        exchange_name(F.coalesce("_qx", "_lx")).alias("e"), F.col("industry").alias("i"), F.col("sector").alias("sec"),
        rnd("_p", 1).alias("p"),
        F.when(quoted & (F.col("ref_price") != 0), rnd((F.col("_p") - F.col("ref_price")) / F.nullif("ref_price", F.lit(0.0)) * 100, 2)).alias("ch"),
        F.when(reference_only, 1).alias("pr"),
        F.when(traded_on < F.col("_session"), traded_on).alias("pd"),
        F.when(F.col("volume") != 0, F.col("volume")).alias("v"),
        rnd("open_price", 1).alias("o"), rnd("high", 1).alias("h"), rnd("low", 1).alias("l"),
        *[(F.col(c).cast("long") if c.endswith("v") else rnd(c, 1)).alias(c) for c in depth_cols],
        F.when(F.col("listed_share") != 0, rnd(F.col("_p") * F.col("listed_share") / 1e9, 1)).alias("mc"),
        F.when(F.col("listed_share") != 0, F.col("listed_share")).alias("sh"),
        F.when((F.col("listed_share") != 0) & F.col("room").isNotNull(),
               rnd(ratio(F.greatest("room", F.lit(0.0)), "listed_share") * 100, 1)).alias("fr"),
        rnd((ratio(last, "price_1m") - 1) * 100, 1).alias("m1"),
        rnd((ratio(last, "price_3m") - 1) * 100, 1).alias("m3"),
        rnd((ratio(last, "price_6m") - 1) * 100, 1).alias("m6"),
        F.when(wide, rnd((last - F.col("low_52w")) / F.nullif(F.col("high_52w") - F.col("low_52w"), F.lit(0.0)) * 100, 0)).alias("pos52"),
        F.when(wide, rnd("high_52w", 1)).alias("h52"), F.when(wide, rnd("low_52w", 1)).alias("l52"),
        "days", rnd(F.when(F.col("ret_sd") > 0, ratio("last_ret", "ret_sd")), 1).alias("z"),
        flow("net_1d", 1).alias("f1"), flow("net_5d", 5).alias("f5"), flow("net_20d", 20).alias("f20"),
        *[F.col(c) for key in keys.values() for c in ([key, f"{key}_p"] if key in fv.PERCENTILE_KEYS else [key])])


def screener_coverage(rows: DataFrame) -> DataFrame:
    has = lambda c: F.count_if(F.col(c).isNotNull())
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), has("p").alias("priced"),
        F.count_if(F.col("pe").isNotNull() | F.col("pb").isNotNull()).alias("with_fundamentals"),
        has("f1").alias("with_foreign_flow"), has("i").alias("with_industry"), has("m3").alias("with_momentum"))


def publish_guard(current: DataFrame, previous: DataFrame, share: float = fv.PUBLISH_GUARD_SHARE) -> DataFrame:
    """One row saying whether the new build may replace the old; both sides reduce to one row first."""
    def size(df, tag):
        return df.agg(F.count(F.lit(1)).alias(f"rows_{tag}"), F.count_if(
            F.col("pe").isNotNull() | F.col("pb").isNotNull()).alias(f"fundamentals_{tag}"))

    both = size(current, "new").crossJoin(F.broadcast(size(previous, "old")))
    ok = (F.col("rows_new") > 0) & (F.col("rows_new") >= F.col("rows_old") * share) & (
        F.col("fundamentals_new") >= F.col("fundamentals_old") * share)
    return both.withColumn("ok", ok)


class PublishRefused(RuntimeError):
    pass


def require_publishable(current: DataFrame, previous: DataFrame, share: float = fv.PUBLISH_GUARD_SHARE) -> None:
    verdict = publish_guard(current, previous, share).first()
    if not verdict["ok"]:
        raise PublishRefused(f"new build covers too little of the previous one: {verdict.asDict()}")
