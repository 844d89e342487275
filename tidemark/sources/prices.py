"""Landed price histories and boards: parallel arrays, nested charts, packed depth, unit repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import parsing
from tidemark.functions.numeric import denan, ratio, rnd
from tidemark.operators.pit import top_k
from tidemark.operators.rolling import Series
from tidemark.schemas import conform

HISTORY_SCHEMA = "s string, t array<string>, o array<string>, h array<string>, l array<string>, c array<string>, v array<string>"


def history_bars(landed: DataFrame, json: str = "json", scale: float = fv.BOARD_PRICE_SCALE) -> DataFrame:
    """Parallel string arrays to (symbol, pos, t, open, high, low, close, volume); bars without a close are dropped."""
    h = landed.withColumn("_h", F.from_json(json, HISTORY_SCHEMA)).where("_h.s = 'ok'")
    z = h.select("symbol", F.posexplode(F.arrays_zip("_h.t", "_h.o", "_h.h", "_h.l", "_h.c", "_h.v")).alias("pos", "_z"))
    price = lambda f: (parsing.number(f"_z.{f}") * scale)
    return z.select("symbol", "pos", parsing.number("_z.t").cast("long").alias("t"), price("o").alias("open"), price("h").alias("high"),
                    price("l").alias("low"), price("c").alias("close"), parsing.number("_z.v").alias("volume")).where("close IS NOT NULL AND t IS NOT NULL")


def valid_bars(bars: DataFrame, earliest: int = 946_684_800) -> DataFrame:
    """Consistent bars only, one per (symbol, t): the last of a duplicated time wins."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    ok = ((F.col("t") >= earliest) & (F.least(o, h, l, c) > 0) & o.isNotNull() & h.isNotNull() & l.isNotNull() & (F.col("volume") >= 0)
          & (l <= F.least(o, c)) & (h >= F.greatest(o, c)))
    return top_k(bars.where(ok), ["symbol", "t"], ["pos"], 1)


def bar_coverage(bars: DataFrame, at_least: int = 2) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")).withColumn("ok", F.col("bars") >= at_least)


def history_quotes(bars: DataFrame) -> DataFrame:
    """Backfilled bars as quotes known since 08:00 UTC of their own day, so that no look-back sees them earlier."""
    day = F.to_date(F.timestamp_seconds("t"))
    return conform(bars.select(
        "symbol", day.alias("as_of"), F.expr("make_timestamp(year(to_date(timestamp_seconds(t))), month(to_date(timestamp_seconds(t))), day(to_date(timestamp_seconds(t))), 8, 0, 0)").alias("fetched_at"),
        F.col("close").alias("price"), F.col("open").alias("open_price"), "high", "low", F.col("volume").cast("long").alias("volume")), "eq_quote")


CHART_SCHEMA = """chart struct<result: array<struct<meta: struct<longName: string, exchangeName: string, regularMarketPrice: double, regularMarketVolume: bigint,
 fiftyTwoWeekHigh: double, fiftyTwoWeekLow: double, regularMarketTime: bigint>, timestamp: array<bigint>,
 indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>>>>>>"""


def chart_bars(landed: DataFrame, json: str = "json", at_least: int = 20) -> DataFrame:
    """Nested chart documents to bars with the document's own quote beside them; short series are left out."""
    r = landed.withColumn("_r", F.get(F.from_json(json, CHART_SCHEMA)["chart"]["result"], F.lit(0))).where("_r IS NOT NULL").withColumn(
        "_q", F.get("_r.indicators.quote", F.lit(0)))
    z = r.select("symbol", F.col("_r.meta").alias("meta"), F.explode(F.arrays_zip(
        F.col("_r.timestamp").alias("t"), F.col("_q.open").alias("open"), F.col("_q.high").alias("high"), F.col("_q.low").alias("low"),
        F.col("_q.close").alias("close"), F.col("_q.volume").alias("volume"))).alias("_z")).where("_z.close IS NOT NULL AND _z.t IS NOT NULL")
    bars = z.select("symbol", "meta", F.to_date(F.timestamp_seconds("_z.t")).alias("as_of"), *[F.col(f"_z.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    counted = bars.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    return counted.where(F.col("_n") >= at_least).drop("_n")


def snapshot_rows(bars: DataFrame, price: str | None = None, digits: int = 3) -> DataFrame:
    """Newest state per symbol from its bars (symbol, as_of, close): change, RSI, momentum, averages, range."""
    s = Series("symbol", "as_of")
    b = bars.withColumn("_chg", F.col("close") - s.lag("close"))
    b = b.select("symbol", "as_of", "close", *([price] if price else []), s.lag("close").alias("_prev"), s.sma("close", 50).alias("_s50"),
                 s.sma("close", 200).alias("_s200"), s.rsi("_chg").alias("_rsi"), *[s.change_percent("close", k).alias(f"_m{k}") for k in (21, 63, 126)],
                 F.max("close").over(Window.partitionBy("symbol")).alias("_hi"), F.min("close").over(Window.partitionBy("symbol")).alias("_lo"),
                 s.back().alias("_back"))
    p = F.coalesce(F.nullif(F.col(price), F.lit(0.0)), F.col("close")) if price else F.col("close")
    up = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, p >= F.col(c)).otherwise(F.lit(False))
    return b.where("_back = 1").select(
        F.col("symbol").alias("s"), rnd(p, digits).alias("p"), rnd(p - F.when(F.col("_prev") != 0, F.col("_prev")), digits).alias("ch"),
        rnd((ratio(p, "_prev") - 1) * 100, 2).alias("chp"), rnd("_hi", digits).alias("h52"), rnd("_lo", digits).alias("l52"), rnd("_rsi", 1).alias("rsi"),
        rnd("_m21", 2).alias("m1"), rnd("_m63", 2).alias("m3"), rnd("_m126", 2).alias("m6"),
        F.when(up("_s50"), "up").otherwise("down").alias("d"), F.when(up("_s200"), "up").otherwise("down").alias("w"), F.col("as_of").alias("asof"))


def published_history(bars: DataFrame, sessions: int = 260, digits: int = 3) -> DataFrame:
    """Candles of the last sessions per symbol as one array; a missing open, high or low is drawn at the close."""
    tail = top_k(bars, ["symbol"], ["as_of"], sessions)
    pick = lambda c: rnd(F.coalesce(c, "close"), digits).alias(c)
    pts = F.struct("as_of", pick("open"), pick("high"), pick("low"), rnd("close", digits).alias("close"), F.coalesce("volume", F.lit(0)).cast("long").alias("volume"))
    return tail.groupBy("symbol").agg(F.array_sort(F.collect_list(pts)).alias("hist"))


# --- boards ---------------------------------------------------------------------------------

def board_quotes(board: DataFrame) -> DataFrame:
    """Packed board records (price in thousands, lots of ten, foreign value in hundreds) as quotes."""
    k = lambda c: parsing.number(c) * fv.BOARD_PRICE_SCALE
    rows = board.where(F.length(F.trim("sym")) > 0).select(
        F.trim("sym").alias("symbol"), "as_of", "fetched_at", k("lastPrice").alias("price"), k("r").alias("ref_price"), k("openPrice").alias("open_price"),
        k("highPrice").alias("high"), k("lowPrice").alias("low"), (parsing.number("lot") * fv.BOARD_LOT).cast("long").alias("volume"),
        (parsing.number("fBValue") * fv.BOARD_FOREIGN_VALUE_SCALE).alias("foreign_buy_value"), (parsing.number("fSValue") * fv.BOARD_FOREIGN_VALUE_SCALE).alias("foreign_sell_value"),
        parsing.number("fBVol").cast("long").alias("foreign_buy_vol"), parsing.number("fSVolume").cast("long").alias("foreign_sell_vol"))
    return conform(rows, "eq_quote")


def board_metrics(board: DataFrame, source: str = "board") -> DataFrame:
    """Depth, foreign room and put-through volume as series rows; an empty level gives no row.

    Every packed text becomes a row before it is read, so it is split and parsed once (see `parsing.packed_level`).
    """
    texts = {"foreign_room": "fRoom", "put_through_vol": "ptVol", **{f"bid{i}": f"g{i}" for i in (1, 2, 3)}, **{f"ask{i}": f"g{i + 3}" for i in (1, 2, 3)}}
    ids = ["_sym", "as_of", "fetched_at"]
    landed = board.where(F.length(F.trim("sym")) > 0).select(F.trim("sym").alias("_sym"), "as_of", "fetched_at", *[F.col(c).cast("string").alias(n) for n, c in texts.items()])
    rows = landed.unpivot(ids, list(texts), "_of", "_text").where("_text IS NOT NULL")
    level = ~F.col("_of").isin("foreign_room", "put_through_vol")
    first = F.when(level, F.substring_index("_text", "|", 1)).otherwise(F.col("_text"))
    second = F.substring_index(F.substring_index("_text", "|", 2), "|", -1)
    read = rows.select(*ids, "_of", level.alias("_level"), (level & F.contains("_text", F.lit("|"))).alias("_packed"),
                       parsing.number(first).alias("_first"), F.when(level, parsing.number(second)).alias("_second"))
    x, ordered = F.col("_first"), F.col("_packed") & (F.col("_first") > 0)
    value = (F.when(F.col("_level"), F.when(ordered, x * fv.BOARD_PRICE_SCALE)).when(F.col("_of") == "foreign_room", x * fv.BOARD_ROOM_SCALE)
             .otherwise(F.when(x != 0, x)))
    pairs = read.select(*ids, "_of", value.cast("double").alias("_value"), F.when(ordered, F.col("_second")).cast("double").alias("_volume"))
    long = pairs.unpivot([*ids, "_of"], ["_value", "_volume"], "_part", "value").where("value IS NOT NULL")
    field = F.when(F.col("_part") == "_value", F.col("_of")).otherwise(F.concat("_of", F.lit("_vol")))
    return _series_rows(long.select(*ids, field.alias("field"), "value"), source)


def _series(df: DataFrame, symbol: Column, fields: dict[str, Column], source: str) -> DataFrame:
    """Long rows vn.board.<symbol>.<field>; absent fields give none."""
    wide = df.select(symbol.alias("_sym"), "as_of", "fetched_at", *[c.cast("double").alias(n) for n, c in fields.items()])
    return _series_rows(wide.unpivot(["_sym", "as_of", "fetched_at"], list(fields), "field", "value").where("value IS NOT NULL"), source)


def _series_rows(long: DataFrame, source: str) -> DataFrame:
    return long.select(F.concat_ws(".", F.lit("vn.board"), "_sym", "field").alias("series"), "as_of", "value", F.lit(source).alias("source"), "fetched_at",
                       F.to_json(F.struct(F.col("_sym").alias("symbol"), "field")).alias("meta"))


def iboard_quotes(board: DataFrame) -> DataFrame:
    """Board records already in plain units, dated `yyyyMMdd`; an unreadable date falls back to the day of retrieval."""
    n = parsing.number
    rows = board.where(F.length(F.trim("stockSymbol")) > 0).select(
        F.trim("stockSymbol").alias("symbol"), F.coalesce(F.try_to_date(F.col("tradingDate").cast("string"), "yyyyMMdd"), F.to_date("fetched_at")).alias("as_of"),
        "fetched_at", "exchange", n("matchedPrice").alias("price"), n("refPrice").alias("ref_price"), n("openPrice").alias("open_price"), n("highest").alias("high"),
        n("lowest").alias("low"), n("nmTotalTradedQty").cast("long").alias("volume"), n("nmTotalTradedValue").alias("value"), n("buyForeignValue").alias("foreign_buy_value"),
        n("sellForeignValue").alias("foreign_sell_value"), n("buyForeignQtty").cast("long").alias("foreign_buy_vol"), n("sellForeignQtty").cast("long").alias("foreign_sell_vol"))
    return conform(rows, "eq_quote")


def iboard_metrics(board: DataFrame, source: str = "iboard") -> DataFrame:
    n = parsing.number
    fields = {"foreign_room": n("remainForeignQtty")}
    for i in (1, 2, 3):
        fields |= {f"bid{i}": n(f"best{i}Bid"), f"bid{i}_vol": n(f"best{i}BidVol"), f"ask{i}": n(f"best{i}Offer"), f"ask{i}_vol": n(f"best{i}OfferVol")}
    return _series(board.where(F.length(F.trim("stockSymbol")) > 0), F.trim("stockSymbol"), fields, source)


def first_of(*names: str) -> Column:
    """First alternative that is neither NULL nor NaN."""
    return F.coalesce(*[denan(F.col(f"`{n}`").cast("double")) for n in names])


def wide_board_quotes(board: DataFrame) -> DataFrame:
    """Flattened wide board: alternatives per field, placeholder rows without a symbol dropped, turnover from millions."""
    rows = board.withColumn("symbol", F.coalesce(F.col("`listing.symbol`"), F.col("symbol"))).where(F.length("symbol") > 0).select(
        "symbol", "as_of", "fetched_at", F.col("`listing.exchange`").alias("exchange"), first_of("match.match_price", "match.avg_match_price").alias("price"),
        first_of("listing.ref_price").alias("ref_price"), first_of("match.accumulated_volume").cast("long").alias("volume"),
        (first_of("match.accumulated_value") * fv.TURNOVER_MILLIONS).alias("value"), first_of("listing.listed_share").cast("long").alias("listed_share"),
        first_of("match.foreign_buy_value").alias("foreign_buy_value"), first_of("match.foreign_sell_value").alias("foreign_sell_value"))
    return conform(rows, "eq_quote")


def deepest_industry(symbols: DataFrame, exchanges: DataFrame, industries: DataFrame) -> DataFrame:
    """Listing reference: the most specific industry level per symbol, the first one on ties (`pos`)."""
    named = industries.where("icb_name IS NOT NULL")
    deepest = named.groupBy(F.trim("symbol").alias("symbol")).agg(F.max_by("icb_name", F.struct(F.coalesce("icb_level", F.lit(0)), -F.col("pos"))).alias("industry"))
    ex = exchanges.groupBy(F.trim("symbol").alias("symbol")).agg(F.max("exchange").alias("exchange"))
    return symbols.where(F.length(F.trim("symbol")) > 0).select(F.trim("symbol").alias("symbol"), "organ_name").join(ex, "symbol", "left").join(deepest, "symbol", "left")


def market_net(quotes: DataFrame) -> DataFrame:
    net = F.coalesce("foreign_buy_value", F.lit(0.0)) - F.coalesce("foreign_sell_value", F.lit(0.0))
    return quotes.agg(F.count(F.lit(1)).alias("rows"), F.sum(net).alias("foreign_net"))


def audit_foreign_value(quotes: DataFrame, band=fv.UNIT_BAND) -> DataFrame:
    """Value over volume must land near the price; otherwise a unit changed."""
    usable = (F.col("price") != 0) & (F.col("foreign_buy_vol") > 0) & (F.col("foreign_buy_value") != 0)
    implied = ratio(ratio("foreign_buy_value", "foreign_buy_vol"), "price")
    off = usable & ~((implied > band[0]) & (implied < band[1]))
    return quotes.agg(F.count_if(usable).alias("checked"), F.count_if(off).alias("off_vs_price"), F.min(F.when(off, F.col("symbol"))).alias("sample"))


def audit_room(rooms: DataFrame, board: DataFrame, band=fv.UNIT_BAND) -> DataFrame:
    """Foreign room (symbol, room) against listed shares `sh` and the published percentage `fr`."""
    t = rooms.join(board.select(F.col("s").alias("symbol"), "sh", "fr"), "symbol").where("sh > 0")
    over = F.col("room") > F.col("sh")
    implied = F.col("sh") * F.col("fr") / 100
    off = ~over & (F.col("fr") > 1) & (implied > 0) & ~(ratio("room", implied) > band[0]) | (~over & (F.col("fr") > 1) & (implied > 0) & ~(ratio("room", implied) < band[1]))
    return t.agg(F.count(F.lit(1)).alias("checked"), F.count_if(over).alias("exceeds_listed"), F.count_if(F.coalesce(off, F.lit(False))).alias("off_vs_published_pct"))


def unit_repairs(quotes: DataFrame, repaired_at, band=fv.UNIT_BAND) -> DataFrame:
    """Corrected copies of rows whose turnover was written in millions; originals stay, the later stamp wins."""
    return quotes.where(_unit_share(fv.TURNOVER_MILLIONS).between(*band)).withColumn("value", F.col("value") * fv.TURNOVER_MILLIONS).withColumn(
        "fetched_at", F.lit(repaired_at))


def _unit_share(scale: float) -> Column:
    usable = (F.col("value") > 0) & (F.col("price") > 0) & (F.col("volume") > 0)
    return F.when(usable, F.col("value") * scale / (F.col("price") * F.col("volume")))


def unit_split(quotes: DataFrame, band=fv.UNIT_BAND) -> DataFrame:
    return quotes.agg(F.count_if(_unit_share(fv.TURNOVER_MILLIONS).between(*band)).alias("rows_in_millions"),
                      F.count_if(_unit_share(1.0).between(*band)).alias("rows_already_plain"))
