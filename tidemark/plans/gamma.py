"""Dealer gamma surfaces, batched over any number of (symbol, snapshot) chains.

Input chain: snapshot, spot, strike, kind ('C'/'P'), oi, iv (fraction), days to expiry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import parsing
from tidemark.functions.numeric import ratio, rnd
from tidemark.functions.options_math import YEAR_DAYS, expected_move, greeks, touch_probability
from tidemark.operators.pit import latest, top_k
from tidemark.session import written

KEY = "snapshot"


def chain_from_book(book: DataFrame, now: Column) -> DataFrame:
    """Landed book summaries (instrument_name, open_interest, mark_iv in percent, spot) to chain rows."""
    p = book.withColumn("_i", parsing.instrument("instrument_name")).where("_i IS NOT NULL")
    seconds = (F.unix_micros("_i.expiry") - F.unix_micros(now)) / 1e6
    return p.select(
        KEY, "spot", F.col("_i.strike").alias("strike"), F.col("_i.kind").alias("kind"),
        F.coalesce("open_interest", F.lit(0.0)).alias("oi"), (F.coalesce("mark_iv", F.lit(0.0)) / 100.0).alias("iv"),
        (seconds / 86400.0).alias("days"))


def usable(chain: DataFrame, max_days: float = fv.OPTION_MAX_DAYS, band: float = fv.STRIKE_BAND) -> DataFrame:
    return chain.where((F.col("oi") > 0) & (F.col("iv") > 0) & (F.col("days") > 0) & (F.col("days") <= max_days)
                       & (F.abs(F.col("strike") / F.col("spot") - 1) <= band))


def sign() -> Column:
    """Dealers are taken long calls and short puts."""
    return F.when(F.col("kind") == "C", 1.0).otherwise(-1.0)


def valued(chain: DataFrame) -> DataFrame:
    g = greeks("spot", "strike", F.col("days") / YEAR_DAYS, "iv")
    c = chain.withColumns({f"_{k}": v for k, v in g.items()})
    return c.select(
        *chain.columns, (F.col("_gamma") * F.col("oi") * F.col("spot") * F.col("spot") * 0.01).alias("notional"),
        (F.col("_vanna") * F.col("oi") * F.col("spot") * sign()).alias("vanna"),
        (F.col("_charm") * F.col("oi") * F.col("spot") * sign()).alias("charm"))


def by_strike(values: DataFrame) -> DataFrame:
    call = F.col("kind") == "C"
    return values.groupBy(KEY, "strike").agg(
        F.sum(F.col("notional") * sign()).alias("gex"),
        F.coalesce(F.sum(F.when(call, F.col("oi"))), F.lit(0.0)).alias("call_oi"),
        F.coalesce(F.sum(F.when(~call, F.col("oi"))), F.lit(0.0)).alias("put_oi"),
        F.first("spot").alias("spot"))


def totals(values: DataFrame) -> DataFrame:
    call = F.col("kind") == "C"
    g = values.groupBy(KEY).agg(
        F.first("spot").alias("spot"), F.count(F.lit(1)).alias("contracts"),
        F.coalesce(F.sum(F.when(call, F.col("notional"))), F.lit(0.0)).alias("call_gex"),
        F.coalesce(F.sum(F.when(~call, F.col("notional"))), F.lit(0.0)).alias("put_gex"),
        F.coalesce(F.sum(F.when(F.col("days") <= 1, F.col("notional") * sign())), F.lit(0.0)).alias("gex_0dte"),
        F.sum("vanna").alias("vanna"), F.sum("charm").alias("charm"),
        F.coalesce(F.sum(F.when(call, F.col("oi"))), F.lit(0.0)).alias("call_oi"),
        F.coalesce(F.sum(F.when(~call, F.col("oi"))), F.lit(0.0)).alias("put_oi"),
        F.min_by("iv", F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("iv"))).alias("atm_iv"),
        F.min("days").alias("nearest_days"))
    g = g.withColumn("horizon_h", F.least(F.col("nearest_days") * 24.0, F.lit(fv.HORIZON_HOURS)))
    return g.withColumn("em1", expected_move("spot", "atm_iv", "horizon_h")).withColumn(
        "em_day", expected_move("spot", "atm_iv", F.lit(24.0)))


def max_pain(strikes: DataFrame) -> DataFrame:
    """Strike with the least total pay-out, from running sums instead of strike pairs.

    The window runs over distinct strikes, which the tick grid inside the strike band bounds.
    """
    w = Window.partitionBy(KEY).orderBy("strike")
    below, above = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    k = F.col("strike")

    def total(c, frame):
        return F.coalesce(F.sum(c).over(frame), F.lit(0.0))

    pain = (k * total("call_oi", below) - total(k * F.col("call_oi"), below)
            + total(k * F.col("put_oi"), above) - k * total("put_oi", above))
    return strikes.withColumn("pain", rnd(pain, 4)).groupBy(KEY).agg(F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"))


#: Halvings of the first two rounds, and the width (of the spot price) at which a bracket is narrow enough.
FLIP_LEVELS, FLIP_WIDTH = (6, 4), 1e-9
#: Later rounds look at the interpolated zero and at these parts of the bracket's width to both sides of it.
FLIP_OFFSETS = tuple(4.0 ** -k for k in range(1, 8))


def gamma_flip(chain: DataFrame, band=fv.FLIP_BAND, most_rounds: int = 12) -> DataFrame:
    """Price at which the whole book's signed gamma changes sign, NULL without a change inside the band.

    Each round revalues the book at a few prices of the current bracket with one partially aggregated sum per
    (snapshot, price), so a snapshot holding a large part of all contracts is never gathered, and keeps a bracket
    with a change of sign. The first rounds are halvings (so of several changes it is the one that bisection
    finds); then the zero of the line between the bracket's ends is tried with prices ever closer to it on both
    sides, which narrows the bracket by orders of magnitude and by half at least (the middle is tried too). 112 valuations of a contract
    where the curve is smooth; only snapshots whose bracket is still too wide get more.
    """
    book = chain.groupBy(KEY, "spot", "strike", "kind", "iv", "days").agg(F.sum("oi").alias("oi"))
    years = F.col("days") / YEAR_DAYS

    def values_at(bracket: DataFrame, prices: Column) -> DataFrame:
        """The brackets with the book's value at the given prices of each, as a sorted list of (price, value)."""
        own = [c for c in bracket.columns if c != KEY]
        points = book.drop("spot").join(bracket.select("*", F.explode(prices).alias("_price")), KEY)
        gamma = greeks("_price", "strike", years, "iv")["gamma"]
        v = gamma * F.col("oi") * F.col("_price") * F.col("_price") * 0.01 * sign()
        sums = points.groupBy(KEY, *own, "_price").agg(F.sum(v).alias("_g"))
        return sums.groupBy(KEY, *own).agg(F.array_sort(F.collect_list(F.struct(F.col("_price").alias("p"), F.col("_g").alias("g")))).alias("_at"))

    def ends_of(bracket: DataFrame, lower: Column, upper: Column) -> DataFrame:
        return bracket.select(KEY, "spot", lower["p"].alias("_lo"), lower["g"].alias("_glo"), upper["p"].alias("_hi"), upper["g"].alias("_ghi"))

    edges = chain.groupBy(KEY).agg(F.first("spot").alias("spot"))
    first = F.array(F.col("spot") * band[0], F.col("spot") * band[1])
    ends = values_at(edges, first)
    bracket = ends_of(ends.where((F.col("_at")[0]["g"] < 0) != (F.col("_at")[1]["g"] < 0)), F.col("_at")[0], F.col("_at")[1])
    low_point = F.struct(F.col("_lo").alias("p"), F.col("_glo").alias("g"))
    high_point = F.struct(F.col("_hi").alias("p"), F.col("_ghi").alias("g"))
    width = F.col("_hi") - F.col("_lo")

    for levels in FLIP_LEVELS:
        parts = 2 ** levels
        inner = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda j: F.col("_lo") + width * j / F.lit(float(parts)))
        known = values_at(bracket, inner).withColumn("_all", F.concat(F.array(low_point), F.col("_at"), F.array(high_point)))
        halves = F.array(*[F.lit(2 ** i) for i in range(levels - 1, -1, -1)])
        same = lambda k: (F.get(F.col("_all"), k)["g"] < 0) == (F.col("_glo") < 0)
        known = known.withColumn("_k", F.aggregate(halves, F.lit(0), lambda k, h: F.when(same(k + h), k + h).otherwise(k)))
        bracket = ends_of(known, F.get("_all", F.col("_k")), F.get("_all", F.col("_k") + 1))

    def narrowed(bracket: DataFrame) -> DataFrame:
        zero = F.col("_lo") - F.col("_glo") * width / (F.col("_ghi") - F.col("_glo"))
        tried = F.array((F.col("_lo") + F.col("_hi")) / 2, zero, *[zero + side * width * part for part in FLIP_OFFSETS for side in (-1, 1)])
        inside = F.array_distinct(F.filter(tried, lambda p: (p > F.col("_lo")) & (p < F.col("_hi"))))
        known = values_at(bracket, inside).withColumn("_all", F.concat(F.array(low_point), F.col("_at"), F.array(high_point)))
        # The last price, from below, with the sign of the lower end: the next one has the other.
        steps = F.sequence(F.lit(0), F.size("_all") - 2)
        change = lambda k: ((F.get("_all", k)["g"] < 0) == (F.col("_glo") < 0)) & ((F.get("_all", k + 1)["g"] < 0) != (F.col("_glo") < 0))
        known = known.withColumn("_k", F.filter(steps, change)[0])
        return ends_of(known, F.get("_all", F.col("_k")), F.get("_all", F.col("_k") + 1))

    # One row a snapshot: written so that what follows does not value the book again.
    bracket = written(narrowed(narrowed(bracket)))
    wide = width > F.col("spot") * FLIP_WIDTH
    done = bracket.where(~wide)
    for _ in range(most_rounds):
        rest = bracket.where(wide)
        if rest.isEmpty():
            break
        bracket = written(narrowed(rest))
        done = done.unionByName(bracket.where(~wide))
    else:
        done = done.unionByName(bracket.where(wide))
    found = done.select(KEY, rnd((F.col("_lo") + F.col("_hi")) / 2, 2).alias("gamma_flip"))
    return edges.select(KEY).join(found, KEY, "left")


def pin_risk(strikes: DataFrame, moves: DataFrame) -> DataFrame:
    """Share of nearby gamma at its largest strike; zero when nothing is near."""
    near = strikes.join(moves.select(KEY, "em1"), KEY).where(
        (F.col("em1") > 0) & (F.abs(F.col("strike") - F.col("spot")) <= F.col("em1") * 2))
    return near.groupBy(KEY).agg(rnd(F.coalesce(ratio(F.max(F.abs("gex")), F.sum(F.abs("gex"))), F.lit(0.0)), 3).alias("pin_risk"))


def gamma_state(regime: Column, spot: Column, flip: Column, pin: Column) -> Column:
    near = F.coalesce((flip != 0) & (spot > 0) & (F.abs(spot / F.nullif(flip, F.lit(0.0)) - 1) < fv.NEAR_FLIP), F.lit(False))
    return (F.when(regime == "negative", "NEG_GEX_ACCEL").when(pin >= fv.PIN_SHARE, "POS_GEX_PIN")
            .when(near, "NEAR_FLIP").otherwise("POS_GEX_DAMP"))


def top_levels(strikes: DataFrame, moves: DataFrame, count: int = fv.TOP_LEVELS) -> DataFrame:
    """Strikes carrying the most gamma, with the chance of price reaching each."""
    top = top_k(strikes.withColumn("_size", F.abs("gex")), [KEY], [F.col("_size").desc(), F.col("strike")], count).join(
        moves.select(KEY, "em1", "em_day"), KEY)
    return top.select(
        KEY, "strike", rnd("gex", 1).alias("gex"), F.when(F.col("gex") >= 0, "call").otherwise("put").alias("side"),
        F.when(F.col("strike") > F.col("spot"), "above").otherwise("below").alias("rel"),
        rnd((F.col("strike") / F.col("spot") - 1) * 100, 2).alias("dist"), rnd("call_oi", 1).alias("call_oi"), rnd("put_oi", 1).alias("put_oi"),
        touch_probability("strike", "spot", "em1").alias("touch_prob"), touch_probability("strike", "spot", "em_day").alias("touch_24h"))


def surface(chain: DataFrame) -> DataFrame:
    """One row per snapshot."""
    kept = usable(chain)
    values = valued(kept)
    t, k = totals(values), by_strike(values)
    s = (t.join(gamma_flip(kept), KEY, "left").join(max_pain(k), KEY, "left").join(pin_risk(k, t), KEY, "left")
         .withColumn("pin_risk", F.coalesce("pin_risk", F.lit(0.0))).withColumn("net_gex", F.col("call_gex") - F.col("put_gex"))
         .withColumn("regime", F.when(F.col("net_gex") >= 0, "positive").otherwise("negative")))
    spot, em = F.col("spot"), F.col("em1")
    return s.select(
        KEY, "contracts", rnd("spot", 2).alias("spot"), rnd("net_gex", 1).alias("net_gex"), rnd("gex_0dte", 1).alias("net_gex_0dte"),
        rnd("call_gex", 1).alias("call_gex"), rnd("put_gex", 1).alias("put_gex"), rnd(ratio("put_oi", "call_oi"), 3).alias("pc_ratio"),
        rnd("vanna", 1).alias("vanna"), rnd("charm", 1).alias("charm"), rnd("atm_iv", 4).alias("atm_iv"), "regime",
        rnd(F.col("call_gex") + F.col("put_gex"), 1).alias("gex_notional"), "gamma_flip", "max_pain", rnd("horizon_h", 1).alias("horizon_h"),
        rnd(em, 2).alias("em1"), rnd("em_day", 2).alias("em_day"), rnd(em * 2, 2).alias("em2"), rnd(spot + em, 2).alias("em_up1"),
        rnd(spot - em, 2).alias("em_dn1"), rnd(spot + em * 2, 2).alias("em_up2"), rnd(spot - em * 2, 2).alias("em_dn2"),
        "pin_risk", gamma_state(F.col("regime"), spot, F.col("gamma_flip"), F.col("pin_risk")).alias("gex_sig"), "nearest_days")


def latest_surfaces(metrics: DataFrame, schema: str = "contracts long, updated_at string, sym string, spot double, net_gex double, gamma_flip double, max_pain double") -> DataFrame:
    """Newest stored surface per symbol, read back from the series table's JSON."""
    rows = metrics.where("series LIKE 'gex.%.surface'")
    newest = latest(rows, ["series"], ["as_of", "fetched_at"])
    return newest.select(F.split_part("series", F.lit("."), F.lit(2)).alias("symbol"), F.from_json("meta", schema).alias("_m")).select("symbol", "_m.*")
