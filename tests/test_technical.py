import pytest

from tidemark import fixed_values as fv
from tidemark.plans import decision, gamma, technical

HOUR = 3600
NOW = 1_790_000_000_000
COLS = "asset string, seconds long, time long, open double, high double, low double, close double"


def rows(n=500, flat=False, asset="BTC"):
    start = NOW // 1000 - n * HOUR - 60
    if flat:
        return [(asset, HOUR, start + i * HOUR, 100.0, 101.0, 99.0, 100.0) for i in range(n)]
    return [(asset, HOUR, start + i * HOUR, 100.0 + i, 102.0 + i, 99.0 + i, 101.0 + i) for i in range(n)]


def features(spark, data):
    return technical.features(spark.createDataFrame(data, COLS), NOW)


def test_monotone_bars(spark):
    f = features(spark, rows()).first()
    assert abs(f.adx - 100) < 1e-9 and abs(f.atr - 3) < 1e-9 and f.er == 1 and f.direction == 1 and f.upper == 600
    assert f.breakout_up is None and f.breakout_down is None        # closes at the channel, not beyond it


def test_fresh_break_and_lost_level(spark):
    data = rows()
    jumped = data[:-1] + [data[-1][:4] + (610.0, 598.0, 609.0)]
    up = features(spark, jumped).first().breakout_up
    assert up.level == 600 and up.fresh and not up.retest and not up.invalid
    last = data[-1]
    fell = [(a, s, t - HOUR, o, h, l, c) for a, s, t, o, h, l, c in jumped] + [("BTC", HOUR, last[2], 595.0, 596.0, 590.0, 591.0)]
    up = features(spark, fell).first().breakout_up
    assert up.level == 600 and not up.fresh and up.invalid


def test_forming_bar_changes_nothing(spark):
    forming = ("BTC", HOUR, NOW // 1000 - 60, 10000.0, 10001.0, 1.0, 2.0)
    assert features(spark, rows() + [forming]).collect() == features(spark, rows()).collect()


def test_flat_market(spark):
    f = features(spark, rows(flat=True)).first()
    assert (f.adx, f.er, f.direction) == (0, 0, 0)


@pytest.mark.parametrize("change", [lambda r: r[:490] + r[491:], lambda r: r + [r[-1]], lambda r: r[:-1] + [r[-1][:5] + (-1.0,) + r[-1][6:]], lambda r: r[:100]])
def test_broken_series_give_no_features(spark, change):
    assert features(spark, change(rows())).count() == 0


def verdict(spark, d=1, f=None, fast=None, **inp):
    side = {"count": 500, "closed_at": NOW - 60000, "close": 100 + d * 0.4, "open": 100.0, "high": 101.0, "low": 99.0, "atr": 1.0, "adx": 30.0, "er": 0.6, "slope": d * 0.6,
            "ema20": 100.0, "ema50": 99.0, "direction": d, "width_pct": 50.0, "upper": 100.0, "lower": 100.0}
    mark = {"level": 100.0, "atr": 1.0, "at": NOW - 60000, "fresh": True, "retest": False, "invalid": False}
    br = {"up": dict(mark), "down": dict(mark)}
    for k, v in (f or {}).items():
        (br["up" if d == 1 else "down"] if k in mark else side)[k] = v
    names = list(side)
    schema = "asset string, seconds long, " + ", ".join(f"{n} {'long' if n in ('count', 'closed_at') else 'int' if n == 'direction' else 'double'}" for n in names)
    mk = "struct<level: double, atr: double, at: long, fresh: boolean, retest: boolean, invalid: boolean>"
    data = []
    for seconds, extra in ((3600, fast or {}), (14400, {})):
        s = {**side, **extra}
        data.append(("BTC", seconds, *[s[n] for n in names], tuple(br["up"].values()), tuple(br["down"].values())))
    feats = spark.createDataFrame(data, f"{schema}, breakout_up {mk}, breakout_down {mk}")
    i = {"asset": "BTC", "now": NOW, "source_kind": "spot", "price": 100 + d * 0.4, "quote_at": NOW, "error": None, "clock_ok": True, **inp}
    inputs = spark.createDataFrame([tuple(i.values())], "asset string, now long, source_kind string, price double, quote_at long, error string, clock_ok boolean")
    return decision.verdicts(inputs, feats).first()


def test_buy_and_sell_are_mirror_images(spark):
    assert verdict(spark).action == "BUY" and verdict(spark, -1).action == "SELL"
    assert verdict(spark, f={"fresh": False}).action == "WAIT"
    pull = verdict(spark, f={"fresh": False, "retest": True})
    assert (pull.setup, pull.action) == ("PULLBACK", "BUY")


@pytest.mark.parametrize("kw", [{"price": 103.0}, {"price": 99.0}, {"f": {"adx": 5.0}}, {"f": {"er": 0.1}}, {"f": {"invalid": True}}, {"quote_at": NOW - 90_001}, {"price": None}, {"clock_ok": False},
                                {"error": "down"}, {"f": {"count": 12}}, {"f": {"atr": 0.0}}, {"fast": {"closed_at": NOW + 1}}, {"fast": {"direction": -1}}, {"source_kind": None}])
def test_everything_else_waits(spark, kw):
    assert verdict(spark, **kw).action == "WAIT"


def test_context_states_stay_distinct(spark):
    from datetime import datetime, timedelta

    now = datetime(2026, 9, 21, 12)
    mk = lambda v, o, f: (v, o, f, now, 2 * 86_400_000, 1)
    data = [mk(0.0, now - timedelta(days=1), now), mk(1.0, now - timedelta(days=3), now), mk(1.0, now + timedelta(days=1), now), mk(None, now, now)]
    got = [(r.status, r.bias) for r in decision.fact_status(spark.createDataFrame(data, "value double, observed timestamp, fetched timestamp, now timestamp, ttl_ms long, bias int")).collect()]
    assert got == [("ok", 1), ("stale", 0), ("future", 0), ("missing", 0)]


def test_book_without_a_crossing_has_no_flip(spark):
    chain = spark.createDataFrame([("x", 100.0, 95.0 + k, "C", 10.0, 0.5, 30.0) for k in range(10)], "snapshot string, spot double, strike double, kind string, oi double, iv double, days double")
    assert gamma.gamma_flip(chain).first().gamma_flip is None
    assert fv.FLIP_STEPS == 40


@pytest.mark.parametrize("n", [20, 52, 168, 270])
def test_short_series_are_folded_when_the_minimum_allows(spark, n):
    f = technical.features(spark.createDataFrame(rows(n), COLS), NOW, min_bars=20).first()
    assert f["count"] == n and f.direction in (0, 1) and (n < 21 or f.width_pct is not None)


def test_flip_is_that_of_forty_halvings_with_few_valuations(spark):
    import math
    import random

    rng = random.Random(5)
    books = {f"s{n}": (spot, [(spot * rng.uniform(0.8, 1.2), rng.choice("CP"), rng.uniform(1, 50), rng.uniform(0.3, 0.9), rng.uniform(0.5, 40)) for _ in range(rng.choice([2, 5, 30]))])
             for n, spot in enumerate([100.0, 64000.0, 3000.0, 1.0] * 5)}

    def value(spot, book, price):
        total = 0.0
        for strike, kind, oi, iv, days in book:
            t = days / gamma.YEAR_DAYS
            d1 = (math.log(price / strike) + iv * iv / 2 * t) / (iv * math.sqrt(t))
            g = math.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi) / (price * iv * math.sqrt(t))
            total += g * oi * price * price * 0.01 * (1 if kind == "C" else -1)
        return total

    want = {}
    for name, (spot, book) in books.items():
        lo, hi = spot * fv.FLIP_BAND[0], spot * fv.FLIP_BAND[1]
        low = value(spot, book, lo) < 0
        want[name] = None
        if low != (value(spot, book, hi) < 0):
            for _ in range(fv.FLIP_STEPS):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if (value(spot, book, mid) < 0) == low else (lo, mid)
            want[name] = (lo + hi) / 2
    rows = [(n, spot, *c) for n, (spot, book) in books.items() for c in book]
    chain = spark.createDataFrame(rows, "snapshot string, spot double, strike double, kind string, oi double, iv double, days double")
    got = {r.snapshot: r.gamma_flip for r in gamma.gamma_flip(chain).collect()}
    assert set(got) == set(want) and sum(v is not None for v in want.values()) > 5
    assert all((got[n] is None) == (w is None) and (w is None or abs(got[n] - w) < 0.0051) for n, w in want.items())
    # Two ends, two rounds of halvings, two rounds around the interpolated zero.
    assert 2 + sum(2 ** n - 1 for n in gamma.FLIP_LEVELS) + 2 * (2 * len(gamma.FLIP_OFFSETS) + 2) <= 150
