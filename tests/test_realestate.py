from datetime import datetime, timedelta

from tidemark.plans import listing_panel as lp, realestate as re

D = datetime(2026, 9, 1, 8)
COLS = ("list_id long, source string, as_of timestamp, fetched_at timestamp, region string, district string, category string, "
        "price double, size_m2 double, price_per_m2 double, latitude double, longitude double")


def ad(i, day, price, size=100.0, district="D1", category="Đất", source="chotot:s"):
    t = D + timedelta(days=day)
    return (i, source, t, t, "R", district, category, price, size, price / 1e6 / size, 10.0, 106.0)


def test_staleness_counts_from_the_cells_own_crawl(spark):
    rows = [ad(1, 0, 5e9), ad(2, 4, 5e9), ad(3, 0, 6e9, category="Nhà ở"), ad(4, 1, 6e9, category="Nhà ở")]
    fresh = re.fresh_listings(spark.createDataFrame(rows, COLS))
    assert {r.list_id for r in fresh.collect()} == {2, 3, 4}


def test_sale_and_rent_never_mix_and_clip_bounds_hold(spark):
    rows = [ad(i, 0, (1 + i / 10) * 1e9) for i in range(30)] + [ad(100 + i, 0, 5e7, source="chotot:u") for i in range(30)]
    cell = re.cell_statistics(spark.createDataFrame(rows, COLS), 20).first()
    assert cell.n == 26 and 10 <= cell.p25_ppm2 <= cell.median_ppm2 <= cell.p75_ppm2 <= 40


def test_edited_area_is_not_a_price_cut(spark):
    rows = [ad(1, 0, 6.5e9, 144.0), ad(1, 1, 0.65e9, 44.0), ad(2, 0, 5e9), ad(2, 1, 4e9), ad(3, 0, 5e9), ad(3, 1, 5e9)]
    panel = lp.listing_panel(lp.sale_observations(spark.createDataFrame(rows, COLS)))
    m = lp.panel_metrics(panel, lp.reposted(spark.createDataFrame(rows, COLS)), min_samples=1).first()
    assert (m.pcn, m.pc, m.pcm) == (2, 50.0, -20.0)


def test_reappearing_ad_is_a_repost(spark):
    rows = [ad(1, 0, 5e9), ad(9, 3, 5.05e9, 101.0), ad(5, 0, 9e9), ad(7, 3, 5e9, district="D2"), ad(8, 30, 9e9)]
    rows += [ad(20, d, 1e9) for d in range(8)]
    df = spark.createDataFrame(rows, COLS)
    back = {r.list_id for r in lp.reposted(df).collect()}
    assert back == {1}
    m = {r.district: r for r in lp.panel_metrics(lp.listing_panel(df), lp.reposted(df), min_samples=1).collect()}["D1"]
    assert m.gr > m.grx


def test_repost_join_equals_brute_force(spark):
    import random

    rng = random.Random(7)
    rows = [ad(i, rng.randint(0, 40), rng.choice([5e9, 5.05e9, 5.2e9, 9e9]), rng.choice([100.0, 101.0, 103.0])) for i in range(150)]
    got = {r.list_id for r in lp.reposted(spark.createDataFrame(rows, COLS)).collect()}
    want = {a[0] for a in rows for b in rows if b[0] != a[0] and b[3] > a[3] and (b[3].date() - a[3].date()).days <= 7
            and abs(b[8] - a[8]) <= 0.02 * a[8] and abs(b[7] - a[7]) <= 0.02 * a[7]}
    assert got == want


def test_current_province(spark):
    df = spark.createDataFrame([("Tp Hồ Chí Minh",), ("Tỉnh Bắc Giang",), ("Bà Rịa - Vũng Tàu",), ("Nowhere",)], "region string")
    assert {r.region: r.rs for r in re.with_current_province(df).collect()} == {
        "Tp Hồ Chí Minh": "Hồ Chí Minh", "Tỉnh Bắc Giang": "Bắc Ninh", "Bà Rịa - Vũng Tàu": "Hồ Chí Minh", "Nowhere": "Nowhere"}
