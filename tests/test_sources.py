from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import parsing, text
from tidemark.functions.numeric import clean_nulls
from tidemark.plans import news
from tidemark.sources import html_tables, prices, publish, records


def flow(spark, cells):
    html = "<tr><td></td><td>ETHA</td><td>FETH</td><td>ETHW</td><td>Total</td></tr><tr><td>18 Sep 2026</td>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    df = spark.createDataFrame([("eth", 1, html)], "asset string, fetched_at int, html string")
    return {r.series: r.value for r in html_tables.fund_flow_series(df).collect()}


def test_published_total_wins_and_zero_is_data(spark):
    assert flow(spark, ["10", "(5)", "-", "5.1"])["etf.eth.net_flow"] == 5.1
    assert flow(spark, ["-", "-", "-", "0.0"])["etf.eth.net_flow"] == 0.0
    assert "etf.eth.net_flow" not in flow(spark, ["10", "-", "-", "-"])
    assert flow(spark, ["10", "(5)", "-", "5.1"])["etf.eth.flow.feth"] == -5.0


def test_board_units(spark):
    cols = ["sym", "lastPrice", "r", "openPrice", "highPrice", "lowPrice", "lot", "fBValue", "fSValue", "fBVol", "fSVolume"]
    df = spark.createDataFrame([("GVR", "32.9", *[None] * 4, "344180", *[None] * 4)], ", ".join(f"{c} string" for c in cols)).withColumn("as_of", F.lit("2026-09-24").cast("date")).withColumn(
        "fetched_at", F.lit(datetime(2026, 9, 24)))
    q = prices.board_quotes(df).first()
    assert (q.price, q.volume) == (32900.0, 3441800)


def test_history_arrays(spark):
    doc = '{"s":"ok","t":["1790208000","1790121600","1790208000"],"o":[32,31,32],"h":[34,33,34],"l":[31,30,31],"c":[33,32,33.5],"v":[100,200,300]}'
    b = prices.valid_bars(prices.history_bars(spark.createDataFrame([("A", doc)], "symbol string, json string"))).orderBy("t").collect()
    assert [(r.t, r.close, r.volume) for r in b] == [(1790121600, 32000.0, 200.0), (1790208000, 33500.0, 300.0)]
    bad = '{"s":"ok","t":[1790035200,1790121600,1790208000,1790294400],"o":[32,32,32,32],"h":[34,34,31,34],"l":[31,31,30,31],"c":[33,32,33,null],"v":[100,200,100,100]}'
    ok = prices.valid_bars(prices.history_bars(spark.createDataFrame([("A", bad)], "symbol string, json string")))
    assert ok.count() == 2 and prices.bar_coverage(ok.limit(1)).first().ok is False
    stamp = prices.history_quotes(ok).agg(F.max(F.hour("fetched_at"))).first()[0]
    assert stamp == 8


def test_text_and_dates(spark):
    df = spark.createDataFrame([("Đường Lê Lợi, Phường 1.", "Công ty Cổ phần Tập đoàn Hòa Phát", "Fri, 18 Sep 2026 08:30:00 +0700", "1-Sep-26")], "a string, b string, c string, d string")
    r = df.select(text.street_key("a").alias("a"), text.slug("a").alias("s"), text.company_phrase("b").alias("b"), parsing.rfc822("c").alias("c"), parsing.flexible_date("d").alias("d")).first()
    assert r.a == "le loi phuong 1" and r.s == "duong-le-loi-phuong-1" and r.b == "tap doan hoa phat"
    assert r.c == datetime(2026, 9, 18, 1, 30) and str(r.d) == "2026-09-01"


def test_headline_decides_and_roundups_go(spark):
    listed = spark.createDataFrame([("HPG", "Công ty Cổ phần Tập đoàn Hòa Phát"), ("VNM", "Công ty Cổ phần Sữa Việt Nam xanh"), ("FPT", "x")], "symbol string, organ_name string")
    alias = spark.createDataFrame([("VNM", "Vinamilk"), ("HPG", "Hòa Phát"), ("FPT", "Tập đoàn FPT")], "symbol string, alias string")
    a = spark.createDataFrame([
        ("u1", "Vinamilk tăng lãi", "..."), ("u2", "Thị trường hôm nay", "Vinamilk được nhắc trong bài"), ("u3", "Vinamilk, Hòa Phát, Tập đoàn FPT cùng tăng", ""),
        ("u4", "Nên mua cổ phiếu FPT", ""), ("u5", "FPT và USD", ""), ("u6", "Tin khác", "nội dung - 01-09-2026 Vinamilk")], "url string, title string, body string")
    links = news.link_articles(a, listed, alias)
    got = {(r.url, r.symbol, r.matched_by) for r in news.drop_roundups(links).collect()}
    assert got == {("u1", "VNM", "alias"), ("u4", "FPT", "symbol")}


def test_unchanged_shards_are_not_rewritten(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1, "t1"), ("b", 2, "t1")], "k string, v int, updated_at string")
    states = lambda d: {r.k: r.state for r in publish.write_changed_shards(spark, d, path, "k").collect()}
    assert states(df) == {"a": "added", "b": "added"}
    again = df.withColumn("updated_at", F.lit("t2")).withColumn("v", F.when(F.col("k") == "b", 3).otherwise(F.col("v")))
    assert states(again) == {"a": "same", "b": "changed"}
    kept = {r.k: (r.v, r.updated_at) for r in spark.read.json(f"{path}/shards").collect()}
    assert kept == {"a": (1, "t1"), "b": (3, "t2")}


def test_nan_becomes_null_in_nested_columns(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("nan")])], "a double, b array<double>")
    assert tuple(clean_nulls(df).first()) == (None, [1.0, None])


def test_long_description_ends_at_a_sentence(spark):
    s = "One sentence here. " * 100
    r = spark.createDataFrame([(s,)], "t string").select(text.trim_sentences("t", 1200).alias("t")).first().t
    assert r.endswith(". …") and len(r) <= 1203


def test_superseded_coin_is_dropped(spark):
    docs = spark.createDataFrame([("GAL", '{"name":"GAL (migrated to Gravity - G)","id":"x"}'), ("BTC", '{"name":"Bitcoin","id":"bitcoin"}')], "symbol string, json string")
    assert [r.symbol for r in records.coin_profiles(docs).collect()] == ["BTC"]


def test_links_kept_by_phrase_are_those_of_plain_search(spark):
    """Shared names and aliases, companies of several names, codes, repeated urls; with tiles of two rows."""
    import random

    rng = random.Random(5)
    lines = [f"alpha{k} beta{k % 3} gamma{k % 2} delta" for k in range(6)] + ["omega sigma tau"]
    short = ["kappa", "lambda mu", "alpha1 beta1 gamma1 delta", "rho12"]
    listed = [(f"S{k % 40}", rng.choice([*lines, None])) for k in range(50)] + [("S1", lines[0]), ("S1", lines[1])]
    alias = [(rng.choice([f"S{k % 40}", f"S{k % 40}", None]), rng.choice([*short, "", lines[2]])) for k in range(50)]
    stories = []
    for k in range(60):
        parts = [rng.choice([*lines, *short, "noise", f"cổ phiếu S{rng.randrange(45)}"]) for _ in range(4)]
        stories.append((f"u{k % 50}", ". ".join(parts[:2]), " ".join(parts[2:]), k))
    phrases = {(s, n, 1) for s, n in listed if n} | {(s, a, 2) for s, a in alias if len(a) >= 5}
    best = {}
    for url, title, body, _ in stories:
        clean = lambda x: f" {' '.join(x.lower().replace('.', ' ').replace('ổ', 'o').replace('ế', 'e').split())} "
        for s, p, i in phrases:
            if f" {p} " in clean(title + " " + body):
                best.setdefault((url, s), []).append((i, f" {p} " in clean(title)))
        for word in (title + " " + body).replace(".", " ").split("cổ phiếu ")[1:]:
            code = word.split()[0]
            if any(code == s for s, _ in listed):
                best.setdefault((url, code), []).append((3, code in title.replace(".", " ").split()))
    want = {(u, s, news.METHODS[min(i for i, _ in hits) - 1]) for (u, s), hits in best.items() if any(t for i, t in hits if i == min(j for j, _ in hits))}
    a = spark.createDataFrame(stories, "url string, title string, body string, k int")
    before = news.TILE
    news.TILE = 2
    try:
        found = news.linked(a, spark.createDataFrame(listed, "symbol string, organ_name string"), spark.createDataFrame(alias, "symbol string, alias string"))
        rows = [(r.url, r.symbol, r.matched_by) for r in found.expanded().collect()]
        kept = {(r.url, r.symbol, r.matched_by) for r in news.drop_roundups(found, 6).collect()}
    finally:
        news.TILE = before
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {m for _, _, m in want} == set(news.METHODS)
    size = {u: sum(x[0] == u for x in want) for u, _, _ in want}
    assert kept == {x for x in want if size[x[0]] <= 6} and kept and kept != want
    counted = {r.matched_by: (r.links, r.symbols) for r in news.link_counts(found).collect()}
    assert counted == {m: (sum(x[2] == m for x in want), len({x[1] for x in want if x[2] == m and x[1] is not None})) for m in news.METHODS}
    # Shared phrases are not written out before they are counted.
    assert found.stories.count() + found.single.count() < len(rows) * 0.6


def test_board_texts_are_read_as_packed_levels(spark):
    texts = [None, "", "|", "0|5|i", "249.6|5360|i", "12", "a|b", "5|", "-1|3", "NaN|2", " 7 | 8 |d", "3|x|d", "1|2|3|4"]
    rows = [(" A ", texts[k % 13], texts[(k + 1) % 13], texts[(k * 5) % 13], texts[(k * 3 + 2) % 13]) for k in range(13)]
    b = spark.createDataFrame(rows, "sym string, g1 string, g4 string, fRoom string, ptVol string").withColumns(
        {**{f"g{i}": F.lit(None).cast("string") for i in (2, 3, 5, 6)}, "as_of": F.lit("2026-09-24").cast("date"), "fetched_at": F.lit(datetime(2026, 9, 24))})
    got = sorted((r.series, r.value) for r in prices.board_metrics(b).collect())
    bid, ask, room, pt = parsing.packed_level("g1"), parsing.packed_level("g4"), parsing.number("fRoom") * 10.0, parsing.number("ptVol")
    plain = b.select(bid["price"], bid["volume"], ask["price"], ask["volume"], room, F.when(pt != 0, pt)).collect()
    names = ["bid1", "bid1_vol", "ask1", "ask1_vol", "foreign_room", "put_through_vol"]
    assert got == sorted((f"vn.board.A.{n}", v) for r in plain for n, v in zip(names, r, strict=True) if v is not None) and got


def test_a_sharded_build_computes_its_rows_once(spark, tmp_path):
    """Shards are counted before their rows are dealt out to files; both read what was written."""
    from tidemark.sources.artifacts import Artifact

    made = spark.sparkContext.accumulator(0)

    def mark(k):
        made.add(1)
        return k

    rows = spark.range(200).select("id", F.udf(mark, "long")("id").alias("v"), (F.col("id") % 3).alias("k"))
    store = Artifact(str(tmp_path / "a"))
    store.write(rows, "test", "today", ["k"], 50)
    assert made.value == 200 and store.read(spark, rows.schema).count() == 200


def test_texts_are_searched_without_being_written(spark, monkeypatch):
    """A name in the whole text still tells that its company's alias in the headline does not count."""
    from tidemark.operators import phrases

    words = [f"word{k}" for k in range(3000)]
    stories = [(f"u{k}", f"Vinamilk kênh {k}", " ".join(words if k % 2 else words[:2000])) for k in range(20)]
    a = spark.createDataFrame(stories, "url string, title string, body string")
    listed = spark.createDataFrame([("VNM", "word2500 word2501 word2502")], "symbol string, organ_name string")
    alias = spark.createDataFrame([("VNM", "Vinamilk")], "symbol string, alias string")
    kept, sizes = news.written, []

    def noted(df):
        out = kept(df)
        sizes.append(sum(len(str(r)) for r in out.collect()))
        return out

    monkeypatch.setattr(news, "written", noted)
    monkeypatch.setattr(phrases, "written", noted)
    found = news.link_articles(a, listed, alias).select("url", "symbol", "matched_by").collect()
    assert sorted(map(tuple, found)) == sorted((f"u{k}", "VNM", "alias") for k in range(0, 20, 2))
    assert 0 < sum(sizes) < sum(len(body) for _, _, body in stories) / 2


def test_the_newest_board_reads_every_series_once(spark, monkeypatch):
    """Names of series are put together once a row; symbols with dots and names without a field keep their places."""
    from catalog import equity, ingest
    from tidemark.plans import screener

    rows = [(f" {s}", datetime(2026, 9, d), f"{d}|5|d", str(100 * d)) for s in ("A", "B.C", "B.D") for d in (1, 2, 3)]
    b = spark.createDataFrame(rows, "sym string, fetched_at timestamp, g1 string, fRoom string").withColumns(
        {**{f"g{i}": F.lit(None).cast("string") for i in range(2, 7)}, "ptVol": F.lit("12"), "as_of": F.to_date("fetched_at")})
    monkeypatch.setattr(ingest, "board", lambda spark, sf: b)
    plans, kept = [], screener.written
    monkeypatch.setattr(screener, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    newest = screener.newest_board(equity.board_metrics(spark, ""))
    assert [p.count("concat_ws") for p in plans] == [1]
    assert sorted(map(tuple, screener.foreign_room(newest).select("symbol", "room").collect())) == [("A", 2200.0), ("B", 2200.0), ("B", 2200.0)]
    assert sorted((r.symbol, r.b1, r.b1v) for r in screener.board_depth(newest).collect()) == [("A", 3000.0, 5.0)]
    named = spark.createDataFrame([("vn.board.bid1", 1.0, 1), ("vn.board.X.bid1", 2.0, 1), ("vn.board.X.Y.bid1", 3.0, 1), ("vn.board.X.bid1.Z", 4.0, 2)], "series string, value double, d int").select(
        "series", "value", F.date_add(F.lit("2026-09-01").cast("date"), "d").alias("as_of"), F.lit(datetime(2026, 9, 1)).alias("fetched_at"))
    found = screener.newest_board(named)
    plain = named.where(F.split_part("series", F.lit("."), F.lit(4)) == "bid1")
    assert screener.board_depth(found).collect() == screener.board_depth(plain).collect() != []


def test_many_shards_are_written_and_read_in_groups(spark, tmp_path, monkeypatch):
    """No reader lists more folders than a group has; each shard keeps its own."""
    from tidemark.sources import artifacts

    monkeypatch.setattr(artifacts, "MOST_FOLDERS", 30, raising=False)
    rows = spark.range(300).select(F.when(F.col("id") > 0, F.concat(F.lit("t"), F.col("id") % 100)).alias("s"), F.struct("id", F.array("id").alias("q")).alias("m"))
    store = artifacts.Artifact(str(tmp_path / "a"))
    store.write(rows.limit(0), "test", "yesterday", ["s"], 2)
    store.write(rows, "test", "today", ["s"], 2)
    now = store.read(spark, rows.schema)
    assert sorted(now.select("s", "m").collect(), key=lambda r: r.m.id) == rows.collect() and store.previous(spark, rows.schema).count() == 0
    assert store.provenance(spark).first().n == 300
    found = {r.s: (r.n, r.files) for r in store.shards(spark, rows.schema, ["s"]).collect()}
    assert len(found) == 101 and sum(n for n, _ in found.values()) == 300 and max(f for _, f in found.values()) <= 2
    folders = [len(list(p.glob("s=*"))) for p in tmp_path.glob("a/builds/*/rows/group=*")]
    assert sum(folders) == 101 and len(folders) == 4 and max(folders) < 60
    assert "FileScan" not in now._jdf.queryExecution().executedPlan().toString()
