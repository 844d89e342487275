"""Company queries: news linking, dossiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import adapters as ad
from catalog.registry import ORACLE, query
from tidemark.functions.numeric import rnd
from tidemark.functions.text import normalise, slug, street_key
from tidemark.operators.phrases import phrase_hits
from tidemark.session import spread
from tidemark.plans import dossier, news

# Articles: first line is the headline, some also name a code. Each document's first line names a
# company and its second line is an alias of it, so copies and near copies link to them.
ARTICLES = """
SELECT concat('https://news.example/', cast(doc_id AS {str})) AS url,
       concat(split_part(text, chr(10), 1), CASE WHEN doc_id % 10 = 3 THEN concat(' cổ phiếu S', cast(doc_id % 97 AS {str})) ELSE '' END) AS title,
       text AS body, source, doc_id
FROM documents
"""
NAMES = """
SELECT concat('S', cast(doc_id AS {str})) AS symbol, split_part(text, chr(10), 1) AS organ_name, split_part(text, chr(10), 2) AS alias
FROM documents
"""
_NORM = "trim(regexp_replace(lower(strip_accents(replace(replace({}, 'đ', 'd'), 'Đ', 'D'))), '[^a-z0-9]+', ' ', 'g'))"


def articles(spark, sf):
    return ad._sql(spark, sf, ad._spark_text(ARTICLES), ["documents"])


def listed(spark, sf):
    d = ad._sql(spark, sf, ad._spark_text(NAMES), ["documents"])
    return d.select("symbol", "organ_name"), d.select("symbol", "alias")


_CODES = "list_transform(regexp_extract_all({}, '{}([\\p{{L}}\\p{{N}}_]+)', 1), lambda x: upper(x))"
_DICT = "articles AS (" + ad._duck_text(ARTICLES) + "), listed AS (" + ad._duck_text(NAMES) + "), " + f"""
names AS (SELECT symbol, {_NORM.format("organ_name")} AS phrase FROM listed),
dict AS (SELECT symbol, phrase, 1 AS pr FROM names WHERE length(phrase) >= 10 AND len(string_split(phrase, ' ')) >= 3
  UNION ALL SELECT symbol, {_NORM.format("alias")}, 2 FROM listed),
tx AS (SELECT *, trim(title || ' ' || regexp_split_to_array(body, '\\s+-\\s+\\d{{2}}-\\d{{2}}-\\d{{4}}')[1]) AS txt FROM articles WHERE trim(title) <> ''),
nx AS MATERIALIZED (SELECT url, title, txt, ' ' || {_NORM.format('txt')} || ' ' AS nt, ' ' || {_NORM.format('title')} || ' ' AS ntt FROM tx),
hit AS (SELECT url, symbol, pr, contains(ntt, ' ' || phrase || ' ') AS titled FROM nx JOIN dict ON length(phrase) >= 5 AND contains(nt, ' ' || phrase || ' ')
  UNION ALL
  SELECT url, symbol, 3, list_contains(codes, symbol) FROM (
    SELECT url, {_CODES.format('title', '')} AS codes, unnest(list_distinct({_CODES.format('txt', '(?i)(?:mã|cổ phiếu|cp)\\s*[:\\-]?\\s*')})) AS code FROM nx)
  JOIN names ON symbol = code WHERE length(symbol) >= 3),
best AS (SELECT url, symbol, min(pr) AS p, bool_or(titled) FILTER (pr = 1) AS t1, bool_or(titled) FILTER (pr = 2) AS t2, bool_or(titled) FILTER (pr = 3) AS t3 FROM hit GROUP BY 1, 2),
links AS (SELECT url, symbol, CASE p WHEN 1 THEN 'name' WHEN 2 THEN 'alias' ELSE 'symbol' END AS matched_by FROM best
  WHERE CASE p WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END)"""


def links(spark, sf):
    names, aliases = listed(spark, sf)
    return news.linked(articles(spark, sf), names, aliases)


@query("news_links", "WITH " + _DICT + " SELECT symbol, url, matched_by FROM links")
def q_links(spark, sf):
    return links(spark, sf).expanded().select("symbol", "url", "matched_by")


@query("news_without_roundups", "WITH " + _DICT + " SELECT symbol, url, matched_by FROM (SELECT *, count(*) OVER (PARTITION BY url) AS n FROM links) WHERE n <= 2")
def q_roundups(spark, sf):
    return news.drop_roundups(links(spark, sf)).select("symbol", "url", "matched_by")


@query("news_link_counts", "WITH " + _DICT + " SELECT matched_by, count(*) AS links, count(DISTINCT symbol) AS symbols FROM links GROUP BY 1")
def q_link_counts(spark, sf):
    return news.link_counts(links(spark, sf))


@query("phrase_containment_join", f"""WITH nx AS MATERIALIZED (SELECT doc_id, ' ' || {_NORM.format('text')} || ' ' AS nt FROM documents),
p AS (SELECT DISTINCT {_NORM.format('text')} AS phrase FROM benchmark)
SELECT doc_id, phrase FROM nx JOIN p ON length(phrase) >= 5 AND contains(nt, ' ' || phrase || ' ')""")
def q_phrases(spark, sf):
    docs = spread(ad.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", normalise("text").alias("t"))
    p = ad.table(spark, sf, "benchmark").select(normalise("text").alias("phrase"))
    return phrase_hits(docs, ["doc_id"], "t", p)


@query("news_per_symbol", """WITH l AS (SELECT event_type AS symbol, 'u' || user_id AS url, props AS title, 'feed' AS source, CASE WHEN event_id % 7 > 0 THEN ts END AS published_at,
  'name' AS matched_by, ts AS fetched_at, event_id FROM events),
r AS (SELECT * FROM l WHERE published_at IS NULL OR published_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY),
n AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, url ORDER BY fetched_at DESC, event_id DESC) AS rn FROM r) WHERE rn = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC NULLS LAST, fetched_at DESC, url) AS rank FROM n)
SELECT symbol, rank, url, title, source, published_at, matched_by FROM k WHERE rank <= 10""")
def q_per_symbol(spark, sf):
    e = ad.table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.concat(F.lit("u"), "user_id").alias("url"), F.col("props").alias("title"), F.lit("feed").alias("source"),
        F.when(F.col("event_id") % 7 > 0, F.col("ts")).alias("published_at"), F.lit("name").alias("matched_by"), F.col("ts").alias("fetched_at"), "event_id")
    return news.news_per_symbol(e, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 20, 10, ["fetched_at", "event_id"])


@query("review_sample", """SELECT doc_id, source FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 20""")
def q_sample(spark, sf):
    return news.review_sample(ad.table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"], 20)


@query("text_keys", f"""SELECT doc_id, trim(regexp_replace(lower(strip_accents(replace(replace(split_part(text, chr(10), 1), 'đ', 'd'), 'Đ', 'D'))), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
 md5({_NORM.format('text')}) AS norm_hash FROM documents""")
def q_text_keys(spark, sf):
    return ad.table(spark, sf, "documents").select("doc_id", slug(F.split_part("text", F.lit("\n"), F.lit(1))).alias("slug"), F.md5(normalise("text")).alias("norm_hash"))


# --- dossiers -----------------------------------------------------------------------------------------

OWNERS = """
SELECT cast(l_suppkey AS {str}) AS symbol, concat('Owner ', cast(l_partkey % 60 AS {str})) AS owner_name, l_returnflag AS position_name, 'person' AS owner_type,
       cast(l_quantity AS bigint) AS quantity, l_discount AS percentage, cast(l_shipdate AS date) AS update_date, {fetched} AS fetched_at,
       l_linenumber AS line_no, l_partkey AS part_no, l_quantity AS qty, l_extendedprice AS ext,
       concat('Group ', cast(l_partkey % 100 AS {str})) AS related_name, concat('C', cast(l_partkey % 100 AS {str})) AS related_code,
       CASE l_linestatus WHEN 'F' THEN 'subsidiary' ELSE 'affiliate' END AS relation_type, l_tax AS ownership_percent,
       cast(l_orderkey AS {str}) AS event_id, l_returnflag AS event_code, l_linestatus AS title, cast(l_shipdate AS date) AS public_date,
       cast(l_shipdate AS date) AS record_date, cast(l_shipdate AS date) AS exright_date,
       CASE l_linenumber WHEN 1 THEN 'isa1' WHEN 2 THEN 'isa9' WHEN 3 THEN 'bsa2' WHEN 4 THEN 'cfa18' ELSE 'other' END AS field,
       CASE l_linenumber % 3 WHEN 0 THEN 'balance' ELSE 'income' END AS statement, 'label' AS label_vi,
       CASE WHEN l_returnflag = 'A' THEN 'year' ELSE 'quarter' END AS period_type,
       CASE WHEN l_returnflag = 'A' THEN cast(year(l_shipdate) AS {str}) ELSE concat(year(l_shipdate), '-Q', quarter(l_shipdate)) END AS period,
       l_extendedprice * 1e7 AS value
FROM lineitem
"""
_O = ["fetched_at", "line_no", "part_no", "qty", "ext"]
_OSQL = "fetched_at DESC, line_no DESC, part_no DESC, qty DESC, ext DESC"


def facts(spark, sf):
    return ad._sql(spark, sf, ad._spark_text(OWNERS, **ad._QUOTE_MS), ["lineitem"])


_FACTS = "facts AS (" + ad._duck_text(OWNERS, **ad._QUOTE_MS) + ")"
_DM = {"dividend_yield": "dy", "pe": "pe", "roic": "roic"}


@query("dossier_ratio_points", "WITH " + ad.FUNDAMENTALS_SQL + """, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, period, metric
  ORDER BY fetched_at DESC, line_no DESC, part_no DESC, quantity DESC, extended DESC) AS rn FROM eq_fundamental WHERE value IS NOT NULL) WHERE rn = 1),
p AS (SELECT symbol, CASE metric WHEN 'dividend_yield' THEN 'dy' ELSE metric END AS key, 'q' AS cadence, period, round(CASE WHEN metric = 'pe' THEN value ELSE value * 100 END, 3) AS value FROM o),
t AS (SELECT *, row_number() OVER (PARTITION BY symbol, key ORDER BY period DESC) AS r FROM p),
z AS (SELECT *, max(abs(value)) OVER (PARTITION BY symbol, key) AS top FROM t WHERE r <= 36)
SELECT symbol, key, cadence, period, value FROM z WHERE top > 0""")
def q_points(spark, sf):
    return dossier.ratio_points(ad.fundamentals(spark, sf), _DM, ad.FUND_ORDER).drop("fetched_at")


@query("dossier_owners", "WITH " + _FACTS + f""", n AS (SELECT *, round(percentage * 100, 3) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY symbol, owner_name, position_name ORDER BY {_OSQL}) AS rn FROM facts) WHERE rn = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY coalesce(nullif(pct, 0), -1) DESC, owner_name, position_name) AS r, count(*) OVER (PARTITION BY symbol) AS c FROM n)
SELECT symbol, r AS position, owner_name, position_name, pct, c AS count FROM k WHERE r <= 40""")
def q_owners(spark, sf):
    o = dossier.owners(facts(spark, sf), order=_O)
    return o.select("symbol", "count", F.posexplode("rows").alias("_p", "x")).select(
        "symbol", (F.col("_p") + 1).alias("position"), "x.owner_name", "x.position_name", "x.pct", "count")


@query("dossier_relations", "WITH " + _FACTS + f""", n AS (SELECT *, round(ownership_percent * 100, 3) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY symbol, related_name, relation_type ORDER BY {_OSQL}) AS rn FROM facts) WHERE rn = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY coalesce(nullif(pct, 0), -1) DESC, related_name, relation_type) AS r, count(*) OVER (PARTITION BY symbol) AS c FROM n)
SELECT symbol, r AS position, related_code, relation_type, pct, c AS count FROM k WHERE r <= 80""")
def q_relations(spark, sf):
    o = dossier.relations(facts(spark, sf), order=_O)
    return o.select("symbol", "count", F.posexplode("rows").alias("_p", "x")).select(
        "symbol", (F.col("_p") + 1).alias("position"), "x.related_code", "x.relation_type", "x.pct", "count")


@query("dossier_events", "WITH " + _FACTS + f""", n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, event_id ORDER BY {_OSQL}) AS rn FROM facts) WHERE rn = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY public_date DESC NULLS LAST, event_id) AS r, count(*) OVER (PARTITION BY symbol) AS c FROM n)
SELECT symbol, r AS position, event_code, title, public_date, c AS count FROM k WHERE r <= 120""")
def q_events(spark, sf):
    o = dossier.events(facts(spark, sf), order=_O)
    return o.select("symbol", "count", F.posexplode("rows").alias("_p", "x")).select(
        "symbol", (F.col("_p") + 1).alias("position"), "x.event_code", "x.title", "x.public_date", "count")


@query("dossier_statements", "WITH " + _FACTS + f""", n AS (SELECT *, CASE period_type WHEN 'year' THEN 'y' ELSE 'q' END AS cadence FROM (SELECT *, row_number() OVER (PARTITION BY symbol, period, statement, field ORDER BY {_OSQL}) AS rn
  FROM facts WHERE field <> 'other') WHERE rn = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, field, cadence ORDER BY period DESC, statement DESC) AS r FROM n WHERE NOT (cadence = 'q' AND field = 'isa9'))
SELECT symbol, field, statement, label_vi AS label, cadence, period, round(value / 1e9, 3) AS value, public_date FROM k WHERE r <= CASE cadence WHEN 'y' THEN 9 ELSE 36 END""")
def q_statements(spark, sf):
    return dossier.statement_points(facts(spark, sf), _O)


def build_dossiers(spark, sf):
    f = facts(spark, sf)
    c = ad.companies(spark, sf).select(
        "symbol", F.col("organ_name").alias("short_name"), F.col("industry").alias("profile"), "sector", F.lit("CT").alias("company_type"),
        F.lit(None).cast("date").alias("listing_date"), F.lit(0.1).alias("state_percent"), F.lit(0.2).alias("foreign_percent"), F.lit("B").alias("rating"),
        "balance", F.lit(1.0).alias("target_price"), F.lit(None).cast("date").alias("rating_as_of"), F.lit("feed").alias("source"), F.lit(0).alias("fetched_at"),
        F.when(F.col("balance") > 0, F.to_json(F.struct((F.col("balance") / 10000).alias("freeFloatPercentage"), (F.col("balance") / 5000).alias("maximumForeignPercentage"),
                                                        (F.col("balance") * 1e6).alias("averageMatchValue1Month"), F.lit(" 30 ").alias("icbCodeLv2")))).otherwise("{broken").alias("meta"))
    listed_now = ad.companies(spark, sf).withColumn("fetched_at", F.lit(0))
    return dossier.dossiers(listed_now, ad.fundamentals(spark, sf), c, f, f, f, f, ad.FUND_ORDER, _O), c


@query("company_json_facts", "WITH " + ad.COMPANIES_SQL + """ SELECT symbol, sector, CASE WHEN balance > 0 AND balance / 10000 BETWEEN 0 AND 1 THEN round(balance / 10000, 4) END AS ff,
  CASE WHEN balance > 0 AND balance / 5000 BETWEEN 0 AND 1 THEN round(balance / 5000, 4) END AS fmax, CASE WHEN balance > 0 THEN round(balance * 1e6 / 1e9, 3) END AS liq,
  CASE WHEN balance > 0 THEN '30' END AS icb2 FROM eq_listing""")
def q_json(spark, sf):
    _, c = build_dossiers(spark, sf)
    return dossier.company_facts(c).select("symbol", "sector", "ff", "fmax", "liq", "icb2")


@query("company_dossiers", "WITH " + ad.COMPANIES_SQL + ", " + _FACTS + """, e AS (SELECT symbol, least(count(DISTINCT event_id), 120) AS events, least(count(DISTINCT (owner_name, position_name)), 40) AS owners,
  count(DISTINCT (related_name, relation_type)) AS rel_count FROM facts GROUP BY 1)
SELECT symbol AS s, organ_name AS n, events, owners, rel_count FROM eq_listing JOIN e USING (symbol)""")
def q_dossiers(spark, sf):
    d, _ = build_dossiers(spark, sf)
    return d.select("s", "n", F.size("events").alias("events"), F.size("owners").alias("owners"), "rel_count")


@query("company_dossier_ratios", ORACLE["dossier_ratio_points"])
def q_dossier_ratios(spark, sf):
    """Every point of every ratio of the nested rows."""
    d, _ = build_dossiers(spark, sf)
    return d.select(F.col("s").alias("symbol"), F.explode("m").alias("key", "g")).select("symbol", "key", F.lit("q").alias("cadence"), F.inline("g.q"))


@query("company_dossier_statements", f"SELECT symbol, field, cadence, period, value FROM ({ORACLE['dossier_statements']})")
def q_dossier_statements(spark, sf):
    """Every point of every statement line of the nested rows."""
    d, _ = build_dossiers(spark, sf)
    lines = d.select(F.col("s").alias("symbol"), F.explode("st").alias("field", "g"))
    one = lambda c: lines.select("symbol", "field", F.lit(c).alias("cadence"), F.inline(f"g.{c}"))
    return one("q").unionByName(one("y"))


@query("company_dossier_facts", ORACLE["company_json_facts"])
def q_dossier_facts(spark, sf):
    d, _ = build_dossiers(spark, sf)
    return d.select(F.col("s").alias("symbol"), *[f"co.{c}" for c in ("sector", "ff", "fmax", "liq", "icb2")])


@query("dossier_manifest", "SELECT count(*) AS count, count(*) AS dossiers, count(*) AS statements FROM supplier")
def q_manifest(spark, sf):
    d, _ = build_dossiers(spark, sf)
    return dossier.manifest(d)
