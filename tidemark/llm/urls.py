"""URL filters: rules by longest match, then gradient-boosted trees on lexical features of the URL.

Everything is DataFrame expressions and the trees of Spark ML. Features are lengths, depth, digit
ratio, entropy of the characters, parameter counts, and the labelled URLs' statistics of the host's
suffix (its last label) and of the first path segment. The trees learn from labelled URLs (the query labels them by its rules) and decide
the URLs that no rule fits.

At most TRAIN_URLS labelled URLs train, those first in hash order.

Defined results: a null URL, or one without "://", has an empty host and path and fits no rule;
with no labelled URL every other one is allowed, with labels of one kind all get that kind; repeated
rows are judged alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_URLS = 20_000
TREES, DEPTH, RATE = 15, 4, 0.2
ALLOW, BLOCK = "allow", "block"

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its own.
RULES = (
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
)
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "labels",
            "longest_label", "hyphens", "has_fragment", "suffix_rate", "suffix_urls", "segment_rate", "segment_urls")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffix statistics are drawn to the overall rate by so many URLs.
PRIOR = 20.0


def with_parts(rows: DataFrame) -> DataFrame:
    """Adds `host` and `path` of `url`."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return rows.withColumn("_rest", rest).withColumn(
        "host", F.coalesce(F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))).withColumn(
        "path", F.coalesce(F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1), F.lit(""))).drop("_rest")


def _fits(host: str, path: str) -> Column:
    of_host = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
    return of_host & F.startswith(F.col("path"), F.lit(path))


def with_rule(rows: DataFrame, rules=RULES) -> DataFrame:
    """Adds `rule` and `ruled`, the name and verdict of the longest rule that fits, else null."""
    fitting = [F.when(_fits(h, p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    best = F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    return rows.withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("ruled", F.col("_best.verdict")).drop("_best")


def _without(text: Column, chars: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def _entropy(text: Column) -> Column:
    """Bits a character: the characters' counts come from what their removal shortens the text by."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda s, k: s + F.when(k > 0, k * F.log2(k)).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def with_lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that the URL alone gives, and `suffix`, the last label of the host."""
    url, host = F.coalesce("url", F.lit("")), F.col("host")
    labels = F.split(host, r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda text, c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    return rows.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length(host).cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        count(F.col("path"), "/").alias("depth"),
        F.coalesce((F.length(url) - F.length(_without(url, "0123456789"))) / F.nullif(F.length(url), F.lit(0)), F.lit(0.0)).alias("digit_ratio"),
        _entropy(url).alias("entropy"),
        F.when(query == "", 0.0).otherwise(count(query, "&") + 1).alias("parameters"),
        F.size(labels).cast("double").alias("labels"),
        F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double").alias("longest_label"),
        count(host, "-").alias("hyphens"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.element_at(labels, -1).alias("suffix"),
        F.regexp_extract("path", r"^/([^/]*)", 1).alias("segment"),
    )


def label_statistics(labelled: DataFrame, part: str, rate: float) -> DataFrame:
    """(part, label) -> (part, part_rate, part_urls): blocked share and (log) number of labelled URLs with that part."""
    return labelled.groupBy(part).agg(
        ((F.sum("label") + rate * PRIOR) / (F.count("*") + PRIOR)).alias(f"{part}_rate"), F.log1p(F.count("*").cast("double")).alias(f"{part}_urls"))


def _with_statistics(rows: DataFrame, statistics: dict[str, DataFrame], rate: float) -> DataFrame:
    for part, known in statistics.items():
        rows = rows.join(known, part, "left").fillna({f"{part}_rate": rate, f"{part}_urls": 0.0})
    return rows


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url), (url, label: 1 = block) -> (page_id, host, path, rule, verdict), a row for each page."""
    ruled = with_rule(with_parts(pages.select("page_id", "url")), rules)
    seen = labelled.where("label IS NOT NULL").select("url", F.col("label").cast("double").alias("label"))
    size, blocked = seen.agg(F.count("*"), F.sum("label")).first()
    if not size or blocked in (0, size):
        learnt = F.lit(BLOCK if size and blocked else ALLOW)
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("ruled", learnt).alias("verdict"))
    rate = blocked / size
    lexical = with_lexical(with_parts(seen))
    statistics = {part: label_statistics(lexical, part, rate) for part in ("suffix", "segment")}
    sample = lexical.orderBy(F.xxhash64("url"), "url").limit(TRAIN_URLS)
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = assemble.transform(_with_statistics(sample, statistics, rate)).select("features", "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=7).fit(train)
    scored = model.transform(assemble.transform(_with_statistics(with_lexical(ruled), statistics, rate)))
    learnt = F.when(F.col("prediction") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learnt).alias("verdict"))


def labelled_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """(url, label) of the pages whose URL a rule decides."""
    ruled = with_rule(with_parts(pages.select("url")), rules).where("ruled IS NOT NULL")
    return ruled.select("url", F.when(F.col("ruled") == BLOCK, 1).otherwise(0).alias("label"))
