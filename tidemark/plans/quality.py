"""Data-quality gate: rules as columns, one aggregate pass per artifact."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.numeric import ratio


@dataclass(frozen=True)
class Rule:
    """A condition on rows; it fails once more than `allowed` of the rows it applies to are bad."""

    name: str
    bad: Column
    severity: str = "error"
    applies: Column | None = None
    allowed: float = 0.0
    sample: str | None = None


@dataclass(frozen=True)
class Total:
    """A condition on the whole artifact, written over aggregates."""

    name: str
    bad: Column
    severity: str = "error"
    checked: Column | None = None


def evaluate(df: DataFrame, artifact: str, rules: Sequence[Rule | Total]) -> DataFrame:
    """(artifact, rule, severity, n_checked, n_bad, failed, sample): everything in one aggregate, then one row per rule."""
    aggs, out = [], []
    for i, r in enumerate(rules):
        if isinstance(r, Rule):
            applies = F.coalesce(r.applies, F.lit(False)) if r.applies is not None else F.lit(True)
            bad = applies & F.coalesce(r.bad, F.lit(False))
            aggs += [F.count_if(applies).alias(f"c{i}"), F.count_if(bad).alias(f"b{i}"),
                     (F.min(F.when(bad, F.col(r.sample).cast("string"))) if r.sample else F.lit(None).cast("string")).alias(f"s{i}")]
            failed = F.col(f"b{i}") > F.col(f"c{i}") * F.lit(float(r.allowed))
        else:
            aggs += [(F.count(F.lit(1)) if r.checked is None else r.checked).cast("long").alias(f"c{i}"),
                     F.coalesce(r.bad, F.lit(True)).cast("long").alias(f"b{i}"), F.lit(None).cast("string").alias(f"s{i}")]
            failed = F.col(f"b{i}") > 0
        out.append(F.struct(F.lit(artifact).alias("artifact"), F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"c{i}").alias("n_checked"),
                            F.col(f"b{i}").alias("n_bad"), failed.alias("failed"), F.col(f"s{i}").alias("sample")))
    return df.agg(*aggs).select(F.inline(F.array(*out)))


def verdict(report: DataFrame) -> DataFrame:
    """Per artifact: errors, warnings, and whether it may be published."""
    g = report.groupBy("artifact").agg(F.count_if(F.col("failed") & (F.col("severity") == "error")).alias("errors"),
                                       F.count_if(F.col("failed") & (F.col("severity") == "warn")).alias("warnings"))
    return g.withColumn("ok", F.col("errors") == 0)


class GateFailed(RuntimeError):
    pass


def require(report: DataFrame) -> None:
    failed = [r.artifact for r in verdict(report).where("NOT ok").collect()]     # one row per artifact
    if failed:
        raise GateFailed("not publishable: " + ", ".join(sorted(failed)))


def row_drop(current: DataFrame, previous: DataFrame, artifact: str, severity: str = "error", limit: float = fv.MAX_ROW_DROP) -> DataFrame:
    """Fell the row count too far against the previous build? Two counts meet as one row."""
    n = current.agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(previous.agg(F.count(F.lit(1)).alias("_p"))))
    return evaluate(n, artifact, [Rule("row drop", 1 - ratio("_n", "_p") > limit, severity, F.col("_p") > 0)])


def coverage_rules(severity: str = "error", limit: float = fv.MAX_ROW_DROP) -> list[Rule | Total]:
    """Two builds side by side (`compared`): did more than `limit` of the keys go?"""
    here, before = F.count_if("here"), F.count_if("before")
    return [Total("coverage against the previous build", F.coalesce(1 - ratio(here, before) > limit, F.lit(False)), severity, before)]


def fx_coverage_rules() -> list[Rule | Total]:
    """Of so few series none may go unnoticed."""
    here, before = F.count_if("here"), F.count_if("before")
    return [Total("coverage against the previous build", here < before, "warn", before)]


def breadth_history_rules(slack: int = 5) -> list[Rule | Total]:
    here, before = F.count_if("here"), F.count_if("before")
    return [Total("history shrank", (before > 0) & (here < before - slack), "error", before)]


def fell_rules(measure: str, name: str, sample: str, severity: str = "warn") -> list[Rule | Total]:
    """A count per key that only grows: days of a flow series, closed trades of a rule. A key that is gone counts as none."""
    before = F.coalesce(F.col(f"{measure}_before"), F.lit(0))
    return [Rule(name, F.coalesce(F.col(measure), F.lit(0)) < before, severity, F.col("here") & (before > 0), sample=sample)]


def _between(c: str, lo: float, hi: float) -> Column:
    return ~F.col(c).between(lo, hi)


def _total_rows(name: str, at_least: int, severity: str = "error") -> Total:
    return Total(name, F.count(F.lit(1)) < at_least, severity)


def _unique(c: str) -> Total:
    """Duplicates or missing keys."""
    return Total(f"{c} unique", (F.count_distinct(c) < F.count(F.lit(1))) | (F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "") > 0))


def screener_rules(columns: Sequence[str]) -> list[Rule | Total]:
    rules: list[Rule | Total] = [
        _total_rows("not empty", 1), Rule("has symbol", F.coalesce(F.col("s"), F.lit("")) == ""),
        Rule("price in range", _between("p", *fv.EQUITY_PRICE_RANGE), applies=F.col("p").isNotNull(), allowed=0.01, sample="s"),
        Total("any price", F.count("p") == 0), Total("enough prices", F.count("p") < 300, "warn")]
    for k in fv.PERCENT_KEYS:
        if k in columns:
            has = F.col(k).isNotNull()
            rules += [Rule(f"{k} in percent", _between(k, *fv.PERCENT_RANGE), "error", has, 0.10, "s"), Rule(f"{k} mostly in percent", _between(k, *fv.PERCENT_RANGE), "warn", has, 0.01, "s")]
    return rules


def cell_rules(columns: Sequence[str], min_samples: int = fv.MIN_SAMPLES, band=fv.PRICE_BAND) -> list[Rule | Total]:
    rules: list[Rule | Total] = [
        _total_rows("not empty", 1), Rule("sample size", F.coalesce("n", F.lit(0)) < min_samples, sample="slug"), Rule("median in band", _between("p", *band), applies=F.col("p").isNotNull(), sample="slug"),
        Rule("provenance", F.col("u").isNull() | (F.coalesce("n", F.lit(0)) == 0))]
    for k, lo, hi in (("pc", 0, 100), ("gr", 0, 100), ("grx", 0, 100), ("dmc", 0, 100), ("ag", 0, 100), ("pcm", -100, 0)):
        if k in columns:
            rules.append(Rule(f"{k} in range", _between(k, lo, hi), applies=F.col(k).isNotNull(), sample="slug"))
    if "dm" in columns:
        rules.append(Rule("time on market", F.col("dm") < 0, applies=F.col("dm").isNotNull()))
    if "pc" in columns:
        rules.append(Rule("cut rate has a denominator", F.coalesce("pcn", F.lit(0)) == 0, applies=F.col("pc").isNotNull()))
    return rules


def _series_rules(points: int, quote_gap: float, gap_severity: str, candles: bool) -> list[Rule | Total]:
    """Rows with s, p and hist, an array of dated points."""
    dates = F.transform("hist", lambda x: x["as_of"])
    ordered = (F.size(F.array_distinct(dates)) == F.size(dates)) & (F.array_sort(dates) == dates)
    last = F.element_at("hist", -1)["close"]
    rules: list[Rule | Total] = [
        _unique("s"), Rule("positive price", F.coalesce(F.col("p") <= 0, F.lit(True)), sample="s"),
        Rule("history long enough", F.coalesce(F.size("hist") < points, F.lit(True)), sample="s"), Rule("history in order", ~ordered, sample="s"),
        Rule("quote near last close", F.abs(ratio("p", last) - 1) > quote_gap, gap_severity, sample="s")]
    if candles:
        inverted = F.exists("hist", lambda x: (x["high"] < x["low"]) | (x["close"] < x["low"]) | (x["close"] > x["high"]))
        rules.append(Rule("candles upright", inverted, sample="s"))
    return rules


def us_rules() -> list[Rule | Total]:
    return [_total_rows("enough rows", fv.US_MIN_ROWS), *_series_rules(fv.US_MIN_SESSIONS, 0.10, "warn", True)]


def fx_rules() -> list[Rule | Total]:
    return [_total_rows("not empty", 1), *_series_rules(20, 0.20, "error", False)]


def coin_board_rules() -> list[Rule | Total]:
    moved = F.count_if(F.abs(F.coalesce("chp", F.lit(0.0))) > 0.01)
    return [_total_rows("enough rows", 20), _unique("s"), Rule("positive price", F.coalesce(F.col("p") <= 0, F.lit(True)), sample="s"), Total("board moves", moved < F.count(F.lit(1)) * 0.5),
            Rule("range position", _between("pos", 0, 100), applies=F.col("pos").isNotNull(), sample="s")]


def breadth_rules(columns: Sequence[str] = ()) -> list[Rule | Total]:
    """With `after`, the session that stands before a row in the published order, the order is held too."""
    rules: list[Rule | Total] = [_total_rows("enough sessions", 20), _unique("as_of")]
    if "after" in columns:
        rules.append(Rule("sessions in order", F.col("as_of") <= F.col("after"), applies=F.col("after").isNotNull(), sample="as_of"))
    rules += [Rule(f"{k} is a percentage", _between(k, 0, 100), applies=F.col(k).isNotNull(), sample="as_of") for k in ("a50", "a200", "uv")]
    return [*rules, Rule("covers the market", F.col("n") < F.col("median_universe") * 0.6 * 0.5, "warn", F.col("median_universe") > 0, sample="as_of")]


def flow_rules(lo: float = fv.FLOW_DAY_RANGE[0], hi: float = fv.FLOW_DAY_RANGE[1]) -> list[Rule | Total]:
    """Rows of the flow document: asset, d, v, issuers."""
    uneven = F.exists(F.map_values("issuers"), lambda s: F.size(s["d"]) != F.size(s["v"]))
    return [_total_rows("any asset", 1), Rule("has values", F.coalesce(F.size("v") == 0, F.lit(True)), sample="asset"), Rule("dates match values", F.size("d") != F.size("v"), sample="asset"),
            Rule("daily flow plausible", F.exists("v", lambda x: (x < lo) | (x > hi)), sample="asset"), Rule("issuers present", F.coalesce(F.size("issuers") == 0, F.lit(True)), sample="asset"),
            Rule("issuer arrays match", uneven, sample="asset")]


def signal_rules() -> list[Rule | Total]:
    """Structure only (universe, rules text, benchmark): a losing record is still a result."""
    return [Total("has statistics", F.count("trades") == 0), Rule("universe not empty", F.coalesce(F.col("universe") <= 0, F.lit(True))), Rule("rules stated", F.coalesce(F.col("rules"), F.lit("")) == ""),
            Rule("benchmark present", F.col("benchmark").isNull(), "warn")]


def news_rules(today: Column, per_symbol: int = fv.NEWS_PER_SYMBOL) -> list[Rule | Total]:
    """Rows of news_per_symbol with `listed` telling whether the symbol is in the published universe."""
    return [_total_rows("any link", 1), Rule("symbol is listed", ~F.col("listed"), sample="symbol"), Rule("at most ten per symbol", F.col("rank") > per_symbol, sample="symbol"),
            Rule("has title", F.coalesce(F.col("title"), F.lit("")) == "", sample="symbol"), Rule("valid address", ~F.coalesce(F.col("url").rlike(r"^https?://[^/\s]+"), F.lit(False)), sample="url"),
            Rule("known method", ~F.coalesce(F.col("matched_by").isin("name", "alias", "symbol"), F.lit(False)), sample="matched_by"),
            Rule("not in the future", F.to_date("published_at") > today, applies=F.col("published_at").isNotNull(), sample="url")]


def gamma_rules(expected: str) -> list[Rule | Total]:
    bands = F.lit(False)
    for sym, (lo, hi) in fv.GEX_SPOT_RANGE.items():
        bands = bands | ((F.lower("sym") == sym) & F.col("spot").between(lo, hi))
    missing = F.lit(False)
    for k in ("spot", "net_gex", "gamma_flip", "max_pain"):
        missing = missing | F.col(k).isNull()
    return [_total_rows("not empty", 1), Rule("numbers present", missing, sample="sym"), Rule("known symbol", ~F.lower("sym").isin(list(fv.GEX_SPOT_RANGE)), sample="sym"),
            Rule("spot in band", ~bands, applies=F.col("spot").isNotNull(), sample="sym"), Rule("has contracts", F.coalesce(F.col("contracts") <= 0, F.lit(True))),
            Rule("symbol matches file", F.coalesce(F.lower("sym") != expected, F.lit(True)), sample="sym")]


def manifest_rules(at_least: int = 1500) -> list[Rule | Total]:
    """One-row manifest joined with the count of stored files."""
    return [Rule("count matches files", F.col("count") != F.col("files")), Rule("broad coverage", F.col("count") < at_least), Rule("dossier coverage", F.col("dossiers") < F.col("count") * 0.95),
            Rule("statement coverage", F.col("statements") < F.col("count") * 0.90), Rule("plausible counts", (F.col("dossiers") > F.col("count")) | (F.col("statements") > F.col("count")))]


def dossier_rules(columns: Sequence[str] = ()) -> list[Rule | Total]:
    """With `profile` (has_company, a flag, says whether there is a company part) and `st`, the map of statements, their shapes too."""
    rules: list[Rule | Total] = [
        _unique("s"), Rule("has ratios", F.coalesce(F.size("m") == 0, F.lit(True)), sample="s"),
        Rule("points have a cadence", F.exists(F.map_values("m"), lambda g: g["q"].isNull() & g["y"].isNull()), sample="s")]
    if "profile" in columns:
        rules.append(Rule("company part has a profile", F.coalesce(F.col("profile"), F.lit("")) == "", applies=F.col("has_company"), sample="s"))
    if "st" in columns:
        blank = lambda x: F.coalesce(x["label"], F.lit("")) == ""
        rules += [Rule("statements not empty", F.size("st") == 0, applies=F.col("st").isNotNull(), sample="s"),
                  Rule("statements have label and series", F.exists(F.map_values("st"), lambda x: blank(x) | (x["q"].isNull() & x["y"].isNull())), applies=F.col("st").isNotNull(), sample="s")]
    return rules


def shard_rules(band=fv.PRICE_BAND, tolerance: float = fv.CONSISTENCY_TOLERANCE) -> list[Rule | Total]:
    """Browse rows with their index's expected count: unique keys are checked on the index."""
    implied = F.col("tp") * 1000 / F.nullif("sz", F.lit(0.0))
    return [_total_rows("not empty", 1), Rule("price in band", F.coalesce(_between("p", *band), F.lit(True)), sample="k"),
            Rule("price, size and total agree", (F.abs(ratio(implied, "p") - 1) > tolerance) & (implied > 0), applies=F.col("sz") > 0, sample="k")]


def shard_index_rules() -> list[Rule | Total]:
    return [_total_rows("not empty", 1), _unique("k"), Rule("shard exists", F.col("rows").isNull(), sample="k"), Rule("count agrees", F.col("rows") != F.col("n"), applies=F.col("rows").isNotNull(), sample="k")]


def profile_rules() -> list[Rule | Total]:
    """Coin profiles after the identity check."""
    return [_total_rows("not empty", 1), _unique("symbol"), Rule("supply within maximum", F.col("supply") > F.col("max_supply") * 1.01, applies=F.col("max_supply") > 0, sample="symbol"),
            Rule("value within diluted value", F.col("mc") > F.col("fdv") * 1.01, applies=F.col("fdv") > 0, sample="symbol"), Rule("same coin", F.col("mismatched"), sample="symbol"),
            Total("mostly described", F.count("description") < F.count(F.lit(1)) * 0.5, "warn")]


def context_rules() -> list[Rule | Total]:
    """Long context rows: section, key, value, failed."""
    rules: list[Rule | Total] = []
    for path, lo, hi in fv.CONTEXT_BOUNDS:
        section, key = path.split(".")
        rules.append(Rule(path, _between("value", lo, hi), applies=(F.col("section") == section) & (F.col("key") == key) & F.col("value").isNotNull()))
    main = F.count_distinct(F.when(F.col("section").isin("network", "market", "mvrv", "tvl", "fng") & F.col("value").isNotNull(), F.col("section")))
    return [*rules, Total("enough sections", main < 3), Rule("sources answered", F.col("failed"), "warn", sample="section")]


def province_rules(today: Column) -> list[Rule | Total]:
    """Province citations, one row per province: planning_* and land_* columns."""
    has_plan, has_land = F.col("planning_decision").isNotNull(), F.col("land_decision").isNotNull()

    def dated(c):
        parsed = F.try_to_date(F.col(c), "yyyy-MM-dd")
        return parsed.isNull() | (parsed > today)

    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    land_doc = "^" + fv.LAND_DOCUMENT + "$"
    return [
        Total("all provinces", F.count(F.lit(1)) != fv.PROVINCE_COUNT), Total("some planning cited", F.count("planning_decision") == 0),
        Rule("planning number", ~F.col("planning_decision").rlike(fv.PLANNING_DOCUMENT), applies=has_plan, sample="name"), Rule("planning date", dated("planning_date"), applies=has_plan, sample="name"),
        Rule("planning title and source", blank("planning_title") | blank("planning_source"), applies=has_plan, sample="name"),
        Rule("land number", ~F.col("land_decision").rlike(land_doc), applies=has_land, sample="name"), Rule("land date", dated("land_date"), applies=has_land, sample="name"),
        Rule("land issuer", blank("land_issuer"), applies=has_land, sample="name"), Rule("land period", F.col("effective_from") > F.col("effective_to"), applies=has_land, sample="name"),
        Rule("land not expired", F.try_to_date("effective_to", "yyyy-MM-dd") < today, applies=has_land, sample="name"),
        Rule("land verification", ~F.coalesce(F.col("verified").isin("gazette", "secondary"), F.lit(False)) | ((F.col("verified") == "gazette") & blank("url")), applies=has_land, sample="name")]


def land_ratio_rules(min_streets: int = fv.MIN_STREETS, band=fv.RATIO_BAND) -> list[Rule | Total]:
    """District ratios, with `cited` the document its province names."""
    return [_total_rows("not empty", 1), Rule("enough streets", F.col("n") < min_streets, sample="d"), Rule("ratio in band", F.coalesce(_between("rr", *band), F.lit(True)), sample="d"),
            Rule("document named", F.coalesce(F.col("doc"), F.lit("")) == "", sample="d"), Rule("document is current", F.col("doc") != F.col("cited"), "warn", F.col("cited").isNotNull(), sample="d")]


def broker_rules(columns: Sequence[str] = ()) -> list[Rule | Total]:
    """Broker snapshots in long form: asset, version, kind, status, price, quote_at, timeframe columns.

    With `fields` (section -> names found in it), only what is meant to be published may be there.
    """
    live = F.col("status") == "snapshot"
    allowed: list[Rule | Total] = []
    if "fields" in columns:
        for section, names in fv.BROKER_FIELDS.items():
            found = F.coalesce(F.col("fields")[section], F.array().cast("array<string>"))
            extra = F.size(F.array_except(found, F.array(*[F.lit(n) for n in names]))) > 0
            allowed.append(Rule(f"only allowed fields in {section}", extra, sample="asset"))
    return [*allowed, Rule("asset and rule version", (F.col("asset") != "XAU") | (F.col("version") != fv.GATE_VERSION)), Rule("broker named", F.coalesce(F.col("kind") != "broker-xauusd", F.lit(True))),
            Rule("known status", ~F.coalesce(F.col("status").isin("not_connected", "snapshot"), F.lit(False))), Rule("no data without a connection", F.col("price").isNotNull(), applies=F.col("status") == "not_connected"),
            Rule("quote complete", F.col("price").isNull() | F.col("quote_at").isNull(), applies=live),
            Rule("frames complete", (F.col("h1_count") < fv.GATE["min_bars"]) | (F.col("h4_count") < fv.GATE["min_bars"]) | F.col("h1_atr").isNull() | F.col("h4_atr").isNull(), applies=live)]
