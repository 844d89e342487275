"""Tolerant readers of numbers, dates and codes found in landed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions.numeric import col


def number(c) -> Column:
    """Text to double: blanks, dashes, garbage and NaN are NULL."""
    text = F.trim(col(c).cast("string"))
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))  # read once


def accounting_number(c) -> Column:
    """`1,234.5`, `(95.1)` as negative, any dash or blank as NULL."""
    text = F.trim(F.replace(col(c), F.lit(","), F.lit("")))
    negative = text.rlike(r"^\(.*\)$")
    value = F.regexp_replace(text, r"^\(|\)$", "").try_cast("double")
    return F.when(text.isin("", "-", "–", "—"), F.lit(None)).when(negative, -value).otherwise(
        text.try_cast("double"))


def dotted_price(c, band=fv.LAND_PRICE_BAND) -> Column:
    """First figure with dots as thousands separators, inside a plausible band."""
    figure = F.regexp_extract(col(c), r"\d{1,3}(?:\.\d{3})+", 0)
    value = F.replace(figure, F.lit("."), F.lit("")).try_cast("double")
    return F.when(value.between(*band), value)


def integer(c) -> Column:
    return number(c).try_cast("int")


def boolean(c) -> Column:
    """true/1/yes, NULL only where nothing was said."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("boolean")).otherwise(
        text.isin("true", "1", "yes", "1.0"))


def epoch_ms(c) -> Column:
    return F.when(col(c) != 0, F.timestamp_millis(col(c)))


def flexible_date(c) -> Column:
    """ISO date or timestamp, `01-Sep-26`, `20260901`, or epoch milliseconds."""
    text = F.trim(col(c).cast("string"))
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}")
    return (
        F.when(iso, F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
        .when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
        .when(text.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{2}$"), F.try_to_date(text, "d-MMM-yy"))
        .when(text.rlike(r"^\d{11,14}$"), F.to_date(F.timestamp_millis(text.try_cast("bigint"))))
    )


def day_month_year(c) -> Column:
    """`18 Sep 2026` or `18 September 2026`."""
    text = F.trim(col(c))
    return F.when(
        text.rlike(r"^\d{1,2} [A-Za-z]{3,} \d{4}$"),
        F.coalesce(F.try_to_date(text, "d MMM yyyy"), F.try_to_date(text, "d MMMM yyyy")),
    )


def rfc822(c) -> Column:
    """RSS dates in UTC; a numeric offset or a GMT/UTC suffix, the weekday optional."""
    text = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|Z)$", "+0000")
    text = F.when(text.rlike(r"\d{2}:\d{2}:\d{2}$"), F.concat(text, F.lit(" +0000"))).otherwise(text)
    return F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z"))


def quarter_label(year, quarter) -> Column:
    return F.concat(col(year).cast("int").cast("string"), F.lit("-Q"), col(quarter).cast("int").cast("string"))


def latest_completed_quarter(at) -> Column:
    """Label of the reporting quarter before the one a date falls in."""
    prior = F.add_months(col(at).cast("date"), -3)
    return quarter_label(F.year(prior), F.quarter(prior))


def packed_level(c, scale: float = fv.BOARD_PRICE_SCALE) -> Column:
    """`249.6|5360|i` to (price, volume); a zero price means no order."""
    parts = F.split(col(c), r"\|")
    price = number(F.try_element_at(parts, F.lit(1)))
    ok = F.contains(col(c), F.lit("|")) & (price > 0)
    return F.struct(
        F.when(ok, price * scale).alias("price"),
        F.when(ok, number(F.try_element_at(parts, F.lit(2)))).alias("volume"),
    )


def instrument(c) -> Column:
    """`SYM-DMMMYY-STRIKE-C|P` to its parts; expiry at 08:00 UTC; NULL for anything else."""
    pattern = r"^([A-Z]+)-(\d{1,2})([A-Z]{3})(\d{2})-([\d.]+)-([CP])$"

    def part(i):
        return F.regexp_extract(col(c), pattern, i)

    month = F.array_position(F.array(*[F.lit(m) for m in fv.MONTHS]), part(3))
    expiry = F.try_make_timestamp(
        years=F.lit(2000) + part(4).try_cast("int"), months=month.cast("int"), days=part(2).try_cast("int"),
        hours=F.lit(8), mins=F.lit(0), secs=F.lit(0))
    ok = col(c).rlike(pattern) & (month > 0) & expiry.isNotNull()
    return F.when(ok, F.struct(
        part(1).alias("symbol"), part(5).try_cast("double").alias("strike"), part(6).alias("kind"),
        expiry.alias("expiry")))
