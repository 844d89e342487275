"""Declared observation tables: columns, keys, and the order that makes one row the newest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    key: tuple[str, ...]
    partition: str = "fetched_at"
    json_columns: tuple[str, ...] = field(default=())


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
          "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _table(name: str, columns: str, key: str, partition: str = "fetched_at") -> Table:
    keys = tuple(key.split())
    pairs = [c.split() for c in columns.split(",")]
    fields = [T.StructField(n, _TYPES[t], n not in keys) for n, t in pairs]
    return Table(name, T.StructType(fields), keys, partition)


TABLES: dict[str, Table] = {t.name: t for t in (
    _table("re_listing", """
        list_id bigint, source string, as_of timestamp, fetched_at timestamp, region string, district string,
        ward string, category string, house_type string, price double, size_m2 double, price_per_m2 double,
        rooms int, latitude double, longitude double, street_name string, subject string, legal_doc int,
        body string, is_agent boolean, account_name string, account_oid string, toilets int, direction string,
        floors int, ward_v3 string, region_v3 string, orig_list_time timestamp, image_count int,
        thumbnail string, state string, status string, price_string string, area_v2 int, region_v2 int,
        ward_v2 int""", "list_id fetched_at"),
    _table("re_land_price", """
        province string, street_key string, segment string, fetched_at timestamp, district string, street string,
        price_residential double, price_commercial double, source_doc string, source_url string, page int""",
           "province street_key segment fetched_at"),
    _table("eq_quote", """
        symbol string, as_of date, fetched_at timestamp, exchange string, price double, ref_price double,
        open_price double, high double, low double, volume bigint, value double, listed_share bigint,
        foreign_buy_value double, foreign_sell_value double, foreign_buy_vol bigint, foreign_sell_vol bigint""",
           "symbol as_of fetched_at"),
    _table("eq_fundamental", "symbol string, period string, metric string, value double, fetched_at timestamp",
           "symbol period metric fetched_at"),
    _table("eq_listing", "symbol string, organ_name string, exchange string, industry string, fetched_at timestamp",
           "symbol fetched_at"),
    _table("eq_company", """
        symbol string, organ_name string, short_name string, profile string, sector string, company_type string,
        listing_date date, state_percent double, foreign_percent double, rating string, target_price double,
        rating_as_of date, source string, fetched_at timestamp, meta string""", "symbol fetched_at"),
    _table("eq_owner", """
        symbol string, owner_name string, position_name string, owner_type string, quantity bigint,
        percentage double, update_date date, fetched_at timestamp""", "symbol owner_name position_name fetched_at"),
    _table("eq_relationship", """
        symbol string, related_code string, related_name string, relation_type string, ownership_percent double,
        fetched_at timestamp""", "symbol related_name relation_type fetched_at"),
    _table("eq_event", """
        symbol string, event_id string, event_code string, title string, description string, public_date date,
        record_date date, exright_date date, fetched_at timestamp, meta string""", "symbol event_id fetched_at"),
    _table("eq_statement", """
        symbol string, period string, period_type string, statement string, field string, label_vi string,
        label_en string, level int, value double, public_date date, fetched_at timestamp""",
           "symbol period statement field fetched_at"),
    _table("news_link", """
        symbol string, url string, title string, source string, published_at timestamp, matched_by string,
        fetched_at timestamp""", "symbol url fetched_at"),
    _table("metric_ts", """
        series string, as_of timestamp, value double, source string, fetched_at timestamp, meta string""",
           "series as_of fetched_at"),
    _table("run_log", """
        run_id string, collector string, started_at timestamp, finished_at timestamp, status string,
        rows_in bigint, rows_new bigint, detail string""", "run_id collector", "started_at"),
)}


def conform(df: DataFrame, table: str | Table) -> DataFrame:
    """Columns of a declared table in order: missing ones NULL, unknown ones dropped, types cast."""
    t = TABLES[table] if isinstance(table, str) else table
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in t.schema.fields
    ])


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table through its declared schema: columns added later read as NULL in old files."""
    t = TABLES[table]
    fields = T.StructType(list(t.schema.fields) + [T.StructField("fetched_date", T.DateType())])
    return spark.read.schema(fields).parquet(path)
