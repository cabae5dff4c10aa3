"""Relational tables: catalogue, snapshot pages and rows as JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions.predicates import effective_limit, scope_match
from arborlake.operators.ordered import number_rows
from arborlake.storage import materialize

DEFAULT_PAGE, MAX_PAGE = 100, 1_000
SYSTEM_SCHEMAS = ["information_schema", "mysql", "performance_schema", "sys"]


def read_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options) -> DataFrame:
    """Partitioned read over JDBC: Spark opens one query per key range and pushes filters down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions).load()


def table_columns(df: DataFrame, schema: str, table: str) -> DataFrame:
    """Catalogue rows of a table Spark knows."""
    rows = [(schema, table, f.name, i + 1, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "schema string, `table` string, `column` string, ordinal_position long, column_type string")


def discover_columns(columns: DataFrame, schema_scopes: list[str], table_scopes: list[str]) -> DataFrame:
    """Catalogue rows of user schemas inside the scopes."""
    lit = lambda scopes: F.array(*[F.lit(s) for s in scopes])
    return columns.where(
        ~F.lower("schema").isin(SYSTEM_SCHEMAS)
        & scope_match("schema", lit(schema_scopes)) & scope_match("table", lit(table_scopes))
    ).orderBy("schema", "table", "ordinal_position")


@dataclass(frozen=True)
class RowPage:
    rows: DataFrame
    has_more: bool
    next_offset: int | None


def snapshot_order(fields: list[str], primary_key: str | None, unique: bool) -> list[str]:
    """The primary key when it is selected, else the first field; a key that may repeat is
    followed by all fields so that pages do not overlap."""
    first = primary_key if primary_key in fields else fields[0]
    return [first] if unique and first == primary_key else [first, *[f for f in fields if f != first]]


def table_snapshot_all(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The chosen fields of all rows: a projection that the scan, or the database, takes over."""
    return df.select(*[F.col(f"`{f}`") for f in fields or df.columns])


def table_poll_all(df: DataFrame, cursor_field: str, after=None, fields: list[str] | None = None) -> DataFrame:
    """All rows whose cursor field is greater than the value that an earlier poll ended with."""
    chosen = df if after is None else df.where(F.col(f"`{cursor_field}`") > F.lit(after))
    return table_snapshot_all(chosen, fields)


def freeze_table(df: DataFrame, fields: list[str] | None = None, primary_key: str | None = None, unique: bool = True) -> DataFrame:
    """A consistent copy of the chosen fields, numbered in page order; write it once, page it often."""
    chosen = fields or df.columns
    order = F.struct(*snapshot_order(chosen, primary_key, unique))
    keyed = df.select(*chosen, F.lit(0).alias("_all"), order.alias("_order"))
    return materialize(number_rows(keyed, ["_all"], "_order", "row_no").drop("_all", "_order"), "frozen-table")


def table_snapshot(frozen: DataFrame, limit: int | None = None, offset: int = 0) -> RowPage:
    """A page of a frozen table, as a range of row numbers. One row past it tells whether more follow."""
    n = effective_limit(limit, DEFAULT_PAGE, MAX_PAGE)
    page = frozen.where((F.col("row_no") > offset) & (F.col("row_no") <= offset + n)).drop("row_no")
    more = not frozen.where(F.col("row_no") == offset + n + 1).isEmpty()
    return RowPage(page, more, offset + n if more else None)


def _json_value(name: str, kind: T.DataType) -> Column:
    v = F.col(f"`{name}`")
    if isinstance(kind, T.BinaryType):
        text = v.cast("string")
        return F.when(F.is_valid_utf8(text), text).otherwise(F.base64(v))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        wide = v.cast("double")
        return F.when(~F.isnan(wide) & (F.abs(wide) != float("inf")), wide)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if isinstance(kind, T.DayTimeIntervalType):
        micros = F.round(F.extract(F.lit("DAY"), v) * 86_400_000_000 + F.extract(F.lit("HOUR"), v) * 3_600_000_000
                         + F.extract(F.lit("MINUTE"), v) * 60_000_000 + F.extract(F.lit("SECOND"), v) * 1_000_000).cast("long")
        a = F.abs(micros)
        part = lambda unit, size: F.floor(a / unit) % size
        return F.format_string(
            "%s%dd %02d:%02d:%02d.%06d", F.when(micros < 0, F.lit("-")).otherwise(F.lit("")), F.floor(a / 86_400_000_000),
            part(3_600_000_000, 24), part(60_000_000, 60), part(1_000_000, 60), a % 1_000_000,
        )
    if isinstance(kind, T.DecimalType):
        return v.cast("string")
    return v


def row_to_json(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One JSON object per row; nulls are kept, non-finite floats become null, binary that is no
    UTF-8 becomes base64."""
    chosen = fields or df.columns
    values = [_json_value(n, df.schema[n].dataType).alias(n) for n in chosen]
    return df.select(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("values"))
