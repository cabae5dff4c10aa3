"""Ordered pages: per-group tops, byte budgets, ranking, keyset cursors and frozen results."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.functions.predicates import GROUP_ORDERS, QueryParameterError
from arborlake.operators.ordered import number_rows
from arborlake.storage import work_dir

SALTS = 32


def top_per_group(
    df: DataFrame, by: list[str], order: list[Column], limit: int, offset: int = 0, spread: str = "path"
) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` of each group in ``order``, with ``position``.

    A group may hold most of the table, so it is first cut into salted parts that keep only their
    own first rows; the final ordering then sees at most ``SALTS`` times that many rows a group.
    """
    need = offset + limit
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    part = W.partitionBy(*by, "_salt").orderBy(*order)
    whole = W.partitionBy(*by).orderBy(*order)
    first = salted.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= need).drop("_n", "_salt")
    ranked = first.withColumn("position", F.row_number().over(whole))
    return ranked.where((F.col("position") > offset) & (F.col("position") <= need))


def entry_page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of one ordered result; Spark runs it as a distributed top-k."""
    return df.orderBy(*order).offset(offset).limit(limit)


class PageBudgetError(ValueError):
    """Not even one entry fits the byte budget."""


def byte_budget_page(page: DataFrame, by: list[str], position: str, limit_bytes: int, head_bytes: int = 0) -> DataFrame:
    """The longest prefix of a page whose JSON encoding fits ``limit_bytes``.

    The page is already cut to at most one page of entries per group. A first entry that does not
    fit is kept with ``fits = false`` so that the caller can fail instead of losing it.
    """
    cols = [c for c in page.columns if c not in by]
    size = F.octet_length(F.to_json(F.struct(*cols))) + 1
    w = W.partitionBy(*by).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(size).over(w) + head_bytes
    return (
        page.withColumn("encoded_bytes", total.cast("long"))
        .withColumn("fits", F.col("encoded_bytes") <= limit_bytes)
        .withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(position)))
        .where(F.col("fits") | (F.col("_n") == 1))
        .drop("_n")
    )


def require_fit(page: DataFrame) -> DataFrame:
    bad = page.where("not fits").first()
    if bad is not None:
        raise PageBudgetError(f"an entry of {bad.encoded_bytes} bytes exceeds the byte budget")
    return page.drop("fits", "encoded_bytes")


def rank_groups(groups: DataFrame, stats: DataFrame, order: str) -> DataFrame:
    """Rank of every group: by key, by file count or by newest file; ties by key. Groups without
    a row in ``stats`` rank with a zero metric. There is one row for each group by now, an id and a number, so one
    ordered window numbers them."""
    if order not in GROUP_ORDERS:
        raise QueryParameterError(f"unknown group_order {order!r}")
    metric = {
        "group-key": F.lit(0).cast("long"),
        "file-count": F.coalesce("total_files", F.lit(0)).cast("long"),
        "file-age": F.coalesce("latest_file_mtime_us", F.lit(0)).cast("long"),
    }[order]
    joined = groups.select("group_id").join(stats, "group_id", "left").withColumn("metric", metric)
    return joined.select("group_id", "metric", F.row_number().over(W.orderBy(F.col("metric").desc(), "group_id")).alias("rank"))


@dataclass(frozen=True)
class GroupPage:
    groups: DataFrame
    has_more: bool
    next_cursor: int | None


def group_page(ranked: DataFrame, size: int, after: int = 0) -> GroupPage:
    rows = ranked.where((F.col("rank") > after) & (F.col("rank") <= after + size))
    more = not ranked.where(F.col("rank") > after + size).isEmpty()
    return GroupPage(rows, more, after + size if more else None)


def after_cursor(df: DataFrame, columns: list[str], cursor: tuple | None) -> DataFrame:
    """Rows strictly after an ordered tuple, nulls last in every column; the first column also bounds the scan."""
    if cursor is None:
        return df
    later, same = F.lit(False), F.lit(True)
    for name, value in zip(columns, cursor):
        mark = F.lit(value).cast(df.schema[name].dataType)
        # nothing comes after a null
        after = F.lit(False) if value is None else F.col(name).isNull() | (F.col(name) > mark)
        later = later | (same & after)
        same = same & F.col(name).eqNullSafe(mark)
    if cursor[0] is None:
        return df.where(F.col(columns[0]).isNull() & later)
    first = F.col(columns[0])
    return df.where((first.isNull() | (first >= F.lit(cursor[0]).cast(df.schema[columns[0]].dataType))) & later)


@dataclass(frozen=True)
class KeysetPage:
    rows: DataFrame
    has_more: bool
    next_cursor: tuple | None


def keyset_page(df: DataFrame, columns: list[str], limit: int, cursor: tuple | None = None) -> KeysetPage:
    """A page in the order of ``columns``, nulls last, which together tell rows apart. One row past the page tells
    whether more follow; page and cursor come from one pass."""
    ordered = after_cursor(df, columns, cursor).orderBy(*[F.col(c).asc_nulls_last() for c in columns])
    rows = ordered.limit(limit + 1).collect()
    page = rows[:limit]
    last = tuple(page[-1][c] for c in columns) if page else cursor
    return KeysetPage(df.sparkSession.createDataFrame(page, df.schema), len(rows) > limit, last)


def all_pages(read: Callable[[tuple | None], KeysetPage]) -> DataFrame:
    """Follow the cursors of a paged read to its end. The same rows as a whole come from the operators that
    end in ``_all`` without any paging."""
    page = read(None)
    rows = page.rows
    while page.has_more:
        page = read(page.next_cursor)
        rows = rows.unionByName(page.rows)
    return rows


class PitExpired(LookupError):
    """The frozen result is over or unknown."""


@dataclass(frozen=True)
class Pit:
    id: str
    path: str
    expires_at_ms: int


def open_pit(result: DataFrame, ttl_ms: int = 60_000, now_ms: int | None = None) -> Pit:
    """Freeze a ranked result. Every continuation reads the frozen rows, never the live table."""
    now = int(time.time() * 1000) if now_ms is None else now_ms
    pit_id = uuid.uuid4().hex
    path = f"{work_dir(result.sparkSession)}/arborlake/pit-{pit_id}"
    result.write.mode("errorifexists").parquet(path)
    return Pit(pit_id, path, now + ttl_ms)


def freeze_pages(entries: DataFrame, by: list[str], order: Column, ttl_ms: int = 60_000, now_ms: int | None = None) -> Pit:
    """Freeze a result with the ``position`` of every row in its group, so that any later page is a
    range filter on the frozen table, however deep it lies."""
    numbered = number_rows(entries.withColumn("_order", order), by, "_order", "position").drop("_order")
    return open_pit(numbered, ttl_ms, now_ms)


def page_of(frozen: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return frozen.where((F.col("position") > offset) & (F.col("position") <= offset + limit))


def read_pit(spark: SparkSession, pit: Pit, now_ms: int | None = None) -> DataFrame:
    now = int(time.time() * 1000) if now_ms is None else now_ms
    if now >= pit.expires_at_ms:
        raise PitExpired(pit.id)
    return spark.read.parquet(pit.path)
