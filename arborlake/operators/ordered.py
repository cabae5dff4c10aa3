"""Order-dependent columns without one task per group.

A log is ordered by ``seq`` inside a group, and ``(group, seq)`` is unique. Cutting ``seq`` into
buckets of a fixed width bounds every window and every join key to ``width`` rows, however large
the group is; what crosses buckets is one carried value per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.skew import lookup_join
from arborlake.storage import materialize

BUCKET_WIDTH = 1 << 16


def bucket_of(order: str | Column, width: int = BUCKET_WIDTH) -> Column:
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(width)).cast("long")


def running_max(
    df: DataFrame, by: Sequence[str], order: str, value: str, out: str, width: int = BUCKET_WIDTH, start: str | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running maximum of ``value`` in ``order`` per ``by`` key, with or without the current row.

    ``start`` names a column with a floor carried in from earlier batches.
    """
    by = list(by)
    bucketed = df.withColumn("_b", bucket_of(order, width))
    tops = bucketed.groupBy(*by, "_b").agg(F.max(value).alias("_top"))
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carries = tops.select(*by, "_b", F.max("_top").over(before).alias("_carry"))
    inside = W.partitionBy(*by, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = F.max(value).over(inside)
    parts = [local, F.col("_carry")] + ([F.col(start)] if start else [])
    return bucketed.join(carries, [*by, "_b"]).withColumn(out, F.greatest(*parts)).drop("_b", "_carry")


def number_rows(df: DataFrame, by: Sequence[str], order: str, out: str, start: int = 1) -> DataFrame:
    """Dense row numbers per ``by`` key in ``order``, without one window per key: rows are ordered
    across range partitions and numbered inside each; the counts of earlier partitions are added."""
    by = list(by)
    ranged = df.repartitionByRange(*by, order).sortWithinPartitions(*by, order)
    local = materialize(
        ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "numbered"
    )
    counts = local.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*by, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return lookup_join(local, offsets, [*by, "_part"], "inner", salt_from=["_row"]).withColumn(
        out, F.col("_row") - F.col("_first") + F.col("_off") + start
    ).drop("_part", "_row", "_first", "_off")


def as_of(
    probes: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    order: str,
    values: Sequence[str],
    out: str,
    forward: bool = False,
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Nearest event strictly before (or after) each probe.

    Adds ``out``: a struct of the event's ``order`` and ``values``, or null. A key of the join is
    (by, bucket), which holds at most ``width`` events and, for probes that are unique in
    (by, order), at most ``width`` probes.
    """
    by = list(by)
    event = F.struct(F.col(order).alias("at"), *[F.col(v) for v in values])
    grouped = (
        events.withColumn("_b", bucket_of(order, width))
        .groupBy(*by, "_b")
        .agg(F.array_sort(F.collect_list(event)).alias("_events"))
    )
    wanted = probes.withColumn("_b", bucket_of(order, width))
    buckets = grouped.unionByName(
        wanted.select(*by, "_b").distinct(), allowMissingColumns=True
    ).groupBy(*by, "_b").agg(F.first("_events", ignorenulls=True).alias("_events"))
    edge = F.element_at("_events", 1 if forward else -1)
    w = W.partitionBy(*by).orderBy(F.col("_b").desc() if forward else F.col("_b"))
    carried = buckets.withColumn(
        "_carry", F.last(edge, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    )
    joined = wanted.join(carried, [*by, "_b"], "left")
    return joined.withColumn(out, F.coalesce(_nearest(order, forward), F.col("_carry"))).drop("_b", "_events", "_carry")


def _nearest(order: str, forward: bool) -> Column:
    if forward:
        return F.try_element_at(F.filter("_events", lambda e: e["at"] > F.col(order)), F.lit(1))
    return F.try_element_at(F.filter("_events", lambda e: e["at"] < F.col(order)), F.lit(-1))
