"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

A *partial partition* holds one subset for each shard, with their byte sums. Differencing takes the two
partial partitions of largest spread (largest minus smallest sum) and adds them in opposite order: the
largest subset of one joins the smallest of the other. It ends with one partial partition, the result.

The groups (rows of equal text) are dealt over blocks of bounded size; each block is differenced in a task of
its own, and the blocks' partial partitions are differenced again, bundle by bundle, until one is left. A
level hands on only the sums of its subsets and the permutation that it chose, so no task and no driver ever
sees more than a block or bundle.

Cases: a null text has no bytes and is grouped with empty texts. Rows that repeat a doc_id are rows like any
other. An empty table gives an empty result. A group larger than a shard's share leaves that shard larger.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.storage import materialize

#: Groups in a block, partial partitions in a bundle, rows numbered in one task.
BLOCK_GROUPS = 20_000
BUNDLE = 512
SLOT_ROWS = 20_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows of subset sums) into one.

    Returns the sums of the result, ascending, and for each input row the place of each of its subsets.
    """
    n, k = sums.shape
    rows = [sorted(zip(r, range(k))) for r in sums.tolist()]
    # a leaf starts in ascending order; node i of the merge tree holds (left, right, left's and right's new places)
    heap = [(r[0][0] - r[-1][0], i) for i, r in enumerate(rows)]
    heapq.heapify(heap)
    live = {i: [s for s, _ in r] for i, r in enumerate(rows)}
    nodes: list[tuple[int, int, list[int]]] = []
    top = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        left, right = live.pop(a), live.pop(b)
        added = [x + y for x, y in zip(left, reversed(right))]
        order = sorted(range(k), key=added.__getitem__)
        place = [0] * k
        for new, old in enumerate(order):
            place[old] = new
        nodes.append((a, b, place))
        live[top] = total = [added[i] for i in order]
        heapq.heappush(heap, (total[0] - total[-1], top))
        top += 1
    places = np.empty((top, k), np.int32)
    places[top - 1] = np.arange(k)
    for at in range(top - 1, n - 1, -1):
        a, b, place = nodes[at - n]
        moved = places[at][place]
        places[a] = moved
        places[b] = moved[::-1]
    out = np.empty((n, k), np.int32)
    for i, r in enumerate(rows):
        out[i, [j for _, j in r]] = places[i]
    return np.array(live[top - 1] if n else [0] * k, np.int64), out


def _block(k: int):
    """One block of groups: each is a partial partition with all its bytes in one subset."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "sha"], ascending=[False, True], kind="stable")
        sums = np.zeros((len(group), k), np.int64)
        sums[:, k - 1] = group["bytes"].to_numpy()
        total, places = difference(sums)
        return pd.DataFrame({"block": group["block"], "sha": group["sha"], "place": places[:, k - 1], "sums": [None] * (len(group) - 1) + [total]})

    return run


def _bundle(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("block")
    total, places = difference(np.stack(group["sums"].to_numpy()))
    return pd.DataFrame({"bundle": group["bundle"], "block": group["block"], "places": list(places), "sums": [None] * (len(group) - 1) + [total]})


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(sha, bytes) of every group -> (sha, shard)."""
    blocks = max(1, -(-groups.count() // BLOCK_GROUPS))
    dealt = groups.select("sha", "bytes", F.pmod(F.xxhash64("sha", F.lit(1)), F.lit(blocks)).alias("block"))
    first = materialize(
        dealt.groupBy("block").applyInPandas(_block(shards), "block long, sha string, place int, sums array<long>"), "shard-block"
    )
    # top-level bins of the blocks: permutations of every level, composed upwards
    level = first.filter("sums is not null").select("block", "sums")
    placed = first.select("sha", F.col("block").alias("at"), "place")
    while blocks > 1:
        bundles = -(-blocks // BUNDLE)
        merged = materialize(
            level.select("block", "sums", F.pmod("block", F.lit(bundles)).alias("bundle"))
            .groupBy("bundle")
            .applyInPandas(_bundle, "bundle long, block long, places array<int>, sums array<long>"),
            "shard-bundle",
        )
        step = merged.select(F.col("block").alias("at"), F.col("bundle").alias("up"), "places")
        placed = placed.join(step, "at").select("sha", F.col("up").alias("at"), F.get("places", F.col("place")).alias("place"))
        level = merged.filter("sums is not null").select(F.col("bundle").alias("block"), "sums")
        blocks = bundles
    return materialize(placed.select("sha", F.col("place").alias("shard")), "shard-groups")


def shards(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (always `bytes`), shard, slot, grown_shard (always null)."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(content) + 1).cast("long").alias("size"),
            F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"),
            F.sha2(content, 256).alias("sha"),
            F.monotonically_increasing_id().alias("n"),
        ),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("sha").agg(F.sum("size").alias("bytes")), "shard-sizes")
    parts = max(1, -(-rows.count() // SLOT_ROWS))
    placed = materialize(
        rows.join(assign_groups(groups, n_shards), "sha").select(
            "doc_id", "size", "text_crc32", "shard", "n", F.pmod(F.xxhash64("n"), F.lit(parts)).cast("int").alias("part")
        ),
        "shard-placed",
    )
    # slots: parts of a shard stand one after the other, rows are numbered inside their part
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("n")
    return (
        placed.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
