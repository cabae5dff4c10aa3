"""Exact deduplication in two passes over a Bloom filter.

The first pass builds a filter with two planes: a bit of the first plane says that some text was hashed to
it, a bit of the second that at least two were (or one text twice). A text whose bits are all set in the
second plane is *possibly repeated*; no repeated text is ever missed. The second pass tests every row; only
possibly repeated rows are shuffled, all others are answered where they are.

Cases: null texts count as empty. A null ``doc_id`` is smaller than any other. Rows that repeat both
``doc_id`` and text are separate members of their group, of which one stays. Empty tables give empty
results. Other columns of the input are ignored by ``duplicates`` and carried by ``keep_last``; of rows that repeat
an id and a text, a hash of their other columns decides which stays. A long text is hashed as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.storage import materialize

#: Bits for each row, and the bounds of a plane: 2**27 bits are 16 MB, all that is ever broadcast. A corpus
#: of more rows than the bound suits makes more rows shuffle; the result stays the same.
BITS_PER_ROW = 16
MIN_LOG2_BITS, MAX_LOG2_BITS = 20, 27
#: The filter is merged in pieces of so many bits.
PIECE_LOG2 = 16


def _positions(hashes: np.ndarray, log2_bits: int) -> np.ndarray:
    """Two bit positions for each 64-bit hash, one row each."""
    high = np.uint64(64 - log2_bits)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([hashes >> high, (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> high])


def _hashes(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)


def _partial(log2_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, counts = np.unique(_hashes(batch, "h"), return_counts=True)
            pos = _positions(values, log2_bits)
            seen, times = np.unique(pos.ravel(), return_counts=True)
            repeated = np.unique(np.concatenate([pos[:, counts > 1].ravel(), seen[times > 1]]))
            once, twice = seen.astype(np.uint32), repeated.astype(np.uint32)
            pieces = np.unique(once >> PIECE_LOG2)
            cut = lambda a: [np.ascontiguousarray(x).tobytes() for x in np.split(a, np.searchsorted(a >> PIECE_LOG2, pieces[1:]))]
            yield pa.record_batch(
                [pa.array(pieces.astype(np.int32)), pa.array(cut(once), pa.binary()), pa.array(cut(twice), pa.binary())],
                ["piece", "once", "twice"],
            )

    return build


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit of the second plane: set in a part's second plane, or in the first planes of two parts."""
    size = 1 << PIECE_LOG2
    planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for piece, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3))):
            first, second = planes.setdefault(piece, (np.zeros(size, bool), np.zeros(size, bool)))
            at = np.frombuffer(once, np.uint32) & np.uint32(size - 1)
            second[at] |= first[at]
            first[at] = True
            second[np.frombuffer(twice, np.uint32) & np.uint32(size - 1)] = True
    if planes:
        yield pa.record_batch(
            [pa.array(list(planes), pa.int32()), pa.array([np.packbits(s).tobytes() for _, s in planes.values()], pa.binary())],
            ["piece", "bits"],
        )


def repeat_filter(hashed: DataFrame, log2_bits: int) -> np.ndarray:
    """The second plane over column ``h``, as packed bits."""
    parts = hashed.select("h").mapInArrow(_partial(log2_bits), "piece int, once binary, twice binary")
    merged = parts.repartition("piece").mapInArrow(_merge, "piece int, bits binary")
    plane = np.zeros((1 << log2_bits) // 8, np.uint8)
    size = (1 << PIECE_LOG2) // 8
    for row in merged.toLocalIterator():
        plane[row.piece * size : (row.piece + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return plane


def with_possible(df: DataFrame, plane: np.ndarray, log2_bits: int) -> DataFrame:
    """``df`` with boolean ``possible``: whether the filter holds the hash in column ``h``."""
    bits = df.sparkSession.sparkContext.broadcast(plane)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            pos = _positions(_hashes(batch, "h"), log2_bits)
            found = (held[pos >> np.uint64(3)] >> (np.uint64(7) - (pos & np.uint64(7))).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.all(axis=0))], [*batch.schema.names, "possible"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(test, f"{kinds}, possible boolean")


def filter_bits(rows: int) -> int:
    return min(MAX_LOG2_BITS, max(MIN_LOG2_BITS, (max(rows, 1) * BITS_PER_ROW - 1).bit_length()))


def _content(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256. The largest doc_id of a group stays."""
    digests = materialize(
        docs.select(F.col(doc_id).alias("doc_id"), F.sha2(_content(text), 256).alias("text_sha256"), F.xxhash64(_content(text)).alias("h")),
        "exact-digests",
    )
    log2_bits = filter_bits(digests.count())
    tested = materialize(with_possible(digests, repeat_filter(digests, log2_bits), log2_bits), "exact-tested")
    straight = tested.filter(~F.col("possible")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    # written, so that a row keeps its number whatever is computed again
    rows = materialize(tested.filter("possible").select("doc_id", "text_sha256", F.monotonically_increasing_id().alias("n")), "exact-candidates")
    groups = materialize(
        rows.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "n")).alias("last"), F.count(F.lit(1)).alias("group_size")), "exact-groups"
    )
    judged = rows.join(groups, "text_sha256").select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("n") == F.col("last.n")).alias("kept"), "text_sha256"
    )
    return straight.unionByName(judged)


def keep_last(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row for each text, the one with the largest doc_id; all columns are kept.

    The rows of a group are combined before the shuffle, so copies do not meet in one task.
    """
    names = docs.columns
    carried = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.xxhash64(_content(text)).alias("h"))
    digests = materialize(carried.select("h"), "exact-digests")
    log2_bits = filter_bits(digests.count())
    tested = with_possible(carried, repeat_filter(digests, log2_bits), log2_bits)
    columns = [f"c{i}" for i in range(len(names))]
    key, order = f"c{names.index(text)}", f"c{names.index(doc_id)}"
    straight = tested.filter(~F.col("possible")).select(*columns)
    # a row of a group: the largest id; of rows that repeat it the one whose other columns hash highest, so that a task that
    # runs again chooses the same row
    others = [F.col(c) for c, f in zip(columns, docs.schema.fields) if "map<" not in f.dataType.simpleString()]
    chosen = (
        tested.filter("possible")
        .groupBy(F.sha2(F.coalesce(F.col(key), F.lit("")), 256).alias("sha"))
        .agg(F.max_by(F.struct(*columns), F.struct(order, F.xxhash64(*others))).alias("row"))
        .select("row.*")
    )
    out = straight.unionByName(chosen)
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
