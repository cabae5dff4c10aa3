"""Approximate nearest neighbours over learned partitions.

The neighbour graph of a sample is cut into parts of equal size with few edges between them. A small network
learns, for a vector, how its neighbours are spread over the parts. It puts every row into its likeliest part and
sends a query to so many of its likeliest parts as held ``TARGET`` of the neighbours of the sample's own queries,
and to further ones where these hold too few rows; there every row is compared exactly.

A part is searched in blocks of bounded size, so a part that many equal vectors fall into is shared by many
tasks. Only the graph, the parts and the network come from the sample (``FIT_ROWS`` rows at most); every row is
indexed.

Cases: rows without an id and vectors that are null, zero, or hold null or non-finite components take no part,
nor do vectors of another length than the commonest (the smaller of two equally common). Of rows that repeat an id
the one with the smallest vector takes part. Ties in distance go to the smaller id. With fewer rows than asked for, all
are returned; with none, nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.storage import materialize

#: Bound of the sample; rows to a part, up to so many parts; neighbours in the graph.
FIT_ROWS = 4_000
PART_ROWS, MAX_PARTS = 512, 64
GRAPH_NEIGHBOURS = 10
HIDDEN, ROUNDS, RATE = 128, 200, 0.01
#: Share of the neighbours of the sample's own queries that the parts asked must hold.
TARGET = 0.97
#: Rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 4_000, 2_000


@dataclass
class Router:
    """The network (one hidden layer) and the number of parts that a query is sent to."""

    mean: np.ndarray
    scale: float
    layers: list[tuple[np.ndarray, np.ndarray]]
    parts: int
    probes: int

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        x = (vectors - self.mean) / self.scale
        (w1, b1), (w2, b2) = self.layers
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def ranked(self, vectors: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.scores(vectors), axis=1, kind="stable")[:, :n]

    def asked(self, vectors: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The parts that each vector is sent to: ``probes`` of them, and further ones until they hold ``least`` rows."""
        ranked = self.ranked(vectors, self.parts)
        short = (np.cumsum(sizes[ranked], axis=1) < least).sum(1) + 1
        return [row[:n] for row, n in zip(ranked, np.maximum(short, self.probes))]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of every row, (n, k)."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1000):
        d = squared(x[at : at + 1000], x)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 1000] = np.argsort(d, axis=1, kind="stable")[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Cut the graph into parts of nearly equal size: halves along main axes, then moves that cut fewer edges."""
    part = np.zeros(len(x), np.int64)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[rows] = first
            return
        centred = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        left = count // 2
        cut = len(rows) * left // count
        halve(order[:cut], first, left)
        halve(order[cut:], first + left, count - left)

    halve(np.arange(len(x)), 0, parts)
    source, target = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    most, least = int(np.ceil(1.1 * len(x) / parts)), int(0.9 * len(x) / parts)
    for _ in range(rounds):
        ties = np.zeros((len(x), parts))
        np.add.at(ties, (source, part[target]), 1)
        np.add.at(ties, (target, part[source]), 1)
        gain = ties.max(1) - ties[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(ties[i].argmax())
            if size[to] < most and size[part[i]] > least:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


def fit(x: np.ndarray, parts: int, k: int = 10, seed: int = 11) -> Router:
    """Learn the parts and the router from a sample of vectors."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    mean, scale = x.mean(0), float(x.std()) or 1.0
    if parts < 2 or n <= GRAPH_NEIGHBOURS:
        return Router(mean, scale, [(np.zeros((dim, 1)), np.zeros(1)), (np.zeros((1, 1)), np.zeros(1))], 1, 1)
    graph = neighbour_graph(x, GRAPH_NEIGHBOURS)
    part = balanced_parts(x, graph, parts)
    # the network learns where a vector and its neighbours are
    wanted = np.zeros((n, parts))
    np.add.at(wanted, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    wanted[np.arange(n), part] += 0.5
    z = (x - mean) / scale
    w = [rng.normal(0, np.sqrt(2 / dim), (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    for step in range(1, ROUNDS + 1):
        rows = rng.choice(n, min(n, 1024), replace=False)
        hidden = np.maximum(z[rows] @ w[0] + w[1], 0)
        out = hidden @ w[2] + w[3]
        p = np.exp(out - out.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        up = (p - wanted[rows]) / len(rows)
        back = (up @ w[2].T) * (hidden > 0)
        for v, m, s, g in zip(w, first, second, [z[rows].T @ back, back.sum(0), hidden.T @ up, up.sum(0)]):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    router = Router(mean, scale, [(w[0], w[1]), (w[2], w[3])], parts, parts)
    ranked = router.ranked(x, parts)
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(parts)[None].repeat(n, 0), 1)
    # how far down a row's list of parts its neighbours are found
    depth = np.sort(np.take_along_axis(place, ranked[graph[:, :k], 0], 1).ravel())
    router.probes = int(depth[min(len(depth) - 1, int(np.ceil(TARGET * len(depth))))]) + 1
    return router


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(rows: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row that ``is_query`` (of the id) holds for."""
    spark = rows.sparkSession
    v = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    kind = v.schema["vec_id"].dataType.simpleString()
    out = f"query_id {kind}, rank int, vec_id {kind}, score double"
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], out)
    held = materialize(v.filter(F.size("v") == dims[0].d).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-rows")
    total = held.count()
    sample = held.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toArrow()
    router = fit(_matrix(sample.column("v")), min(MAX_PARTS, max(1, total // PART_ROWS)), k)
    shared = spark.sparkContext.broadcast(router)

    def place(choose):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    parts = [list(map(int, p)) for p in choose(shared.value, _matrix(batch.column(1)))]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], ["vec_id", "v", "parts"])

        return run

    schema = f"vec_id {kind}, v {held.schema['v'].dataType.simpleString()}, parts array<int>"
    placed = held.mapInArrow(place(lambda router, x: router.ranked(x, 1)), schema)
    index = materialize(placed.select("vec_id", "v", F.col("parts")[0].alias("part")), "ann-index")
    # rows by part: at most MAX_PARTS numbers
    counts = index.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    filled = np.zeros(router.parts, np.int64)
    for row in counts.collect():
        filled[row.part] = row.n
    sent = held.filter(is_query).mapInArrow(place(lambda router, x: router.asked(x, filled, k + 1)), schema)
    asked = materialize(sent.select("vec_id", "v", F.explode("parts").alias("part")), "ann-queries")
    sizes = counts.select("part", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("row_blocks"))
    loads = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    blocks = F.broadcast(sizes.join(loads, "part"))
    mine = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["part", "a", "b"]
    candidates = index.join(blocks, "part").select("part", mine("row_blocks", 1).alias("a"), every("query_blocks").alias("b"), "vec_id", "v")
    queries = asked.join(blocks, "part").select("part", every("row_blocks").alias("a"), mine("query_blocks", 2).alias("b"), "vec_id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, asked_ids = np.array(left.column("vec_id").to_pylist()), np.array(right.column("vec_id").to_pylist())
            x, y = _matrix(left.column("v")), _matrix(right.column("v"))
            near = squared(y, x)
            # rounded distances choose, with room for their error; exact ones decide
            slack = 1e-9 * ((y * y).sum(1) + (x * x).sum(1).max())
            for q in range(len(y)):
                d = near[q]
                d[ids == asked_ids[q]] = np.inf
                limit = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
                at = np.flatnonzero((d <= limit + slack[q]) & (d < np.inf))
                exact = np.sqrt(((x[at] - y[q]) ** 2).sum(1))
                order = np.lexsort((ids[at], exact))[:k]
                found += [(asked_ids[q], ids[at[i]], exact[i]) for i in order]
        query, vec, score = zip(*found) if found else ((), (), ())
        id_type = right.schema.field("vec_id").type
        return pa.table({"query_id": pa.array(list(query), id_type), "vec_id": pa.array(list(vec), id_type), "score": pa.array(list(score), pa.float64())})

    local = candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(search, f"query_id {kind}, vec_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
