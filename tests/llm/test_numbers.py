"""Shards, neighbours and the pipeline."""

import heapq
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arborlake.llm import neighbours, sharding, toxicity
from tests.llm.conftest import SCHEMA
from tests.llm.test_dedup import near, strip
from tests.llm.test_text import check_pieces


def plain_differencing(sizes, k):
    """Sums of Karmarkar-Karp differencing on tuples, without membership."""
    heap = [(-s, i, tuple([0] * (k - 1) + [s])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        new = tuple(sorted(x + y for x, y in zip(a, reversed(b))))
        heapq.heappush(heap, (new[0] - new[-1], n, new))
        n += 1
    return list(heap[0][2])


def test_differencing():
    rng = random.Random(1)
    for n, k in ((1, 4), (5, 3), (60, 4), (300, 16)):
        sizes = [rng.randrange(1, 1000) for _ in range(n)]
        sums = np.zeros((n, k), np.int64)
        sums[:, k - 1] = sizes
        total, places = sharding.difference(sums)
        assert total.tolist() == plain_differencing(sizes, k)
        assert np.bincount(places[:, k - 1], sizes, k).astype(int).tolist() == total.tolist()
        assert all(sorted(p) == list(range(k)) for p in places.tolist())


@pytest.mark.parametrize("block, bundle", [(20_000, 512), (7, 2)])
def test_shards(edge_docs, edge_rows, no_docs, monkeypatch, block, bundle):
    """Also in many small blocks, over several levels."""
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", block)
    monkeypatch.setattr(sharding, "BUNDLE", bundle)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 5)
    rows = sharding.shards(edge_docs, 4).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    shard_of, slots, sums = {}, defaultdict(list), Counter()
    for r in rows:
        assert shard_of.setdefault((r["size"], r.text_crc32), r.shard) == r.shard and 0 <= r.shard < 4
        assert r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sums[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) <= sum(sums.values()) / 4 + max(k[1] for k in want) * 2
    assert sharding.shards(no_docs, 4).collect() == []


def exact(rows, queries, k):
    """Brute force over the rows that take part."""
    held = {}
    for i, v in rows:
        if i is None or v is None or len(v) != 8 or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        if i not in held or list(v) < held[i]:
            held[i] = list(v)
    ids = sorted(held)
    x = np.array([held[i] for i in ids], np.float32).astype(float)
    out = {}
    for q in ids:
        if queries(q):
            d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
            found = sorted((float(s), i) for s, i in zip(d, ids) if i != q)[:k]
            out[q] = found
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=8)).astype(np.float32).tolist()) for i in range(2500)]
    rows += [(i, rows[3][1]) for i in range(3000, 3400)]  # one vector many times
    odd = [(5000, None), (5100, [0.0] * 8), (5200, [1.0, None] + [1.0] * 6), (5300, [float("nan")] * 8), (5400, [float("inf")] + [1.0] * 7), (5500, [1.0] * 3), (None, [1.0] * 8), (7, [50.0] * 8), (100, [60.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as part", "'x' as v", "2 as score")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    want = exact(rows + odd, lambda i: i % 20 == 0, 10)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 10
        for score, i in found:
            assert q != i
    # equal vectors come nearest first and by id
    assert [i for _, i in got[3000]] == sorted({3, *range(3000, 3400)} - {3000})[:10]


def test_few_neighbours(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], schema)
    got = [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 0.0), (0, 2, 1, math.sqrt(2))]
    one = df.limit(1)
    assert neighbours.nearest(one, F.col("vec_id") >= 0).collect() == []
    none = spark.createDataFrame([], schema)
    assert neighbours.nearest(none, F.col("vec_id") >= 0).collect() == []


def test_equal_vectors_do_not_starve_a_query(spark):
    """Nearly all rows are alike and crowd one part: the others hold too few rows by themselves."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1, 2990)] + [(3000 + 20 * i, [-5.0 - i, float(i), 40.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0).groupBy("query_id").count().collect()
    assert len(found) == sum(i % 20 == 0 for i, _ in rows) and all(r["count"] == 10 for r in found)


def test_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    v = {r.vec_id: np.array(r.embedding, float) for r in df.filter(neighbours.usable(F.col("embedding"))).collect()}
    ids, x = np.array(list(v)), np.stack(list(v.values()))
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    near = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - v[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        assert len(found[q]) == 10
        near, total = near + len(best & found[q].keys()), total + 10
    assert near >= 0.9 * total


def stages(spark, docs, folder):
    """What each stage gives and gets."""
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema) if name != "packing" else stage(spark, docs, folder)
        yield name, before, docs


def check_stages(spark, docs, folder):
    columns = docs.columns
    for name, before, after in stages(spark, docs, folder):
        if name == "packing":
            rows = after.collect()
            from arborlake.llm import packing

            whole = packing.pieces(spark.createDataFrame(before, SCHEMA if len(columns) > 5 else docs.schema), *_vocabulary())
            check_pieces(whole.collect(), [r[:2] for r in before])
            assert len(rows) == whole.count()
            continue
        assert after.columns == columns, name
        rows = [tuple(r) for r in after.collect()]
        if name == "toxicity":
            model = toxicity.fit(spark.createDataFrame(before, docs.schema), spark.read.parquet(f"{folder}/labels.parquet"))
            assert Counter(rows) == Counter(r for r in before if model.score(r[1])[0] < 0.5)
        if name == "exact_dedup":
            best = {}
            for r in before:
                best.setdefault(r[1] or "", []).append(-1 << 70 if r[0] is None else r[0])
            assert {(r[1] or "", -1 << 70 if r[0] is None else r[0]) for r in rows} == {(t, max(i)) for t, i in best.items()} and len(rows) == len(best)
        if name == "near_dedup":
            part = {i: c for i, _, c in near([r[:2] for r in before], 5, 80)}
            assert Counter(rows) == Counter(r for r in before if r[0] is None or part[r[0]] == r[0])
        if name == "suffix_dedup":
            want = strip([r[:2] for r in before], 100)
            assert Counter((r[0], r[1] is None) for r in rows) == Counter((r[0], r[1] is None) for r in before)
            untouched = {r for r in before if not want[r[0], r[1]][1] and r[4] == len(r[1] or "")}
            assert untouched <= set(rows)
            assert all(r[4] == len(r[1]) for r in rows if r[1] is not None)


def _vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def test_pipeline_on_odd_documents(spark, edge_docs, folder):
    check_stages(spark, edge_docs, folder)


def test_pipeline_on_the_tables(spark, folder):
    check_stages(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)


def test_pipeline_without_documents(spark, no_docs, folder):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
