"""Reads from stored heads against reads of the whole state."""

import random
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake import schemas as S
from arborlake.operators import heads as H
from arborlake.operators import rollup as U
from arborlake.operators import tree_query as Q
from arborlake.storage import materialize

QUERIES = ["/", "/a", "/a/b", "/a/b/f1", "/gone", "/a/t", "/x/b", "/none/at/all", "/d"]


def random_state(rng, n=120):
    rows = {}
    for _ in range(n):
        group = rng.choice(["g", "g", "h", "k"])
        path = rng.choice(["/", "/a", "/a/b", "/a/b/f1", "/gone/x", "/a/t", "/d"] if group != "k" else ["/b", "/b/f1"]) if rng.random() < 0.4 else (
            f"{rng.choice(['/a', '/a/b', '/d', '/d/e/f'] if group != 'k' else ['/b', '/b/q'])}/f{rng.randrange(9)}")
        tomb = rng.random() < 0.3 or path.startswith("/gone")
        rows[group, path] = (
            group, path, rng.randrange(100), rng.choice([5, 9, 9, 70]), 0, "/f" not in path, rng.choice([S.SCAN, S.REALTIME]), rng.random() < 0.7, None,
            rng.choice([None, 20, 60]), rng.random() < 0.1, tomb, None, None, None, 0, rng.choice([None, 3, 8]),
        )
    return list(rows.values())


def same(a: DataFrame, b: DataFrame):
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    assert Counter(map(str, a.select(*names).collect())) == Counter(map(str, b.select(*names).collect()))


def each(read):
    return reduce(DataFrame.unionByName, [read(q).withColumn("asked", F.lit(q)) for q in QUERIES])


@pytest.mark.parametrize("seed", [1, 2])
def test_reads_equal_those_of_the_state(spark, seed):
    rng = random.Random(seed)
    before = materialize(spark.createDataFrame(random_state(rng), S.STATE), "test-before")
    state = materialize(spark.createDataFrame(random_state(rng), S.STATE), "test-state")
    heads = materialize(H.refresh(H.build(before), *U.changed_rows(before, state), state), "test-heads")
    same(heads, H.build(state))
    same(H.rollup(heads), U.rollup_tree(state))
    same(each(lambda q: H.subtree_stats(heads, state, q)), each(lambda q: U.subtree_stats(state, q)))
    same(H.health_stats(heads, state, 30), U.health_stats(state, 30))
    groups = spark.createDataFrame([("g", False, None), ("h", True, 5), ("k", False, 7), ("none", False, None)], "group_id string, overflow_pending boolean, coverage_recovered_at_us long")
    for limit, q in ((None, "/a"), (4, "/"), (4, "/a/b"), (4, "/gone"), (2, "/x/b")):
        plain, stored = (Q.tree(state, groups, q, as_of_us=40, limit=limit, stored=s) for s in (None, heads))
        same(plain.heads, stored.heads)
        same(plain.entries, stored.entries)


def test_no_subtree_is_read_for_counters(spark):
    """Reads of the state are look-ups of one path, or of suspects by their time."""
    state = materialize(spark.createDataFrame(random_state(random.Random(3)), S.STATE), "test-state")
    heads = materialize(H.build(state), "test-heads")
    known = "/"
    for df in (H.subtree_stats(heads, state, known), H.health_stats(heads, state, 30)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        of_state = [line for line in scans if "test-state" in line or "is_tombstoned" in line.split("PushedFilters")[0]]
        assert of_state
        for line in of_state:
            pushed = line.split("PushedFilters:")[1]
            assert "EqualTo(path," in pushed or "GreaterThan(suspect_until_us," in pushed
            assert "StartsWith" not in pushed
