"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from arborlake.operators import arbitrate as A
from arborlake.operators import heads as H
from arborlake.operators import rollup as U
from arborlake.operators import tree_query as Q
from arborlake.plans import catalog
from arborlake.plans import fold_queries as FQ
from arborlake.plans import views as V
from arborlake.session import local_session
from arborlake.storage import materialize

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

PLAIN = [
    "fresh_find", "fresh_ranked_stats", "change_stamps", "shadow_clock", "epoch_tracking", "scan_tree", "audit_decisions", "match_roots",
    "route_events", "object_rows", "object_poll", "doc_poll", "stable_escape", "graph_nodes", "neighbors_of_collections", "drift_estimates",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, memory="16g")
    queries = catalog.queries()
    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.time()
        result = run()
        seconds[name] = round(time.time() - start, 3)
        return result

    def calibration():
        """The same work in every round, so that rounds can be told from machines."""
        rows = spark.range(20_000_000, numPartitions=16).selectExpr("id % 100003 AS k", "xxhash64(id) AS v")
        drain(rows.groupBy("k").agg({"v": "max"}).orderBy("k"))

    drain(V.table(spark, FOLDER, "events").groupBy("event_type").count())
    calibration()
    start = time.time()
    calibration()
    calibrated = round(time.time() - start, 3)

    log = V.stored(spark, FOLDER, "fold-log", V.fold_log)
    groups = A.initial_groups(V.primaries(V.base_log(spark, FOLDER)))
    rows = log.count()
    # the first fold pays for code generation and worker start, the second one is the figure
    A.apply_log(A.empty_state(spark), groups, log, FQ.POLICY)
    result = timed("fold", lambda: A.apply_log(A.empty_state(spark), groups, log, FQ.POLICY))

    state = result.state
    info = result.groups.select("group_id", "overflow_pending", "coverage_recovered_at_us")

    def page():
        found = Q.tree(state, info, "/", as_of_us=V.AS_OF_US, limit=20, only_groups=["g0"])
        found.entries.collect()
        found.heads.collect()

    page()
    timed("tree_first_page", page)
    timed("rollup_tree", lambda: drain(U.rollup_tree(state)))
    heads = timed("heads_build", lambda: materialize(H.build(state), "bench-heads"))
    timed("stored_subtree_stats", lambda: drain(H.subtree_stats(heads, state, "/u3")))
    timed("stored_health_stats", lambda: drain(H.health_stats(heads, state, V.AS_OF_US)))
    timed("subtree_stats", lambda: drain(U.subtree_stats(state, "/u3")))
    timed("health_stats", lambda: drain(U.health_stats(state, V.AS_OF_US)))
    for name in PLAIN:
        timed(name, lambda: drain(queries[name](spark, FOLDER)))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")), "fold_rows": rows, "fold_rows_per_sec": round(rows / seconds["fold"]),
        "state_rows": state.count(), "calibration_sec": calibrated,
    }))


if __name__ == "__main__":
    main()
