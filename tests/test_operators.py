import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from arborlake import schemas as S
from arborlake.operators import arbitrate as A
from arborlake.operators import graph as G
from arborlake.operators import paging
from arborlake.operators import rollup as U
from arborlake.operators import routing
from arborlake.operators import status as T
from arborlake.operators import tree_query as Q
from arborlake.operators.ordered import as_of, number_rows, running_max
from arborlake.sources import documents as D
from arborlake.sources import graph_adapters as GA
from arborlake.sources import listing as L
from arborlake.sources import objects as O
from arborlake.sources import relational as R
from arborlake.sources import watch_log


def state_rows(spark, rows):
    """(group, path, is_dir, size, mtime[, overrides])"""
    out = []
    for g, path, is_dir, size, mtime, *more in rows:
        row = dict.fromkeys(S.STATE.fieldNames())
        row.update(group_id=g, path=path, is_dir=is_dir, size=size, modified_time_us=mtime, created_time_us=mtime, source="Scan",
                   monitoring_attested=True, blind_spot=False, is_tombstoned=False, last_seen_epoch=1)
        row.update(more[0] if more else {})
        out.append(row)
    return spark.createDataFrame(out, S.STATE)


@pytest.fixture(scope="module")
def plain(spark):
    return state_rows(spark, [
        ("g", "/data", True, 0, 1_000_000), ("g", "/data/report.csv", False, 100, 2_000_000), ("g", "/data/archive", True, 0, 1_500_000),
        ("g", "/data/archive/old.log", False, 50, 1_500_000), ("h", "/tmp/job/nested", True, 0, 1_000_000), ("h", "/tmp/job/nested/child", True, 0, 1_100_000),
    ]).cache()


def groups_of(spark, overflow=False):
    return spark.createDataFrame([("g", overflow, None), ("h", overflow, None)], "group_id string, overflow_pending boolean, coverage_recovered_at_us long")


def by_group(df):
    return {r.group_id: r for r in df.collect()}


def test_stats_leave_out_the_root_and_rebased_groups_count_all(spark, plain):
    got = by_group(U.subtree_stats(plain, "/data"))
    assert (got["g"].total_nodes, got["g"].total_files, got["g"].total_dirs, got["g"].total_size) == (3, 2, 1, 150)
    assert got["h"].total_nodes == 0
    moved = by_group(U.subtree_stats(plain, "/nested"))
    assert moved["h"].total_dirs == 2 and moved["g"].total_nodes == 0


def test_queried_newest_file_takes_its_time_along(spark, plain):
    got = by_group(U.subtree_stats(plain, "/data/report.csv"))["g"]
    assert got.total_nodes == 0 and got.latest_file_mtime_us is None


def test_rollup_has_placeholders(spark, plain):
    got = {(r.group_id, r.dir): r for r in U.rollup_tree(plain).collect()}
    assert got[("h", "/tmp/job")].total_dirs == 2 and got[("g", "/")].total_size == 150 and got[("g", "/data/archive")].total_nodes == 2


def test_tree_direct_and_rebased(spark, plain):
    res = Q.tree(plain, groups_of(spark), "/nested", as_of_us=10**15)
    heads = by_group(res.heads)
    assert heads["h"]["mode"] == "rebased" and heads["h"].exists and heads["h"].has_children
    assert not heads["g"].exists
    assert [(r.path, r.depth, r.has_children) for r in res.entries.collect()] == [("/nested/child", 1, False)]


def test_placeholder_root_exists_and_page_is_preorder(spark, plain):
    res = Q.tree(plain, groups_of(spark), "/", as_of_us=10**15, limit=3, only_groups=["g"])
    rows = res.entries.orderBy("position").collect()
    assert [r.path for r in rows] == ["/data", "/data/archive", "/data/archive/old.log"]
    assert [r.has_children for r in rows] == [True, True, False]
    head = res.heads.first()
    assert head.exists and head.is_dir and head.reliable and head.stability_state == "unstable" and head.observed_quiet_for_ms is None


def test_page_only_sees_suspects_on_the_page(spark):
    state = state_rows(spark, [("g", "/a", False, 1, 1), ("g", "/b", False, 1, 1, dict(suspect_until_us=100))])
    one = lambda **k: by_group(Q.tree(state, groups_of(spark), "/", as_of_us=50, **k).heads)["g"]
    assert one(limit=1).reliable and one(limit=2).unreliable_reason == "SuspectNodes" and one().unreliable_reason == "SuspectNodes"


def test_reliability_order_and_overflow(spark):
    state = state_rows(spark, [("g", "/a", False, 1, 1, dict(monitoring_attested=False, subtree_changed_at_us=0))])
    head = lambda overflow: by_group(Q.tree(state, groups_of(spark, overflow), "/", as_of_us=60_000_000).heads)["g"]
    assert head(False).unreliable_reason == "Unattested" and head(False).stability_state == "unknown"
    assert head(True).unreliable_reason == "WatchOverflowPendingMaterialization"
    fresh = by_group(Q.tree(state, groups_of(spark), "/", as_of_us=1, read_class="fresh").heads)["g"]
    assert fresh.stability_state == "not-evaluated" and fresh.stability_mode == "none"


def test_quiet_window(spark):
    state = state_rows(spark, [("g", "/a", True, 0, 1, dict(subtree_changed_at_us=1_000_000)), ("g", "/a/b", False, 1, 1)])
    at = lambda us, q="/a": by_group(Q.tree(state, groups_of(spark), q, as_of_us=us).heads)["g"]
    assert at(6_000_000).stability_state == "stable" and at(5_999_000).remaining_ms == 1
    # the file has no time of its own, which is what counts for an existing node
    assert at(6_000_000, "/a/b").observed_quiet_for_ms is None


def test_fresh_ties(spark):
    log = spark.createDataFrame([
        ("o", "/a", 1, 10, False, "Update", 0), ("o", "/a", 2, 10, False, "Update", 1), ("o", "/b", 1, 10, False, "Update", 2),
        ("o", "/b", 1, 10, False, "Delete", 3), ("o", "/c", 1, 10, False, "Delete", 4), ("o", "/c", 5, 11, False, "Update", 5),
        ("o", "/d", 1, 10, False, "Delete", 6), ("o", "/d", 1, 10, False, "Update", 7),
    ], "origin_id string, path string, size long, mtime_us long, is_dir boolean, event_kind string, seq long")
    got = {r.path: r["size"] for r in Q.fresh_find(log).collect()}
    assert got == {"/a": 1, "/c": 5}


def test_as_of_over_bucket_borders(spark):
    events = spark.createDataFrame([("k", s, s * 10) for s in (0, 3, 7, 40)], "k string, seq long, v long")
    probes = spark.createDataFrame([("k", s) for s in (0, 1, 3, 8, 39, 41)] + [("z", 5)], "k string, seq long")
    back = {(r.k, r.seq): r.e for r in as_of(probes, events, ["k"], "seq", ["v"], "e", width=4).collect()}
    assert [back[("k", s)] and back[("k", s)].v for s in (0, 1, 3, 8, 39, 41)] == [None, 0, 0, 70, 70, 400] and back[("z", 5)] is None
    ahead = {r.seq: r.e for r in as_of(probes.where("k = 'k'"), events, ["k"], "seq", ["v"], "e", forward=True, width=4).collect()}
    assert [ahead[s] and ahead[s].v for s in (0, 1, 3, 8, 39, 41)] == [30, 30, 70, 400, 400, None]


def test_running_max_and_numbers_over_buckets(spark):
    rows = [("k", i, (i * 37) % 101) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = [r.m for r in running_max(df, ["k"], "seq", "v", "m", width=16).orderBy("seq").collect()]
    assert got == [max(v for _, _, v in rows[: i + 1]) for i in range(200)]
    numbered = number_rows(df.withColumn("o", F.col("v") * 1000 + F.col("seq")), ["k"], "o", "n").orderBy("o").collect()
    assert [r.n for r in numbered] == list(range(1, 201))


def test_pages(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", f"/{i:03d}", i) for i in range(90)], "g string, path string, v long")
    top = paging.top_per_group(df, ["g"], [F.col("path")], 5, 2)
    assert [r.path for r in top.where("g = 'b'").orderBy("position").collect()] == ["/006", "/009", "/012", "/015", "/018"]
    page = paging.keyset_page(df, ["v", "path"], 40, None)
    assert page.has_more and page.next_cursor == (39, "/039")
    rest = paging.keyset_page(df, ["v", "path"], 60, page.next_cursor)
    assert not rest.has_more and rest.rows.count() == 50
    with pytest.raises(paging.PageBudgetError):
        paging.require_fit(paging.byte_budget_page(top, ["g"], "position", 10))
    pit = paging.open_pit(df, ttl_ms=10, now_ms=100)
    assert paging.read_pit(spark, pit, now_ms=109).count() == 90
    with pytest.raises(paging.PitExpired):
        paging.read_pit(spark, pit, now_ms=110)


def test_trusted_reads_refuse_partial_results(spark, plain):
    failed = spark.createDataFrame([("h", "undecodable")], "group_id string, message string")
    rows = Q.stats(plain, "/", failed)
    assert {r.group_id: (r.status, r.total_nodes) for r in rows.collect()} == {"g": ("ok", 4), "h": ("error", None)}
    with pytest.raises(Q.PartialResultError):
        Q.require_complete(rows)


def test_trust_gate(spark):
    logical = spark.createDataFrame([("g", "ready", 1, 1)], "root_id string, status string, matched_grants long, active_members long")
    concrete = spark.createDataFrame(
        [("g", True, True, True, "ready", "full", False, 10, 20, None, *[0] * 6, None, None)],
        "logical_root_id string, active boolean, is_group_primary boolean, scan_enabled boolean, status string, coverage_mode string, rescan_pending boolean,"
        "last_audit_started_at_us long, last_audit_completed_at_us long, last_rescan_requested_at_us long, forwarded_batch_count long, forwarded_event_count long,"
        "forwarded_path_event_count long, emitted_batch_count long, emitted_event_count long, emitted_path_event_count long, last_forwarded_at_us long, last_emitted_at_us long")
    sink = lambda overflow: spark.createDataFrame(
        [("g", "o::1", 3, 3, T.READY, overflow)], "group_id string, primary_object_ref string, live_nodes long, total_nodes long, readiness string, overflow_pending boolean")
    groups = spark.createDataFrame([("g",)], "group_id string")
    source = T.SourceStatus(logical, concrete, spark.createDataFrame([], "root_id string"))
    gate = lambda read, overflow: T.trust_gate(read, source, sink(overflow), groups, groups)
    assert gate("trusted-materialized", False) == "trusted-materialized" and gate("fresh", True) == "fresh-only"
    assert gate("materialized", True) == "materialized-untrusted"
    with pytest.raises(T.NotReady):
        gate("trusted-materialized", True)


def test_generated_root_ids_avoid_given_ones(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a-2"), (3, "a"), (4, "a"), (5, "--"), (6, "/a")], "n int, raw string")
    got = [r.id for r in routing.normalize_root_ids(rows, "raw", "n").orderBy("n").collect()]
    assert got == ["a", "a-2", "a-3", "a-4", "root", "a-5"]


def test_pages_of_objects_and_tables_add_up_to_the_whole(spark):
    rows = [(f"b{i % 2}", f"k/{i % 7}-{i}" if i % 5 else f"x{i}", i, 1000 * (i % 4)) for i in range(60)]
    objects = spark.createDataFrame(rows, "bucket string, key string, size long, last_modified_unix_ms long")
    for read, whole in (
        (lambda c: O.object_snapshot(objects, "b1", "k/", 7, c), O.object_snapshot_all(objects, "b1", "k/")),
        (lambda c: O.object_poll(objects, "b0", "", 9, c or (1000, "k/3")), O.object_poll_all(objects, (1000, "k/3"), "b0")),
    ):
        page, got = read(None), []
        while True:
            got += [tuple(r) for r in page.rows.collect()]
            if not page.has_more:
                break
            page = read(page.next_cursor)
        assert sorted(got) == sorted(tuple(r) for r in whole.collect()) and len(got) > 9
    frozen = R.freeze_table(objects, ["last_modified_unix_ms", "key"])
    offset, got = 0, []
    while offset is not None:
        page = R.table_snapshot(frozen, 25, offset)
        got += [tuple(r) for r in page.rows.collect()]
        offset = page.next_offset
    assert sorted(got) == sorted(tuple(r) for r in R.table_snapshot_all(objects, ["last_modified_unix_ms", "key"]).collect())


def test_strict_routing_fails(spark):
    log = spark.createDataFrame([("x", 1)], "origin_id string, seq long")
    routes = spark.createDataFrame([("y", "g")], "object_ref string, group_id string")
    prim = spark.createDataFrame([("g", "y")], "root_id string, primary_object_ref string")
    good, lost = routing.route_events(log, routes, prim)
    assert good.count() == 0 and lost.count() == 1
    with pytest.raises(routing.UnroutedEvents):
        routing.route_events(log, routes, prim, strict=True)


def test_log_checks(spark):
    row = dict.fromkeys(S.LOG.fieldNames())
    row.update(group_id="g", seq=1, rec_type="data", path="/a/b", parent_path="/x")
    log = spark.createDataFrame([row, {**row, "parent_path": "/a"}, {**row, "parent_path": ""}], S.LOG)
    good, bad = A.split_malformed(log)
    assert good.count() == 2 and bad.first().parent_path == "/x"
    with pytest.raises(A.LogError):
        A.check_log(log)


def test_targeted_scan_limits(spark):
    files = spark.createDataFrame([("g", f"/a/b/{i}", False, 1, 1) for i in range(5)], "group_id string, path string, is_dir boolean, size long, mtime_us long")
    rows = L.with_directories(files)
    assert L.scan_targeted(rows, "/a", recursive=False).count() == 1
    assert L.scan_targeted(rows, "/a", max_depth=0).count() == 1 and L.scan_targeted(rows, "/a", max_depth=1).count() == 7
    assert L.scan_targeted(rows, "/missing").count() == 0
    with pytest.raises(L.ScanLimitExceeded):
        L.scan_targeted(rows, "/", max_events=4)
    with pytest.raises(L.ScanRootMissing):
        L.scan_targeted(rows.where("path <> '/'"), "/")


def test_read_tree(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "f.txt").write_text("12345")
    got = {r.path: (r.is_dir, r["size"]) for r in L.read_tree(spark, str(tmp_path), "g").collect()}
    assert got == {"/": (True, 0), "/d": (True, 0), "/d/e": (True, 0), "/d/e/f.txt": (False, 5)}


def test_throttled_modifies_are_not_classified(spark):
    raw = spark.createDataFrame([("o", 1, "/a", 2, 1, 1, 1), ("o", 2, "/a", 2, 1, 1, 1)],
                                "origin_id string, seq long, path string, mask long, size long, mtime_us long, ctime_us long")
    emitted = spark.createDataFrame([("o", "/a", 1, True), ("o", "/a", 2, False)], "origin_id string, path string, seq long, emitted boolean")
    assert [r.seq for r in watch_log.classify_watch(raw, emitted).collect()] == [1]


def test_rows_to_json(spark):
    df = spark.createDataFrame([(1, float("inf"), None, datetime(2024, 1, 2, 3, 4, 5, 6))], "id long, x double, t string, at timestamp")
    assert R.row_to_json(df).first()[0] == '{"id":1,"x":null,"t":null,"at":"2024-01-02T03:04:05.000006Z"}'


def test_graph_rules(spark):
    node = lambda i, name, o=0: ("fs", "i", i, "asset", "r", name, "p", None, 5, None, o)
    nodes = spark.createDataFrame([node("a", "old", 0), node("a", "new", 1), node("b", "b")], G.SOURCE_NODE)
    edge = spark.createDataFrame([("fs", "i", "a", "b", "contains", " ", "observed", 1, None, 0)], G.SOURCE_EDGE)
    graph, ack = G.ingest(G.empty_graph(spark), G.skeleton(spark, nodes, edge))
    assert {r["table"]: r.upserted for r in ack.collect()} == {"nodes": 2, "edges": 1, "evidence": 3}
    assert G.get_node(graph, "fs:i:a").first().display_name == "new"
    # derived evidence keeps the first row of an id
    assert graph.evidence.where("evidence_id = 'evidence:node:fs~3ai~3aa'").count() == 1
    assert G.neighbors(graph, "fs:i:b", "incoming").count() == 1 and G.neighbors(graph, "fs:i:b", "outgoing").count() == 0
    again, ack = G.ingest(graph, G.skeleton(spark, nodes))
    assert {r.upserted for r in ack.collect()} == {0} and again.nodes.count() == 2
    bad = spark.createDataFrame([("fs", "i", "a", "gone", "contains", "", "observed", 1, None, 0)], G.SOURCE_EDGE)
    with pytest.raises(G.DanglingEdges):
        G.ingest(graph, G.skeleton(spark, edges=bad))


def test_union_keeps_the_order_of_its_parts(spark):
    """The same id from three skeletons: the last one wins, whatever the places inside each."""
    one = lambda name, at: G.skeleton(spark, spark.createDataFrame([("fs", "i", "x", name, at)], "source_kind string, source_instance string, local_id string, display_name string, ord long"))
    whole = one("first", 9).union(one("second", 5)).union(one("third", 0))
    graph, _ = G.ingest(G.empty_graph(spark), whole)
    assert [r.display_name for r in graph.nodes.collect()] == ["third"]
    graph, _ = G.ingest(G.empty_graph(spark), one("first", 9).union(one("second", 5).union(one("third", 0))))
    assert [r.display_name for r in graph.nodes.collect()] == ["third"]
    # derived evidence keeps the first
    assert graph.evidence.count() == 1


def test_document_pages_reach_the_end(spark):
    """Times missing, one id in two indexes, numbers that sort otherwise as text."""
    rows = [("a", "1", 10), ("b", "1", 10), ("a", "2", None), ("a", "3", None), ("b", "2", None), ("a", "4", 5), ("a", "5", 5)]
    hits = spark.createDataFrame([(i, d, '{"t":%s}' % ("null" if t is None else t)) for i, d, t in rows], "index string, id string, source string")
    docs = D.document_rows(hits, "t", timestamp_type="long")
    for limit in (1, 2, 3, 7, 50):
        got = [(r["index"], r.id, r.timestamp_value) for r in paging.all_pages(lambda c: D.doc_snapshot(docs, limit=limit, cursor=c)).collect()]
        assert got == sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0], r[1]))
        polled = paging.all_pages(lambda c: D.doc_poll(docs, start=6, limit=limit, cursor=c)).collect()
        assert [(r["index"], r.id) for r in polled] == [("a", "1"), ("b", "1")]
    assert D.doc_snapshot(docs, index="b").rows.count() == 2


def test_projection_keeps_values(spark):
    source = '{"a":1,"b":{"c":[1,{"d":null}],"e":"x"},"s":"q\\"t","n":null,"t":true,"f":1.5}'
    rows = spark.createDataFrame([(source,), ("{}",), (None,), ("[1]",)], "source string")
    cut = lambda *fields: [r.source for r in D.project_source(rows, list(fields)).collect()]
    assert [json.loads(x) if x else x for x in cut("a", "b.c", "s", "n", "t", "f", "no.such")] == [
        {"a": 1, "b": {"c": [1, {"d": None}]}, "s": 'q"t', "n": None, "t": True, "f": 1.5}, {}, None, {}]
    assert json.loads(cut("b")[0]) == {"b": {"c": [1, {"d": None}], "e": "x"}}
    assert cut()[0] == source


def test_worst_reason_of_responses(spark):
    worst = lambda *codes: tuple(Q.merge_reliability(spark.createDataFrame([(c,) for c in codes], "reason_code int")).first())
    assert worst(None, 0, 2, 1) == (False, "BlindSpotsDetected") and worst(None) == (True, None) and worst() == (True, None)


def test_only_a_boolean_says_that_a_schema_exists(spark):
    body = lambda v: '{"Schema":{"Exists":%s}}' % v
    rows = spark.createDataFrame([(str(i), "p", body(v)) for i, v in enumerate(["true", "false", '"true"', "1", "null"])], "local_id string, pointer string, body string")
    nodes = GA.status_document_skeleton(rows, doc_instance="d", target=("pg", "i", "x")).nodes
    got = {r.local_id: r.fingerprint.split(";")[1] for r in nodes.collect()}
    assert got == {"0": "schema_exists=true", "1": "schema_exists=false", **{k: "schema_exists=unknown" for k in "234"}}


def test_scan_limit_is_per_group(spark):
    rows = spark.createDataFrame([(g, f"/f{i}", False, 1, 1) for g in "ab" for i in range(3)], "group_id string, path string, is_dir boolean, size long, mtime_us long")
    assert L.scan_targeted(rows, "/f0", max_events=1).count() == 2  # one in each group


def test_upserts_deal_rows_out_before_they_sort_them(spark, monkeypatch):
    """Many small tasks and one hot id give the rows that one task gives; content decides between rows of one place."""
    nodes = [("fs", "i", f"n{i}", "asset", f"name{j}", j % 3) for i in range(30) for j in range(4)]
    nodes += [("fs", "i", "hot", "asset", f"name{j}", 7) for j in range(90)]
    rows = spark.createDataFrame(nodes, "source_kind string, source_instance string, local_id string, node_kind string, display_name string, ord long")
    whole = G.upsert_nodes(G.empty_graph(spark).nodes, G.skeleton(spark, rows).nodes)
    want = {r.gid: r.display_name for r in whole.collect()}
    assert want == {"fs:i:hot": "name9"} | {f"fs:i:n{i}": "name2" for i in range(30)}
    monkeypatch.setattr(G, "TASK_ROWS", 10)
    dealt = G.upsert_nodes(G.empty_graph(spark).nodes, G.skeleton(spark, rows).nodes)
    assert {r.gid: r.display_name for r in dealt.collect()} == want and dealt.count() == 31
    # the input's splits do not decide how many rows a task sorts
    assert dealt.rdd.getNumPartitions() == len(nodes) // 10 + 1
    G.ingest(G.empty_graph(spark), G.skeleton(spark, rows, spark.createDataFrame([("fs", "i", "hot", f"n{i}", "contains") for i in range(30)], "source_kind string, source_instance string, from_local_id string, to_local_id string, edge_kind string")))
