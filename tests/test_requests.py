"""Composed tree requests and results that are found by id."""

import base64

import pytest
from pyspark.sql import functions as F

from arborlake import schemas as S
from arborlake.operators import arbitrate as A
from arborlake.operators import frozen as Z
from arborlake.operators import status as T
from arborlake.operators import tree_query as Q
from arborlake.operators import tree_request as B
from arborlake.operators.paging import PageBudgetError, PitExpired
from arborlake.plans.status_queries import statuses
from arborlake.sources.state_store import StateStore
from arborlake.storage import exists, fresh_path, materialize

SECRET, AT = b"secret", 10**9


@pytest.fixture(scope="module")
def evidence(spark, folder):
    source, sink, schedule, required = statuses(spark, folder)
    blocked = {r.group_id for r in T.uncovered_groups(source, sink, schedule, required).collect()}
    return B.Evidence(source, sink, schedule), sorted({r[0] for r in required.select("group_id").collect()} - blocked)


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.001"


def stored(spark, names):
    rows = []
    for i, g in enumerate(names):
        for path, is_dir in [("/", True), ("/d", True), *[(f"/d/f{k}", False) for k in range(3 + 2 * i)], ("/e", True), ("/e/x", True), ("/e/x/y", False)]:
            row = dict.fromkeys(S.STATE.fieldNames()) | dict(
                group_id=g, path=path, is_dir=is_dir, size=7, modified_time_us=5, created_time_us=5, source="Scan", monitoring_attested=True,
                blind_spot=False, is_tombstoned=path.endswith("f1"), last_seen_epoch=1)
            rows.append(row)
    store = StateStore(spark, fresh_path(spark, "requests"))
    groups = A.initial_groups(spark.createDataFrame([(g, "o") for g in names], "group_id string, primary_object_ref string"))
    store.write(spark.createDataFrame(rows, S.STATE), groups, None, 0)
    return store


def walk(store, page, scope="me"):
    pages = [page]
    while pages[-1].cursor:
        pages.append(B.next_page(store, pages[-1].cursor, scope, SECRET))
    return pages


def test_pages_give_every_entry_once(spark, evidence):
    store = stored(spark, ["a", "b", "c"])
    state, groups, _ = store.read()
    whole = {(r.group_id, r.path) for r in Q.tree(state, groups, "/", as_of_us=AT).entries.collect()}
    for request in (
        B.TreeRequest(group_order="file-count", group_page_size=2, entry_page_size=4, read_class="materialized"),
        B.TreeRequest(group_page_size=3, entry_page_size=5, limit_bytes=700, read_class="materialized"),
    ):
        pages = walk(store, B.open_request(store, request, evidence[0], "me", SECRET, AT))
        rows = [[(r["rank"], r.position, r.group_id, r.path) for r in p.entries.collect()] for p in pages]
        got = [r[2:] for page in rows for r in page]
        assert len(got) == len(set(got)) and set(got) == whole
        if request.limit_bytes:
            assert all((p.entries.select(F.sum(F.octet_length(F.to_json(F.struct(*p.entries.columns))) + 1)).first()[0] or 0) <= 700 for p in pages)
        else:
            assert [sorted({r[2] for r in page}) for page in rows][0] == ["b", "c"]  # the groups of most files first
            assert pages[0].heads.count() == 2 and pages[0].state == T.UNTRUSTED
    small = B.TreeRequest(limit_bytes=10, read_class="materialized")
    with pytest.raises(PageBudgetError):
        B.open_request(store, small, evidence[0], "me", SECRET, AT)


def test_trust_is_checked_before_any_row(spark, evidence, monkeypatch):
    facts, trusted = evidence
    assert trusted
    page = B.open_request(stored(spark, trusted[:1]), B.TreeRequest(), facts, "me", SECRET, AT)
    assert page.state == T.TRUSTED and page.entries.count()
    monkeypatch.setattr(Q, "tree", lambda *a, **k: pytest.fail("rows were read"))
    with pytest.raises(T.NotReady):
        B.open_request(stored(spark, ["unheard of"]), B.TreeRequest(), facts, "me", SECRET, AT)


def test_results_are_found_by_id_alone(spark, evidence):
    store = stored(spark, ["a", "b"])
    page = B.open_request(store, B.TreeRequest(group_page_size=1, read_class="materialized"), evidence[0], "me", SECRET, AT, ttl_ms=50, now_ms=1_000)
    # later versions do not show in a frozen result, and another session pages on
    state, groups, _ = store.read()
    state = materialize(state, "requests-state")
    store.write(state.where("path <> '/e'"), groups, None, 1)
    other = StateStore(spark.newSession(), store.folder)
    second = B.next_page(other, page.cursor, "me", SECRET, now_ms=1_049)
    assert {r.group_id for r in second.entries.collect()} == {"b"} and second.entries.where("path = '/e'").count() == 1
    with pytest.raises(Z.ForeignScope):
        B.next_page(store, page.cursor, "you", SECRET, now_ms=1_010)
    with pytest.raises(PitExpired):
        B.next_page(store, page.cursor, "me", SECRET, now_ms=1_050)
    for forged in (page.cursor[:-4] + "AAAA", "", "%%", base64.urlsafe_b64encode(b"x" * 60).decode(), Z.cursor_of({"id": page.id}, b"other")):
        with pytest.raises(Z.BadCursor):
            B.next_page(store, forged, "me", SECRET, now_ms=1_010)
    with pytest.raises(Z.UnknownResult):
        B.next_page(store, Z.cursor_of({"id": "0" * 32, "groups": 0, "entries": 0, "cut": None}, SECRET), "me", SECRET, now_ms=1_010)
    # versions that results read stay as long as these do
    for batch in (2, 3):
        store.write(state, groups, None, batch)
    assert store.prune(keep=1, held=Z.versions_in_use(spark, store.folder, now_ms=1_010)) == [1, 2]
    assert B.next_page(store, page.cursor, "me", SECRET, now_ms=1_010).entries.count() == second.entries.count()
    assert page.id not in Z.sweep(spark, now_ms=1_049)
    assert page.id in Z.sweep(spark, now_ms=1_050)
    assert store.prune(keep=1, held=Z.versions_in_use(spark, store.folder, now_ms=1_050)) == [0]
    assert store.read()[0].where("path = '/e'").count() == 2
    assert store.applied(1) and [v.number for v in store.versions()] == [0, 1, 2, 3]
    assert not exists(spark, Z._folder(spark, page.id)) and not exists(spark, f"{Z._registry(spark)}/{page.id}")
