from pyspark.sql import functions as F

from arborlake.functions import ids
from arborlake.functions import paths as P
from arborlake.functions import predicates as B

import pytest


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_parent_and_name(spark):
    paths = ["/", "", "/a", "/a/b", "a", "/a/", "a/b"]
    got = column(spark, paths, P.parent_path("p"), P.file_name("p"))
    assert got == [(None, "/"), (None, "/"), ("/", "a"), ("/a", "b"), (None, "a"), ("/a", "a"), ("a", "b")]


def test_under_and_rebase(spark):
    paths = ["/a", "/a/x", "/a-b", "/m/a/x", "/m/ab", "/a/a/y"]
    got = column(spark, paths, P.is_under("p", "/a"), P.rebase("p", "/a"), P.rebase("p", "a"), P.is_under("p", "/"))
    assert [r[0] for r in got] == [True, True, False, False, False, True]
    assert [r[1] for r in got] == ["/a", "/a/x", None, "/a/x", None, "/a/a/y"]
    assert {r[2] for r in got} == {None} and {r[3] for r in got} == {True}


def test_depth(spark):
    got = column(spark, ["/", "/a", "/a/b/c", "/ab", "b"], P.relative_depth("p", "/"), P.relative_depth("p", "/a"))
    assert got == [(0, None), (1, 0), (3, 2), (1, None), (None, None)]


def test_ancestors(spark):
    got = column(spark, ["/", "/a", "/a/b/c", "x", ""], P.ancestors("p"), P.self_and_ancestors("p"))
    assert [r[0] for r in got] == [[], ["/"], ["/", "/a", "/a/b"], [], []]
    assert got[2][1] == ["/", "/a", "/a/b", "/a/b/c"]


def test_two_orders(spark):
    df = spark.createDataFrame([("/a-b",), ("/a/x",), ("/a",), ("/",)], "p string")
    assert [r.p for r in df.orderBy(P.preorder_key("p")).collect()] == ["/", "/a", "/a/x", "/a-b"]
    assert [r.p for r in df.orderBy("p").collect()] == ["/", "/a", "/a-b", "/a/x"]


def test_bytes_survive(spark):
    raw = bytearray(b"/bad/\xffname")
    df = spark.createDataFrame([(raw,), (bytearray("/é".encode()),)], "raw binary").withColumn("p", P.to_byte_text("raw"))
    rows = df.select(P.to_bytes("p").alias("b"), P.display_path("p").alias("d"), P.path_b64("p").alias("e"), P.parent_path("p").alias("q")).collect()
    assert bytes(rows[0].b) == bytes(raw) and rows[0].e == "L2JhZC__bmFtZQ" and rows[0].q == "/bad" and "�" in rows[0].d
    assert rows[1].d == "/é" and rows[1].e is None


def test_make_relative(spark):
    got = column(spark, ["/r", "/r/a", "/x"], P.make_relative("p", "/r"), P.make_relative("p", "/r", "/pre"))
    assert got == [("/", "/pre"), ("/a", "/pre/a"), ("/x", "/pre/x")]


def test_escape_and_ids(spark):
    values = ["a b/é", "plain-1_2.x", "", "~:/", "tab\there"]
    got = column(spark, values, ids.stable_escape("p"), ids.graph_gid(F.lit("s3"), F.lit("i/1"), "p"))
    assert [r[0] for r in got] == ["a~20b~2f~c3~a9", "plain-1_2.x", "", "~7e~3a~2f", "tab~09here"]
    assert got[1][1] == "s3:i~2f1:plain-1_2.x"


def test_scopes_and_limits(spark):
    scopes = F.array(F.lit("b*z"), F.lit("exact"))
    got = column(spark, ["bz", "baz", "bay", "exact", "exactly"], B.scope_match("p", scopes), B.scope_match("p", F.array(F.lit("*"))))
    assert [r[0] for r in got] == [True, True, False, True, False] and all(r[1] for r in got)
    assert [B.effective_limit(*a) for a in [(None, 100, 1000), (0, 100, 1000), (5000, 100, 1000), (7, 100, 0)]] == [100, 1, 1000, 1]


def test_parameters():
    B.check_tree_parameters(path="/", group_page_size=1000, entry_page_size=10000)
    for bad in (dict(path="/", path_b64="Lw"), dict(group_page_size=0), dict(entry_page_size=10001), dict(group_order="size"),
                dict(read_class="live"), dict(max_depth=-1)):
        with pytest.raises(B.QueryParameterError):
            B.check_tree_parameters(**bad)
    B.check_stats_parameters(read_class="materialized")
    for bad in (dict(read_class="fresh"), dict(entry_page_size=5), dict(max_depth=1)):
        with pytest.raises(B.QueryParameterError):
            B.check_stats_parameters(**bad)
