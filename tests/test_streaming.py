import glob
import random

from arborlake import schemas as S
from arborlake.operators import keyed as K
from arborlake.operators import rollup as U
from arborlake.sources.state_store import StateStore
from arborlake.storage import work_dir
from arborlake.streaming import ingest
from arborlake.streaming import keyed as SK

from . import sequential as Q
from .test_arbitrate import POLICY, collect_state, random_log


def test_stream_equals_the_sequential_fold(spark, tmp_path):
    rows = random_log(random.Random(11), 120)
    src = str(tmp_path / "log")
    for part in (rows[:70], rows[70:]):
        spark.createDataFrame(part, S.LOG).coalesce(1).write.mode("append").parquet(src)
    primaries = spark.createDataFrame([("g0", "h0::g0"), ("g1", "h0::g1")], "group_id string, primary_object_ref string")
    store = StateStore(spark, str(tmp_path / "state"))
    stream = spark.readStream.schema(S.LOG).option("maxFilesPerTrigger", 1).parquet(src)
    stages = lambda: set(glob.glob(f"{work_dir(spark).removeprefix('file://')}/arborlake/*"))
    held = stages()
    query = ingest.start(stream, store, primaries, str(tmp_path / "chk"), POLICY, availableNow=True)
    query.awaitTermination()
    assert stages() == held
    want, _, _ = Q.fold(rows, {"g0": "h0::g0", "g1": "h0::g1"}, 2_000_000, 600_000, 1_500_000)
    assert collect_state(store.read()[0]) == want
    # the stored aggregates were moved on from batch to batch
    names = store.rollup().columns
    assert sorted(map(tuple, store.rollup().collect()), key=str) == sorted(map(tuple, U.rollup_tree(store.read()[0]).select(*names).collect()), key=str)
    # a batch that is delivered again leaves the versions as they are
    before = store.latest()
    ingest.apply_batch(store, primaries, POLICY)(spark.createDataFrame(rows[70:], S.LOG), before.batch_id)
    assert store.latest() == before


def test_keyed_streams_equal_the_batch_form(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(3)
    kinds = ["modify", "modify", "close_write"]
    rows = [("o", f"/{rng.randint(0, 2)}", i, rng.choice(kinds), i * 200_000) for i in range(60)]
    schema = "origin_id string, path string, seq long, kind string, arrival_us long"
    src = str(tmp_path / "events")
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = SK.throttle_stream(stream).writeStream.format("memory").queryName("throttled").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "chk")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.path, r.seq): r.emitted for r in spark.table("throttled").collect()}
    want = {(r.path, r.seq): r.emitted for r in K.throttle_modifies(spark.createDataFrame(rows, schema)).collect()}
    assert got == want
