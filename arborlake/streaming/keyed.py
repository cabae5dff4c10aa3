"""Streaming forms of the keyed state machines, on Spark's own state store."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from arborlake.operators.keyed import SENTINEL_SCHEMA, Drift, Sentinel, Throttle


class _Machine(StatefulProcessor):
    """Feeds rows of a key, in order inside a batch, to one machine kept as its state."""

    def __init__(self, make, keys, inputs, columns):
        self.make, self.keys, self.inputs, self.columns = make, keys, inputs, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("machine", T.StructType([T.StructField("blob", T.BinaryType())]))

    def handleInputRows(self, key, rows, timers):
        machine = pickle.loads(bytes(self.value.get()[0])) if self.value.exists() else self.make()
        frames = [f for f in rows]
        pdf = pd.concat(frames).sort_values(self.inputs[0]) if len(frames) > 1 else frames[0].sort_values(self.inputs[0])
        out = []
        for values in pdf[self.inputs].itertuples(index=False, name=None):
            clean = [None if v is None or v != v else v for v in values]
            out.extend((*key, *r) for r in machine.feed(*clean))
        self.value.update((pickle.dumps(machine),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _run(stream: DataFrame, keys: list[str], make, inputs: list[str], fields: list[T.StructField]) -> DataFrame:
    out = T.StructType([stream.schema[k] for k in keys] + fields)
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Machine(make, keys, inputs, out.fieldNames()), outputStructType=out, outputMode="Append", timeMode="None"
    )


def throttle_stream(stream: DataFrame, interval_us: int = 500_000) -> DataFrame:
    fields = [T.StructField("seq", T.LongType()), T.StructField("emitted", T.BooleanType())]
    return _run(stream, ["origin_id", "path"], lambda: Throttle(interval_us), ["seq", "kind", "arrival_us"], fields)


def sentinel_stream(stream: DataFrame, **limits) -> DataFrame:
    return _run(stream, ["root_key"], lambda: Sentinel(**limits), ["seq", "kind", "at_us", "amount", "detail"], list(SENTINEL_SCHEMA.fields))


def drift_stream(stream: DataFrame, **config) -> DataFrame:
    fields = [T.StructField("seq", T.LongType()), T.StructField("drift_us", T.LongType()), T.StructField("graduated", T.BooleanType())]
    return _run(stream, ["origin_id"], lambda: Drift(**config), ["seq", "realtime", "mtime_us", "local_us"], fields)
