"""Streaming ingestion: micro-batches of a routed log into versioned state.

A keyed state store cannot see a path's ancestors, so the fold runs in ``foreachBatch`` on the
latest state version. The batch id is part of the version's manifest row: a replayed batch is
recognised and skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from arborlake.operators import arbitrate as A
from arborlake.operators.path_fold import Policy
from arborlake.sources.state_store import StateStore
from arborlake.storage import scratch


def apply_batch(store: StateStore, primaries: DataFrame, policy: Policy = Policy()):
    """The ``foreachBatch`` function. Rows must carry ``seq`` values that grow from batch to batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if store.applied(batch_id) or batch.isEmpty():
            return
        current = store.read()
        if current is None:
            state, groups, skips = A.empty_state(batch.sparkSession), A.initial_groups(primaries), None
        else:
            state, groups, skips = current
        # the version is all that lasts of a batch
        with scratch(batch.sparkSession):
            result = A.apply_log(state, groups, batch, policy, skips)
            store.write(result.state, result.groups, result.skips, batch_id, changes=result.changes)

    return run


def start(log: DataFrame, store: StateStore, primaries: DataFrame, checkpoint: str, policy: Policy = Policy(), **trigger) -> StreamingQuery:
    """Start the query on a streaming log; ``trigger`` goes to ``DataStreamWriter.trigger``."""
    writer = log.writeStream.foreachBatch(apply_batch(store, primaries, policy)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
