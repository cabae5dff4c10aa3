"""State versions: every batch writes a new Parquet version and one manifest row."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from arborlake import schemas as S
from arborlake.functions import paths as P
from arborlake.operators import heads as H
from arborlake.operators import rollup as U
from arborlake.skew import lookup_join
from arborlake.storage import exists, remove


@dataclass(frozen=True)
class Version:
    number: int
    batch_id: int
    path: str


class StateStore:
    """Versions below one folder of shared storage.

    A version becomes visible with its manifest row, which is written last; a batch that was
    already recorded is not applied again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _manifest(self) -> str:
        return f"{self.folder}/manifest"

    def versions(self) -> list[Version]:
        """One row per version, so the list is short."""
        if not exists(self.spark, self._manifest()):
            return []
        rows = self.spark.read.schema("number long, batch_id long, path string").json(self._manifest()).collect()
        return sorted((Version(r.number, r.batch_id, r.path) for r in rows), key=lambda v: v.number)

    def latest(self) -> Version | None:
        found = self.versions()
        return found[-1] if found else None

    def applied(self, batch_id: int) -> bool:
        return any(v.batch_id == batch_id for v in self.versions())

    def write(
        self, state: DataFrame, groups: DataFrame, skips: DataFrame | None, batch_id: int, in_scope: DataFrame | None = None,
        changes: tuple[DataFrame, DataFrame] | None = None,
    ) -> Version:
        """``in_scope`` (group_id) leaves out groups that are no longer wanted. ``changes`` are the rows of the version before
        that the batch replaced or removed, and the rows that it wrote, as the fold gives them; without them two whole
        states are compared."""
        last = self.latest()
        number = 0 if last is None else last.number + 1
        path = f"{self.folder}/version-{number:06d}-{int(time.time() * 1000)}"
        if in_scope is not None:
            state = lookup_join(state, in_scope.select("group_id").distinct(), ["group_id"], "left_semi", salt_from=["path"])
            groups = groups.join(in_scope.select("group_id").distinct(), "group_id", "left_semi")
        # sorted by pre-order inside a group, so subtree reads skip most row groups
        # the aggregates of the version before are moved on by what differs
        before = self.read()
        if before is None:
            heads = H.build(state)
        else:
            stored, rows = self.heads(), changes or U.changed_rows(before[0], state)
            if in_scope is not None:
                wanted = in_scope.select("group_id").distinct()
                stored, *rows = (df.join(wanted, "group_id", "left_semi") for df in (stored, *rows))
            heads = H.refresh(stored, *rows, state)
        # dir and group order, so that one directory's row is one row group
        heads.repartitionByRange("dir", "group_id").sortWithinPartitions("dir", "group_id").write.parquet(f"{path}/heads")
        laid = state.withColumn("_k", P.preorder_key("path")).repartitionByRange("group_id", "_k")
        laid.sortWithinPartitions("group_id", "_k").drop("_k").write.parquet(f"{path}/state")
        groups.write.parquet(f"{path}/groups")
        marks = skips if skips is not None else self.spark.createDataFrame([], "group_id string, dir string")
        marks.write.parquet(f"{path}/skips")
        row = json.dumps({"number": number, "batch_id": batch_id, "path": path})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(self._manifest())
        return Version(number, batch_id, path)

    def prune(self, keep: int = 2, held: Iterable[int] = ()) -> list[int]:
        """Remove the rows of all versions but the newest ``keep`` and those ``held`` (``frozen.versions_in_use``); gives the
        numbers of those removed. The manifest stays, so a batch that was applied is still known as such."""
        if keep < 1:
            raise ValueError("the newest version stays")
        held = set(held)
        gone = [v for v in self.versions()[:-keep] if v.number not in held and exists(self.spark, v.path)]
        for version in gone:
            remove(self.spark, version.path)
        return [v.number for v in gone]

    def heads(self, version: Version | None = None) -> DataFrame | None:
        """Heads of directories of a version, as ``heads.build`` gives them."""
        version = version or self.latest()
        return None if version is None else self.spark.read.schema(H.HEADS).parquet(f"{version.path}/heads")

    def rollup(self, version: Version | None = None) -> DataFrame | None:
        """Directory aggregates of a version, as ``rollup_tree`` gives them."""
        heads = self.heads(version)
        return None if heads is None else H.rollup(heads)

    def read(self, version: Version | None = None) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        version = version or self.latest()
        if version is None:
            return None
        state = self.spark.read.schema(S.STATE).parquet(f"{version.path}/state")
        groups = self.spark.read.schema(S.GROUPS).parquet(f"{version.path}/groups")
        skips = self.spark.read.schema("group_id string, dir string").parquet(f"{version.path}/skips")
        return state, groups, skips
