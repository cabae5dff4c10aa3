"""Results that are found again by id: a registry with scope and expiry, and cursors that cannot be forged.

An entry of the registry is one small file, written before the result's own rows; so a result is never without an
entry, and ``sweep`` removes both when the time is over, also those of a caller that went away half-way.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
import uuid
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from arborlake.operators.paging import PitExpired
from arborlake.storage import exists, remove, work_dir


class UnknownResult(LookupError):
    """No result has this id."""


class ForeignScope(PermissionError):
    """The result belongs to another scope."""


class BadCursor(ValueError):
    """The cursor was not made here, or changed since."""


@dataclass(frozen=True)
class Frozen:
    id: str
    scope: str
    expires_at_ms: int
    about: dict[str, Any]  # what the result was asked with


def _now(now_ms: int | None) -> int:
    return int(time.time() * 1000) if now_ms is None else now_ms


def _registry(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/arborlake/results/registry"


def _folder(spark: SparkSession, result_id: str) -> str:
    return f"{work_dir(spark)}/arborlake/results/rows/{result_id}"


def freeze(rows: DataFrame, scope: str, about: dict[str, Any], ttl_ms: int = 60_000, now_ms: int | None = None) -> Frozen:
    """Write a result and register it."""
    spark = rows.sparkSession
    frozen = Frozen(uuid.uuid4().hex, scope, _now(now_ms) + ttl_ms, about)
    entry = spark.createDataFrame([(json.dumps(asdict(frozen)),)], "value string")
    entry.coalesce(1).write.mode("errorifexists").text(f"{_registry(spark)}/{frozen.id}")
    rows.write.mode("errorifexists").parquet(_folder(spark, frozen.id))
    return frozen


def find(spark: SparkSession, result_id: str, scope: str, now_ms: int | None = None) -> Frozen:
    """A result by its id alone, in any session that knows the shared folder."""
    path = f"{_registry(spark)}/{result_id}"
    if not result_id.isalnum() or not exists(spark, path) or not exists(spark, f"{_folder(spark, result_id)}/_SUCCESS"):
        raise UnknownResult(result_id)
    frozen = Frozen(**json.loads(spark.read.text(path).first().value))
    if frozen.scope != scope:
        raise ForeignScope(result_id)
    if _now(now_ms) >= frozen.expires_at_ms:
        raise PitExpired(result_id)
    return frozen


def rows_of(spark: SparkSession, frozen: Frozen) -> DataFrame:
    return spark.read.parquet(_folder(spark, frozen.id))


def _entries(spark: SparkSession) -> list[Frozen]:
    """The registry, one row for each result."""
    if not exists(spark, _registry(spark)):
        return []
    return [Frozen(**json.loads(r.value)) for r in spark.read.text(f"{_registry(spark)}/*").collect()]


def versions_in_use(spark: SparkSession, store: str, now_ms: int | None = None) -> set[int]:
    """Numbers of the versions of a state store that results read whose time is not over."""
    return {f.about["version"] for f in _entries(spark) if f.about.get("store") == store and _now(now_ms) < f.expires_at_ms}


def sweep(spark: SparkSession, now_ms: int | None = None) -> list[str]:
    """Remove results whose time is over, rows first; gives their ids."""
    over = sorted(f.id for f in _entries(spark) if _now(now_ms) >= f.expires_at_ms)
    for result_id in over:
        remove(spark, _folder(spark, result_id))
        remove(spark, f"{_registry(spark)}/{result_id}")
    return over


def _signature(body: bytes, secret: bytes) -> bytes:
    return hmac.new(secret, body, hashlib.sha256).digest()


def cursor_of(positions: dict[str, Any], secret: bytes) -> str:
    """A place in a result as signed text."""
    body = json.dumps(positions, sort_keys=True).encode()
    return base64.urlsafe_b64encode(_signature(body, secret) + body).decode()


def positions_of(cursor: str, secret: bytes) -> dict[str, Any]:
    try:
        raw = base64.b64decode(cursor.encode(), altchars=b"-_", validate=True)
    except ValueError as bad:
        raise BadCursor("no cursor") from bad
    signature, body = raw[:32], raw[32:]
    if not hmac.compare_digest(signature, _signature(body, secret)):
        raise BadCursor("signature")
    return json.loads(body)
