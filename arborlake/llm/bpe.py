"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every neighbouring pair that is itself a token waits in the bucket of
its rank, by position. Two levels of bitmaps say which buckets hold anything: find-first-set on the upper
and then on the lower level gives the lowest rank, and the bucket gives its leftmost position. A position whose
pair has changed since is stale and is skipped. Each merge costs a constant number of queue operations, so very
long pre-tokens take time in proportion to their length.

Cases: a null text is empty and has no ids. Ids that are not in the vocabulary raise ``KeyError`` in ``decode``.
Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.pretokens import Recent, splitter

#: Ranks under one word of the lower bitmap.
WORD = 256
#: Pre-tokens that a worker remembers in each generation, and the longest that it does.
CACHED, CACHED_CHARACTERS = 400_000, 48


def encode_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if not n:
        return []
    get = ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair: list[int | None] = [get(piece[i : i + 2]) for i in range(n - 1)]
    pair.append(None)
    buckets: dict[int, list[int]] = {}
    lower: dict[int, int] = {}
    upper = 0
    for i, rank in enumerate(pair):
        if rank is None:
            continue
        if rank in buckets:
            buckets[rank].append(i)  # ascending positions are a heap
            continue
        buckets[rank] = [i]
        word = rank // WORD
        lower[word] = lower.get(word, 0) | 1 << rank % WORD
        upper |= 1 << word
    while upper:
        word = (upper & -upper).bit_length() - 1
        bits = lower[word]
        rank = word * WORD + (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            bits &= bits - 1
            lower[word] = bits
            if not bits:
                upper ^= 1 << word
        if pair[i] != rank:
            continue
        gone = after[i]
        end = after[gone]
        after[i] = end
        pair[gone] = None
        changed = []
        if end < n:
            before[end] = i
            pair[i] = new = get(piece[i : after[end]])
            if new is not None:
                changed.append((new, i))
        else:
            pair[i] = None
        left = before[i]
        if left >= 0:
            pair[left] = new = get(piece[left:end])
            if new is not None:
                changed.append((new, left))
        for new, at in changed:
            if new in buckets:
                heappush(buckets[new], at)
            else:
                buckets[new] = [at]
                word = new // WORD
                lower[word] = lower.get(word, 0) | 1 << new % WORD
                upper |= 1 << word
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encoder and decoder for a file of ranks; ids are handed around as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = splitter(pattern)
        self.known = Recent(CACHED)

    def encode(self, text: str) -> bytes:
        pieces = self.split(text)
        found, missing = self.known.look_up(pieces)
        if missing:
            fresh: dict[str, bytes] = {}
            for i in missing:
                piece = pieces[i]
                if piece not in fresh:
                    ids = encode_bytes(piece.encode("utf-8", "surrogatepass"), self.ranks)
                    fresh[piece] = pack(f"<{len(ids)}I", *ids)
                found[i] = fresh[piece]
            self.known.remember((p, i) for p, i in fresh.items() if len(p) <= CACHED_CHARACTERS)
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process; it stays there from task to task."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(c.encode(t or ""), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, bytes (binary) of every list of ids; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            out = [c.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    source = rows.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text and decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for value in batch.column(1):
                ids = c.encode(value.as_py() or "")
                counts.append(len(ids) // 4)
                encoded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
