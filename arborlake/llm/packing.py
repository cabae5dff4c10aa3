"""Packing by concatenating and cutting.

The first pass encodes every document once, closes it with an end id, and writes the ids with their place
inside their partition. The partitions' token totals, one number each, are summed up to global offsets. The
second pass then knows the place of each document in the endless sequence of ids by itself, and cuts it where a
multiple of the window lies; a document across a boundary gives a record on each side. Only the last window
is padded.

Cases: a null text is empty and consists of the end id. Documents that repeat an id are documents like any
other; their order in the sequences is that of the input's partitions. Strings of added tokens in a text get the ids
that the file gives them. A long text is encoded in one run, and its pieces are cut one after the other. An empty table
gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.pretokens import Recent, chunks, splitter
from arborlake.llm.worker import keep
from arborlake.storage import fresh_path

#: Pre-tokens that a worker remembers in each generation, and the longest that it does.
CACHED, CACHED_CHARACTERS = 400_000, 48
#: Pieces in a batch of the result.
BATCH_PIECES = 5_000
NUMBERS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others for
    those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Tokens:
    """A `tokenizers` file, whose model is asked once for each new pre-token.

    Byte-level BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens in order. The file's
    added tokens are found before pre-tokens are; a text that holds one is encoded as a whole.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = "<" + self.code
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.split = splitter(pattern)
        self.known = Recent(CACHED)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        pieces, ends, whole = [], [0], {}
        for i, text in enumerate(texts):
            if text and any(a in text for a in self.added):
                whole[i] = self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                pieces += self.split(text or "")
            ends.append(len(pieces))
        found, missing = self.known.look_up(pieces)
        fresh: dict[str, bytes] = {}
        for i in missing:
            piece = pieces[i]
            if piece not in fresh:
                fresh[piece] = self._packed(self._ids(piece))
            found[i] = fresh[piece]
        self.known.remember((p, i) for p, i in fresh.items() if len(p) <= CACHED_CHARACTERS)
        return [whole[i] if i in whole else b"".join(found[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:]))]

    def _ids(self, piece: str) -> list[int]:
        """The ids of one pre-token; the model alone takes less than half the time of the file's whole way to them."""
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def _packed(self, ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}{self.code}", *ids)


def tokens(path: str, pattern: str) -> Tokens:
    return keep(Tokens, path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write doc_id, part, start (ids before it in its part), n_tokens, width (bytes of an id), ids (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, start = tokens(path, pattern), TaskContext.get().partitionId(), 0
        width = np.dtype(t.kind).itemsize
        end = np.array([end_id], t.kind).tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in chunks(texts):
                packed = [ids + end for ids in t.encode(texts[first:last])]
                counts = np.array([len(p) // width for p in packed], np.int64)
                starts = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                n = len(packed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array([part] * n, pa.int32()), pa.array(starts), pa.array(counts), pa.array([width] * n, pa.int32()), pa.array(packed, pa.binary())],
                    ["doc_id", "part", "start", "n_tokens", "width", "ids"],
                )

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    encoded = source.mapInArrow(run, f"doc_id {kind}, part int, start long, n_tokens long, width int, ids binary")
    folder = fresh_path(docs.sparkSession, "packing-ids")
    encoded.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(encoded.schema).parquet(folder)


def part_offsets(encoded: DataFrame) -> dict[int, int]:
    """Global offset of each part: prefix sums over one total for each partition of the first pass."""
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    ends = np.cumsum([row.n for row in totals]).tolist()
    return {row.part: end - row.n for row, end in zip(totals, ends)}


def pieces(
    docs: DataFrame, path: str, pattern: str, window: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, whether the document was
    cut before (`continues`) or after (`continued`) the piece, and its ids if they are wanted."""
    encoded = encode(docs, path, pattern, end_id, doc_id, text)
    offsets = docs.sparkSession.sparkContext.broadcast(part_offsets(encoded))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_id": None, **dict.fromkeys(NUMBERS, pa.int64()), "continues": pa.bool_(), "continued": pa.bool_()}
        if with_ids:
            kinds["ids"] = pa.list_(pa.int32())

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

        at = offsets.value
        for batch in batches:
            kinds["doc_id"] = batch.schema.field(0).type
            rows: list[tuple] = []
            for doc, part, start, n, width, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                place, done = at[part] + start, 0
                while done < n:
                    sequence, offset = divmod(place + done, window)
                    length = min(window - offset, n - done)
                    piece = ids[done : done + length]
                    row = (doc, done, length, zlib.crc32(piece.tobytes()), n, sequence, offset, done > 0, done + length < n)
                    rows.append((*row, piece.astype(np.int32)) if with_ids else row)
                    done += length
                    if len(rows) >= BATCH_PIECES:
                        yield packed(rows)
                        rows = []
            if rows:
                yield packed(rows)

    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, " + "".join(f"{n} long, " for n in NUMBERS) + "continues boolean, continued boolean"
    return encoded.select("doc_id", "part", "start", "n_tokens", "width", "ids").mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))


def summary(docs: DataFrame, path: str, pattern: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """The pieces without their ids."""
    return pieces(docs, path, pattern, window, end_id, with_ids=False)
