"""Removal of repeated byte strings with suffix arrays.

Every byte that lies in a string of ``length`` bytes that also begins earlier (in a smaller doc_id, or before in the
same document) is removed. Strings are judged on the input; matches never cross documents.

The strings are dealt so that equal ones meet: each belongs to the least ``GRAM``-gram in it (by hash, the leftmost
of equals). The neighbouring strings of one gram that have it in their first half, and those that have it in their
second, form a *segment* each, of some 120 bytes; its *key* is the hash of the bytes that all strings of that
half have in common, 62 or 63 of 100. Segments
travel first as numbers only: those whose key stands nowhere else are done with, of equal segments all but
the first repeat wholly. Only segments that share a key and differ are fetched. Ends of them go where the bytes
around (``length - STEP + 1`` of them, at the same place from the gram) stand in no other; shards of what is left are sorted by
induced sorting, and permuted common prefixes show the equal strings (``suffix_array``).

A key that stands in very many different segments would bring them all into one shard. Where a round of
documents holds more than ``CROWD`` of them, or all documents more than ``CROWDED``, the key's strings travel one
by one, under their own hashes, and equal ones are combined before the shuffle. They meet in shards of the same kind.

Cases: null and empty texts have nothing removed, nor have texts shorter than ``length``. A null doc_id is smaller
than any other. Rows that repeat doc_id and text count as one document and get the same result; rows that repeat a
doc_id with other texts are ordered by their texts' CRC-32. Other columns are ignored by ``digests`` and carried by
``clean``, where a character that is cut apart is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm import blobs, worker
from arborlake.llm.suffix_array import repeats
from arborlake.storage import materialize

GRAM = 24
#: Segments of a key that a round of documents, and all documents, may hold before its strings travel alone.
CROWD, CROWDED = 64, 1_000
#: Bytes of text worked on at once, of a shard's text, and of numbers or text to a partition.
CHUNK_BYTES, SHARD_BYTES, PARTITION_BYTES = 400_000, 500_000, 16_000_000
#: Bytes of text whose segments, or of strings that, a task holds before it deals them out, however many rows a batch has.
ROUND_BYTES = 8_000_000
#: Strings side by side that are judged at once by the bytes that all of them have.
STEP = 10
#: Stands for a null doc_id.
NO_ID = -(1 << 63)

SEGMENT, SPAN, WHOLE, SINGLE = 0, 1, 2, 3

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_CODES = _mix(np.arange(1, 257, dtype=np.uint64) * _M1)


class Rolling:
    """Hashes of any substrings of one byte array."""

    _powers = np.ones(1, np.uint64)
    _back = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling._powers) < n:
            size = max(n, CHUNK_BYTES)
            with np.errstate(over="ignore"):
                Rolling._powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]))
                Rolling._back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, _INVERSE)]))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data] * Rolling._powers[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * Rolling._back[start] + np.asarray(size).astype(np.uint64) * _M1)

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * Rolling._back[:n])


def segments(data: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, start in data, size, key, content hash, place of the key's bytes) of the segments of documents side by side."""
    nothing = np.zeros(0, np.int64)
    whole = np.maximum(np.diff(begins) - length + 1, 0)
    total = int(whole.sum())
    if not total:
        return nothing, nothing, nothing, nothing.view(np.uint64), nothing.view(np.uint64), nothing
    rolling = Rolling(data)
    grams = rolling.all(GRAM)
    low = np.uint64(0xFFFFFFFF)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, least, reach = length - GRAM + 1, keys, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    owner = np.repeat(np.arange(len(whole)), whole)
    place = np.arange(total) - np.repeat(np.cumsum(whole) - whole, whole) + np.repeat(begins[:-1], whole)
    at = (least[place] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    start, stop, gram, owner = place[first], place[np.append(first[1:], total) - 1], at[first], owner[first]
    # strings that begin up to half way before the gram, and those that begin earlier
    half = (length - GRAM) // 2
    later, earlier = np.flatnonzero(stop >= gram - half), np.flatnonzero(start < gram - half)
    key = np.concatenate([rolling.spans(gram[later], length - half), rolling.spans(gram[earlier] - half - 1, half + 1 + GRAM)])
    begin = np.concatenate([np.maximum(start, gram - half)[later], start[earlier]])
    size = np.concatenate([stop[later], np.minimum(stop, gram - half - 1)[earlier]]) - begin + length
    place = np.concatenate([gram[later], gram[earlier] - half - 1]) - begin
    return np.concatenate([owner[later], owner[earlier]]), begin, size, key, rolling.spans(begin, size), place


def _rounds(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Rows of a batch in turns of some ``most`` bytes of text."""
    turn = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    cuts = np.flatnonzero(turn[1:] != turn[:-1]) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)])


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


DTYPES = ["<u8", "<u8", "<i8", "<u4", "<i4", "<i4", "<i4"]  # key, content, doc, crc, start, size, place of the key's bytes
WIDTH, ROW_BYTES = len(DTYPES), sum(np.dtype(t).itemsize for t in DTYPES)


def _typed(columns: list[np.ndarray]) -> list[np.ndarray]:
    return [np.asarray(c).astype(t, copy=False) for c, t in zip(columns, DTYPES)]


def _announce(length: int, slices: int, crowd: int):
    """Segments as numbers, dealt by key; equal ones of a round are combined, crowded keys set apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, crcs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for begin, end in _rounds(batch.column(2), ROUND_BYTES):
                yield from dealt(ids[begin:end], crcs[begin:end], batch.column(2).slice(begin, end - begin))

    def dealt(ids: np.ndarray, crcs: np.ndarray, column: pa.Array) -> Iterator[pa.RecordBatch]:
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]
        found: list[list[np.ndarray]] = []
        for a, b in _runs(texts):
            begins = np.concatenate([[0], np.cumsum([len(t) for t in texts[a:b]])]).astype(np.int64)
            owner, start, size, key, content, place = segments(np.frombuffer(b"".join(texts[a:b]), np.uint8), begins, length)
            found.append(_typed([key, content, ids[a + owner], crcs[a + owner], start - begins[owner], size, place]))
        del texts
        if not found:
            return
        key, content, doc, crc, start, size, place = (np.concatenate(x) for x in zip(*found))
        del found
        if not len(key):
            return
        order = np.lexsort((start, crc, doc, content, key))
        key, content, doc, crc, start, size, place = (x[order] for x in (key, content, doc, crc, start, size, place))
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])])
        at = np.flatnonzero(~first)
        if len(at):
            yield blobs.deal(SPAN, at % slices, [x[at] for x in (key, content, doc, crc, start, size, place)])
        key, content, doc, crc, start, size, place = (x[first] for x in (key, content, doc, crc, start, size, place))
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(begin, len(key)))
        crowded = np.repeat(counts > crowd, counts)
        if crowded.any():
            at = np.flatnonzero(crowded)
            yield blobs.deal(SINGLE, at % slices, [x[at] for x in (key, content, doc, crc, start, size, place)])
            # a note of size 0, so that other rounds' segments of the key follow
            note = begin[counts > crowd]
            size[note] = 0
            crowded[note] = False
        at = np.flatnonzero(~crowded)
        yield blobs.deal(SEGMENT, (key[at] % np.uint64(slices)).astype(np.int64), [x[at] for x in (key, content, doc, crc, start, size, place)])

    return run


def _compare(slices: int, most: int):
    """Segments of a key together: SPAN for those that repeat wholly, WHOLE or SINGLE for those to be fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = blobs.Gathered(batches, DTYPES)
        for at in held.keys():
            key, content, doc, crc, start, size, place = held.take(at)
            kind = at[0]
            if kind != SEGMENT:
                yield blobs.deal(kind, _document_slice(doc, slices), [key, content, doc, crc, start, size, place])
                continue
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            shared = np.zeros(len(key), bool)
            shared[1:] |= same
            shared[:-1] |= same
            order = order[shared]
            order = order[np.lexsort((start[order], crc[order], doc[order], content[order], key[order]))]
            key, content, doc, crc, start, size, place = (x[order] for x in (key, content, doc, crc, start, size, place))
            real = size > 0
            values, at, counts = np.unique(key, return_inverse=True, return_counts=True)
            noted = np.bincount(at, ~real, len(values)) > 0
            key, content, doc, crc, start, size, place, at = (x[real] for x in (key, content, doc, crc, start, size, place, at))
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
            columns = [key, content, doc, crc, start, size, place]
            different = np.bincount(at, first, len(values))
            single = (noted | (different > most))[at] & first
            whole = (different > 1)[at] & first & ~single
            for kind, chosen in ((SPAN, ~first), (SINGLE, single), (WHOLE, whole)):
                if chosen.any():
                    yield blobs.deal(kind, _document_slice(doc[chosen], slices), [c[chosen] for c in columns])

    return run


def _document_slice(doc: np.ndarray, slices: int) -> np.ndarray:
    return (_mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(slices)).astype(np.int64)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is to be fetched, a row for each document: doc, crc, kinds, keys, starts, sizes, places."""
    held = blobs.Gathered(batches, DTYPES)
    parts = {}
    for kind, part in held.keys():
        parts.setdefault(part, []).append(kind)
    for part, kinds in parts.items():
        taken = [(kind, held.take((kind, part))) for kind in kinds]
        kind = np.concatenate([np.full(len(c[0]), k, np.int8) for k, c in taken])
        key, _, doc, crc, start, size, place = (np.concatenate(x) for x in zip(*(c for _, c in taken)))
        order = np.lexsort((start, crc, doc))
        kind, key, doc, crc, start, size, place = (x[order] for x in (kind, key, doc, crc, start, size, place))
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])]))
        cut = lambda x: pa.array([p.tobytes() for p in np.split(x, first[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[first]), pa.array(crc[first].astype(np.int64)), cut(kind), cut(key), cut(start), cut(size), cut(place)],
            ["doc", "crc", "kinds", "keys", "starts", "sizes", "places"],
        )


def _string_hashes(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the strings at some places."""
    return Rolling(data).spans(at, length), Rolling(data[::-1]).spans(len(data) - at - length, length)


def _with_bytes(kind: int, slices: np.ndarray, columns: list[np.ndarray], texts: list[bytes]) -> pa.RecordBatch:
    dealt = blobs.deal(kind, slices, columns)
    order = np.argsort(slices, kind="stable").tolist()
    ends = np.cumsum(dealt.column(2).to_numpy()).tolist()
    joined = [b"".join(texts[i] for i in order[a:b]) for a, b in zip([0, *ends], ends)]
    return pa.RecordBatch.from_arrays([*dealt.columns, pa.array(joined, pa.binary())], [*dealt.schema.names, "bytes"])


def _fetch(length: int, slices: int):
    """Segments with their bytes, dealt by key. The strings of crowded keys are dealt singly by their own hash;
    of equal ones in a round the first goes on, the others are spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[list[np.ndarray]] = []
        single: list[list[np.ndarray]] = []
        texts: list[bytes] = []
        raws: list[bytes] = []
        room = ROUND_BYTES
        for batch in batches:
            docs, crcs = (batch.column(i).to_pylist() for i in range(2))
            for i, text in enumerate(batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                kinds, keys, starts, sizes, places = (
                    np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in ((3, np.int8), (4, DTYPES[0]), (5, DTYPES[4]), (6, DTYPES[5]), (7, DTYPES[6]))
                )
                at = np.flatnonzero(kinds == WHOLE)
                if len(at):
                    whole.append(_typed([keys[at], np.zeros(len(at)), np.full(len(at), docs[i]), np.full(len(at), crcs[i]), starts[at], sizes[at], places[at]]))
                    texts += [raw[a : a + z] for a, z in zip(starts[at].tolist(), sizes[at].tolist())]
                    room -= int(sizes[at].sum()) + ROW_BYTES * len(at)
                at = np.flatnonzero(kinds != WHOLE)
                if len(at):
                    begins, counts = starts[at].astype(np.int64), sizes[at].astype(np.int64) - length + 1
                    # few of a document's strings at a time: a text may hold crowded keys throughout
                    most = max(1, ROUND_BYTES // ((length + ROW_BYTES) * (length - GRAM + 1)))
                    for a in range(0, len(at), most):
                        begin, count = begins[a : a + most], counts[a : a + most]
                        start = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
                        low = int(begin[0])
                        cut = raw[low : int(start[-1]) + length]
                        hashes = _string_hashes(np.frombuffer(cut, np.uint8), start - low, length)
                        single.append([*hashes, np.full(len(start), docs[i]), np.full(len(start), crcs[i]), start, np.full(len(start), len(raws)), start - low])
                        raws.append(cut)
                        room -= len(cut) + (length + ROW_BYTES) * len(start)
                        if room < 0:
                            yield from flushed(whole, texts, single, raws)
                            room = ROUND_BYTES
                if room < 0:
                    yield from flushed(whole, texts, single, raws)
                    room = ROUND_BYTES
        yield from flushed(whole, texts, single, raws)

    def flushed(whole: list, texts: list, single: list, raws: list) -> Iterator[pa.RecordBatch]:
        if whole:
            columns = [np.concatenate(x) for x in zip(*whole)]
            yield _with_bytes(WHOLE, (columns[0] % np.uint64(slices)).astype(np.int64), columns, texts)
        if single:
            a, b, doc, crc, start, raw, within = (np.concatenate(x) for x in zip(*single))
            order = np.lexsort((start, crc, doc, b, a))
            new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
            at = order[new]
            columns = _typed([a[at], np.zeros(len(at)), doc[at], crc[at], start[at], np.full(len(at), length), np.zeros(len(at))])
            strings = [raws[r][p : p + length] for r, p in zip(raw[at].tolist(), within[at].tolist())]
            yield _with_bytes(WHOLE, (columns[0] % np.uint64(slices)).astype(np.int64), columns, strings)
            at = order[~new]
            if len(at):
                at = at[np.lexsort((start[at], crc[at], doc[at]))]
                columns = _side_by_side(doc[at], crc[at], start[at], length)
                yield _with_bytes(SPAN, _document_slice(columns[2], slices), columns, [b""] * len(columns[0]))
        for held in (whole, texts, single, raws):
            held.clear()

    return run


def _side_by_side(doc: np.ndarray, crc: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """One span for the strings of a document that follow each other place by place."""
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]) | (start[1:] > start[:-1] + 1)]))
    extent = start[np.append(first[1:], len(start)) - 1] - start[first] + length
    zero = np.zeros(len(first))
    return _typed([zero, zero, doc[first], crc[first], start[first], extent, zero])


def _neighbours(key: np.ndarray) -> np.ndarray:
    """Order by key of those whose key stands more than once."""
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1], [False]])
    return order[same[1:] | same[:-1]]


def _blocks(order: np.ndarray, key: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows ordered by key in blocks of whole keys; a new one at the first key after each ``most`` bytes."""
    block = np.cumsum(size[order], dtype=np.int64) // most
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    block = np.maximum.accumulate(np.where(new, block, 0))
    return np.split(order, np.flatnonzero(block[1:] != block[:-1]) + 1)


def _trimmed(texts: list[bytes], key: np.ndarray, size: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first string, last string) of whole keys' segments, without the strings at the ends that no other segment has.
    ``STEP`` strings at a time: those that begin up to so far before the key's bytes, which have ``length - STEP + 1`` bytes in common."""
    last = size.astype(np.int64) - length
    place = place.astype(np.int64)
    low = (place - last) // STEP
    counts = place // STEP - low + 1
    segment = np.repeat(np.arange(len(size)), counts)
    step = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts) + low[segment]
    # the strings of one step, by where they begin in their segment
    first = np.maximum(place[segment] - (step + 1) * STEP + 1, 0)
    final = np.minimum(place[segment] - step * STEP, last[segment])
    begins = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[:-1]
    hashed = Rolling(np.frombuffer(b"".join(texts), np.uint8)).spans(begins[segment] + place[segment] - step * STEP, length - STEP + 1)
    kept = _neighbours(_mix(key[segment] ^ _mix(step.astype(np.uint64) + hashed)))
    left, right = last.copy(), np.full(len(size), -1)
    np.minimum.at(left, segment[kept], first[kept])
    np.maximum.at(right, segment[kept], final[kept])
    at = np.flatnonzero(right >= 0)
    return at, left[at], right[at]


def _sort_shards(length: int, slices: int):
    """Suffix arrays over shards of whole keys; SPAN rows of the strings that also begin earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for kind, part, _, *packed, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == SPAN:
                    columns = [np.frombuffer(x, t) for x, t in zip(packed, DTYPES)]
                    yield blobs.deal(SPAN, _document_slice(columns[2], slices), columns)
                else:
                    held.setdefault(part, []).append((*packed, text))
        for part in sorted(held):
            *packed, text = (b"".join(x) for x in zip(*held.pop(part)))
            key, _, doc, crc, start, size, place = (np.frombuffer(x, t) for x, t in zip(packed, DTYPES))
            ends = np.cumsum(size, dtype=np.int64)
            # what has a key alone has no string in common with any other
            order = _neighbours(key)
            left: list[list[np.ndarray]] = []
            for rows in _blocks(order, key, size, SHARD_BYTES) if len(order) else []:
                cut = [text[ends[i] - size[i] : ends[i]] for i in rows.tolist()]
                at, first, last = _trimmed(cut, key[rows], size[rows], place[rows], length)
                left.append([rows[at], first, last])
            if not left:
                continue
            rows, first, last = (np.concatenate(x) for x in zip(*left))
            begin, key, doc, crc, start = ends[rows] - size[rows] + first, key[rows], doc[rows], crc[rows], start[rows] + first
            size = last - first + length
            for rows in _blocks(np.arange(len(rows)), key, size, SHARD_BYTES) if len(rows) else []:
                rows = rows[np.lexsort((start[rows], crc[rows], doc[rows]))]
                found = repeats([text[a : a + z] for a, z in zip(begin[rows].tolist(), size[rows].tolist())], length)
                where = np.repeat(rows, [len(f) for f in found])
                if not len(where):
                    continue
                columns = _side_by_side(doc[where], crc[where], start[where] + np.concatenate(found), length)
                yield blobs.deal(SPAN, _document_slice(columns[2], slices), columns)

    return run


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: its removed runs, apart from each other, in order."""
    held = blobs.Gathered(batches, DTYPES)
    for key in held.keys():
        _, _, doc, crc, start, size, _ = held.take(key)
        order = np.lexsort((start, crc, doc))
        doc, crc = doc[order], crc[order].astype(np.int64)
        start, end = start[order].astype(np.int64), (start + size)[order].astype(np.int64)
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])])
        # documents are moved apart, so that one running maximum serves all
        reach = int(end.max()) + 1
        apart = (np.cumsum(new) - 1) * reach
        furthest = np.maximum.accumulate(end + apart)
        first = np.flatnonzero(new | np.concatenate([[True], (start + apart)[1:] > furthest[:-1]]))
        stop = (furthest - apart)[np.append(first[1:], len(start)) - 1]
        doc, crc, start = doc[first], crc[first], start[first]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])]))
        cut = lambda x: pa.array([p.tobytes() for p in np.split(x, first[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(crc[first]), cut(start), cut(stop)], ["doc", "crc", "starts", "ends"])


def removed(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD, crowded: int = CROWDED) -> DataFrame:
    """Rows (doc, crc, starts, ends) of the documents that lose bytes: packed places of the removed runs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    source = _keyed(docs, "doc_id", "text").select("doc", "crc", "text")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(least, total * 3 // (length - GRAM + 2) * ROW_BYTES // PARTITION_BYTES + 1)
    announced = source.mapInArrow(worker.cleared(_announce(length, parts, crowd)), blobs.schema(WIDTH)).repartitionById(parts, "slice")
    compared = materialize(announced.mapInArrow(_compare(parts, crowded), blobs.schema(WIDTH)), "suffix-compared")
    wanted = materialize(
        compared.filter(F.col("kind") != SPAN)
        .repartitionById(parts, "slice")
        .mapInArrow(_by_document, "doc long, crc long, kinds binary, keys binary, starts binary, sizes binary, places binary"),
        "suffix-wanted",
    )
    amounts = {r.kind: r.n for r in compared.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    volume = amounts.get(WHOLE, 0) * 2 * length + amounts.get(SINGLE, 0) * ((length - GRAM) // 4 + 1) * 2 * length
    shards = max(least, volume // PARTITION_BYTES + 1)
    fetched = source.join(wanted.hint("shuffle_hash"), ["doc", "crc"]).select("doc", "crc", "text", "kinds", "keys", "starts", "sizes", "places")
    sorted_ = (
        fetched.mapInArrow(_fetch(length, shards), blobs.schema(WIDTH) + ", bytes binary")
        .repartitionById(shards, "slice")
        .mapInArrow(_sort_shards(length, parts), blobs.schema(WIDTH))
    )
    spans = compared.filter(F.col("kind") == SPAN).unionByName(sorted_)
    return materialize(
        spans.repartitionById(parts, "slice").mapInArrow(_merge_spans, "doc long, crc long, starts binary, ends binary"), "suffix-spans"
    )


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(
        *[F.col(f"`{n}`") for n in docs.columns],
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.crc32(F.encode(content, "UTF-8")).alias("crc"),
    )


def _kept(raw: bytes, starts: bytes | None, ends: bytes | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of runs that are not."""
    if starts is None:
        return raw, 0
    a, b = np.frombuffer(starts, np.int64).tolist(), np.frombuffer(ends, np.int64).tolist()
    return b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)])), len(a)


def digests(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    joined = _keyed(source, "doc_id", "text").join(
        removed(source, length, crowd=crowd, crowded=crowded).hint("shuffle_hash"), ["doc", "crc"], "left"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, starts, ends in zip(batch.column(1), batch.column(2), batch.column(3)):
                raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
                left, runs = _kept(raw, starts.as_py(), ends.as_py())
                rows.append((len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "starts", "ends").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated strings taken out of the text."""
    names = docs.columns
    # columns go by number, so that none clashes with those of the join
    numbered = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    at, key = names.index(text), names.index(doc_id)
    joined = _keyed(numbered, f"c{key}", f"c{at}").join(removed(docs, length, doc_id, text).hint("shuffle_hash"), ["doc", "crc"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in _rounds(batch.column(at), ROUND_BYTES):
                part = batch.slice(begin, end - begin)
                columns = list(part.columns[: len(names)])
                new = []
                for value, starts, ends in zip(columns[at], part.column(len(names)), part.column(len(names) + 1)):
                    if starts.as_py() is None:
                        new.append(value.as_py())
                    else:
                        left, _ = _kept(value.as_py().encode("utf-8", "surrogatepass"), starts.as_py(), ends.as_py())
                        new.append(left.decode("utf-8", "ignore"))
                columns[at] = pa.array(new, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(names))])

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    out = joined.select(*numbered.columns, "starts", "ends").mapInArrow(run, kinds)
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
