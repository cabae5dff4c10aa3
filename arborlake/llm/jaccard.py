"""Exact Jaccard join of documents' word n-grams by universe partitioning.

Two sets of sizes s <= r with a Jaccard similarity of p percent differ in at most (100-p)(s+r)/(100+p) elements. The
universe of shingles is hashed into segments; each size band has a number of segments so large that, among
sets of the band and those just above it, two sets so similar agree in at least one segment exactly, or in one
with a wider allowance up to one element. A set is therefore filed under the contents of each segment, and for
segments with the allowance also under the contents less one element. Which segments get it is decided by
band, from the number of sets in it: filing costs against the candidates that chance agreement would make.

A few segments more than needed are filed (the *slack*): a set that lies under no more crowded keys than that
finds its partners under its other keys. Sets under more are compared under crowded keys as well, so nothing is lost.
A segment with the allowance stands for two of the needed ones but may be shared by one key only, so its keys count twice.

Equal sets are one node from the start. A first round compares the sets of a key with one of them, the one that lies
under most crowded keys: in a group of near copies that is the text that the others were made from. Most sets of a key
then hang together, and the second round compares only sets that are still in different components. Those of a short
list are paired. Those under crowded keys are filed again by the finest partition of the universe, a segment for each
shingle: two similar sets differ in so few of them that they share one of the rarest, so each is filed under its rarest
``size - ceil(size * p / 100) + 1`` only. What a near copy has of its own is rare, so a copy too far from its group to
link with its hub meets nobody there. Rarity is counted over the sets filed this way, in a table of fixed size; any
order of the shingles loses nothing. Under the first shingle that two sets share, neither can have more in common with
the other than what it has from there on: this bounds the size of a partner, from both sides, so two copies of a text
that are too far from it by what each has of its own, and so have used up their room before they come to what they share,
never meet, however many there are. Sets and shingles that no pair can need are dropped before any pair is made, also
shingles that sets of one component share alone. While there are more shingles than the table can tell apart, the sets
that are left are counted and filed anew, by themselves. Candidates whose sizes, or counts of elements by hash, lie too far apart to be similar are dropped; all others
are verified on the whole texts.

Shingles are held as 64-bit hashes: to err, two different shingles of two compared texts would have to collide.

Cases: a text without words, null or empty, has no shingles and is alone. A null doc_id is alone, with a null
component. Rows that repeat a doc_id are one document that has the links of all of them; each row has its own
number of shingles. Ties do not arise. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.components import components
from arborlake.llm.pretokens import chunks
from arborlake.llm.worker import cleared
from arborlake.storage import materialize, together

#: Bytes of keys in a partition of the candidate search, and characters of text worked on at once.
PARTITION_BYTES, CHARACTERS = 8_000_000, 500_000
#: A key of more sets is crowded.
CROWDED = 12
#: Cost of a candidate against that of filing one key.
CANDIDATE_COST = 8.0
#: Members of a key in one row, members compared with a hub in one task.
ROW_MEMBERS, HUB_MEMBERS = 5_000, 500
#: Counts of elements that are kept of every set: at least so many, and one for so many elements.
COUNTS, COUNT_ELEMENTS = 128, 8
#: Entries of members and of outsiders, over the lists of one component, in a block.
BLOCK_MEMBERS, BLOCK_OUTSIDERS = 20_000, 5_000
#: Counters of how often a shingle occurs in sets under crowded keys, and how many occurrences they tell apart.
COUNTERS, OCCURRENCES = 1 << 20, 1 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_BASE = np.uint64(_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_BYTE_CODES = mix((_LOWER.astype(np.uint64) + np.uint64(1)) * _M1)
_PLACES = mix(np.arange(1, 33, dtype=np.uint64) * _M3) | np.uint64(1)


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of every text's word n-grams; one of all words if there are fewer than n."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
    space = _SPACE[data]
    inside = np.concatenate([[False], ~space, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(texts)
    # a word's hash is a difference of prefix sums, moved to place 0
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data) - 1, _BASE)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_CODES[data] * powers)])
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data) - 1, _INVERSE)]))
        hashes = mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * _M1)
        first = np.searchsorted(start, begins)
        grams = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for j in range(n):
            grams += hashes[j : j + len(grams)] * _PLACES[j]
        grams = mix(grams)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                short = (hashes[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix(np.array([short * _M1])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


@dataclass
class Band:
    """Sets of ``low`` to ``high`` elements and their partners above: filed under ``exact + wide`` segments, the
    first ``wide`` of them with an allowance of one element."""

    low: int
    high: int
    most: int
    wide: int
    exact: int
    slack: int

    def keys(self, size: int) -> int:
        """About how many keys a set is filed under: one for each segment, and one for each element in a segment with the allowance."""
        segments = self.wide + self.exact
        return segments + size * self.wide // segments


def difference(s: int, r: int, percent: int) -> int:
    """The most elements in which sets of these sizes may differ."""
    return (100 - percent) * (s + r) // (100 + percent)


def allocate(low: int, high: int, percent: int, sets: int) -> Band:
    """Choose a band's segments by cost."""
    most = high * 100 // percent
    needed = difference(high, most, percent) + 1
    slack = 1 if needed < 6 else 2 + needed // 20
    best = None
    for wide in sorted({round(needed * x / 16) for x in range(9)}):
        exact = max(0, needed + slack - 2 * wide)
        segments = wide + exact
        load = low / segments
        filed = exact + wide * (1 + load)
        # segments without content are what unlike sets share by chance; the slack takes up some of them
        empty = exact * np.exp(-load)
        chance = (exact * np.exp(-2 * load) if empty > slack / 2 else 0) + wide * ((1 + load) * np.exp(-load)) ** 2
        cost = filed + CANDIDATE_COST * sets * chance
        if best is None or cost < best[0]:
            best = (cost, Band(low, high, most, wide, exact, slack))
    return best[1]


def bands(counts: dict[int, int], percent: int) -> list[Band]:
    """Bands for the sizes in ``counts`` (size: sets), each as wide as similar sizes may lie apart."""
    out: list[Band] = []
    low, top = 1, max(counts, default=0)
    while low <= top:
        high = max(low, low * 100 // percent)
        out.append(allocate(low, high, percent, sum(n for size, n in counts.items() if low <= size <= high)))
        low = high + 1
    return out


def file_keys(sets: list[np.ndarray], plan: list[Band], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the set) of everything that the sets are filed under. A key's low byte is its band, the bit
    above tells whether its segment has the allowance of one element."""
    highs = np.array([b.high for b in plan])
    tokens, places, wides, owners, numbers, marks, kinds = [], [], [], [], [], [], []
    base = 0
    for i, s in enumerate(sets):
        if not len(s):
            continue
        own = int(np.searchsorted(highs, len(s)))
        for b in range(own, -1, -1):
            band = plan[b]
            if len(s) > band.most:
                break
            if not difference(band.high, band.most, percent):
                continue  # such sets are similar only if equal
            segments = band.wide + band.exact
            at = ((s >> np.uint64(20)) % np.uint64(segments)).astype(np.int64)
            tokens.append(s)
            places.append(at + base)
            wides.append(at < band.wide)
            owners.append(np.full(segments, i, np.int64))
            numbers.append(np.arange(segments, dtype=np.uint64))
            marks.append(np.full(segments, b, np.uint64))
            kinds.append(numbers[-1] < np.uint64(band.wide))
            base += segments
    if not base:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, place, wide = mix(np.concatenate(tokens) * _M1), np.concatenate(places), np.concatenate(wides)
    owner, number, mark = np.concatenate(owners), np.concatenate(numbers), np.concatenate(marks)
    with np.errstate(over="ignore"):
        content = np.zeros(base, np.uint64)
        np.add.at(content, place, codes)
        salt = (number + np.uint64(1)) * _M2 + (mark + np.uint64(1)) * _M3
        low = np.uint64(0x1FF)
        tail = np.concatenate(kinds).astype(np.uint64) << np.uint64(8) | mark
        whole = mix(content + salt) & ~low | tail
        at = place[wide]
        less = mix(content[at] - codes[wide] + salt[at]) & ~low | tail[at]
    return np.concatenate([whole, less]), np.concatenate([owner, owner[at]])


def sketch(s: np.ndarray) -> bytes:
    """How many elements fall to each of a power of two of hash values. The sum of two sketches' differences is never
    more than the number of elements in which their sets differ."""
    size = max(COUNTS, 1 << (len(s) // COUNT_ELEMENTS).bit_length() >> 1)
    return np.minimum(np.bincount((s >> np.uint64(9)).astype(np.int64) % size, minlength=size), 255).astype(np.uint8).tobytes()


def folded(packed: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of ``size`` counts; longer ones are folded, which keeps what a sketch promises."""
    out = np.empty((len(packed), size), np.int16)
    for i, x in enumerate(packed):
        out[i] = np.frombuffer(x, np.uint8).reshape(-1, size).sum(axis=0)
    return out


def _sizes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, CHARACTERS):
                sets = shingle_sets(texts[a:b], n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([sketch(s) for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "counts"],
                )

    return run


def _file(n: int, percent: int, plan: list[Band], slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, CHARACTERS):
                ids, fresh = [], []
                for doc, s in zip(batch.column(0).slice(a, b - a).to_pylist(), shingle_sets(texts[a:b], n)):
                    # copies are filed once by a task
                    if doc is None or (mark := hashlib.blake2b(s.tobytes(), digest_size=12).digest()) in seen:
                        continue
                    seen.add(mark)
                    ids.append(doc)
                    fresh.append(s)
                keys, owners = file_keys(fresh, plan, percent)
                if not len(keys):
                    continue
                part = (keys >> np.uint64(40)) % np.uint64(slices)
                order = np.argsort(part, kind="stable")
                parts, first = np.unique(part[order], return_index=True)
                docs = np.array(ids, np.int64)[owners[order]]
                cut = lambda x: pa.array([p.tobytes() for p in np.split(x, first[1:])], pa.binary())
                # with the slice, 32 bits, one of them the kind of segment, tell keys apart well enough for candidates
                short = (keys[order] >> np.uint64(8)).astype(np.uint32)
                band = keys[order].astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), cut(short), cut(band), cut(docs)], ["slice", "keys", "bands", "docs"])

    return run


LISTS = "list long, band int, size long, times long, chunk int, members array<long>"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of sets under one key, each list once with the number of its keys, in which a key of a segment with the
    allowance counts twice. A list's first member is its hub, the one that the others are compared with first. Lists of
    two have no band, since they have no second round."""
    held: dict[int, tuple[list, list, list]] = {}
    for batch in batches:
        for part, *packed in zip(*(c.to_pylist() for c in batch.columns)):
            for column, data in zip(held.setdefault(part, ([], [], [])), packed):
                column.append(data)
    pairs: list[np.ndarray] = []
    lists: dict[tuple[int, bytes], int] = {}
    for part in list(held):
        k, b, d = (np.frombuffer(b"".join(x), t) for x, t in zip(held.pop(part), ("<u4", "u1", "<i8")))
        keys = k.astype(np.uint64) << np.uint64(8) | b
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], d[order]
        shared = np.zeros(len(keys), bool)
        same = keys[1:] == keys[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        keys, docs = keys[shared], docs[shared]
        order = np.lexsort((mix(docs.view(np.uint64)), keys))
        keys, docs = keys[order], docs[order]
        keep = np.ones(len(keys), bool)
        keep[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        keys, docs = keys[keep], docs[keep]
        values, first, counts = np.unique(keys, return_index=True, return_counts=True)
        two = first[counts == 2]
        pairs.append(np.stack([docs[two], docs[two + 1]], axis=1))
        for value, at, count in zip(*(x[counts > 2].tolist() for x in (values, first, counts))):
            key = (value & 0xFF, docs[at : at + count].tobytes())
            lists[key] = lists.get(key, 0) + 1 + (value >> 8 & 1)
    rows = [(0, -1, 2, 1, 0, p) for p in np.unique(np.concatenate(pairs), axis=0)] if pairs else []
    for (band, packed), times in lists.items():
        members = np.frombuffer(packed, np.int64)
        name = int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "little", signed=True)
        for chunk, at in enumerate(range(0, len(members), ROW_MEMBERS)):
            # every row of a list begins with its hub
            some = members[at : at + ROW_MEMBERS]
            rows.append((name, band, len(members), times, chunk, np.append(members[:1], some) if chunk else some))
    for at in range(0, len(rows), 20_000):
        columns = list(zip(*rows[at : at + 20_000]))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["list", "band", "size", "times", "chunk", "members"])


def _may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and the sketches' differences allow for the similarity."""
    return (apart <= (100 - percent) * (n + m) // (100 + percent)) & (np.minimum(n, m) * 100 >= percent * np.maximum(n, m))


def _apart(left: list[bytes], i: np.ndarray, right: list[bytes], j: np.ndarray) -> np.ndarray:
    """How far the sketches left[i] and right[j] lie apart, each pair folded to the shorter one."""
    apart = np.empty(len(i), np.int64)
    sizes = np.minimum(*(np.array([len(x) for x in side])[at] for side, at in ((left, i), (right, j))))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        a, b = (
            folded([side[x] for x in used], size)[back]
            for side, (used, back) in ((left, np.unique(i[at], return_inverse=True)), (right, np.unique(j[at], return_inverse=True)))
        )
        apart[at] = np.abs(a - b).sum(axis=1, dtype=np.int64)
    return apart


def _possible(percent: int):
    """Pairs whose sizes and counts allow for the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 4))
            apart = np.empty(len(n), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())):
                a, b = folded([x, y], min(len(x), len(y)))
                apart[i] = np.abs(a - b).sum()
            yield batch.select([0, 1]).filter(pa.array(_may_link(n, m, apart, percent), pa.bool_()))

    return run


def _cross(percent: int):
    """Lists of a block, outsiders first: pairs of an outsider and a member of another component that may link, once
    for the list."""

    def pairs(outside: list[tuple], members: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, parts, n, room = (np.array([x[i] for x in members], np.int64) for i in range(4))
        counts = [x[4] for x in members]
        step = max(1, 4_000_000 // len(members))
        for at in range(0, len(outside), step):
            some = outside[at : at + step]
            other, part, m, space = (np.array([x[i] for x in some], np.int64) for i in range(4))
            rows, columns = np.nonzero((part[:, None] != parts) & (space[:, None] >= n) & (m[:, None] <= room))
            for k in range(0, len(rows), 10_000):
                i, j = rows[k : k + 10_000], columns[k : k + 10_000]
                apart = _apart([x[4] for x in some], i, counts, j)
                may = _may_link(n[j], m[i], apart, percent)
                yield np.minimum(other[i], ids[j])[may], np.maximum(other[i], ids[j])[may]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, outside, members = None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            if outside and members:
                for hub, doc in pairs(outside, members):
                    if len(hub):
                        yield pa.RecordBatch.from_arrays([pa.array(hub), pa.array(doc)], ["hub", "doc"])

        for batch in batches:
            for *key, is_member, doc, component, n, room, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if group != key:
                    yield from found()
                    group, outside, members = key, [], []
                (members if is_member else outside).append((doc, component, n, room, counts))
        yield from found()

    return run


def _counters(s: np.ndarray) -> np.ndarray:
    return ((s >> np.uint64(17)) % np.uint64(COUNTERS)).astype(np.int64)


def _occurrences(n: int):
    """How often the shingles of each counter occur in the sets of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts, CHARACTERS):
                for s in shingle_sets(texts[a:b], n):
                    np.add.at(total, _counters(s), 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            some = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["counter", "times"])

    return run


def rarest(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set of which a set similar to it has at least one among its own: the rarest by ``counts``, those
    equally rare by value. Similar sets share ``percent`` of the larger one, so not all of these can be missing."""
    order = np.lexsort((s, counts[_counters(s)]))
    return s[order[: len(s) + (-len(s) * percent) // 100 + 1]]


def rooms(size: int, percent: int) -> np.ndarray:
    """For each place among the rarest shingles of a set, the size of the largest set that it may be similar to if the
    shingle at this place is the first that they share: no more can be shared than what is not before it."""
    left = np.arange(size, size - (size + (-size * percent) // 100 + 1), -1)
    return (100 + percent) * left // percent - size


def _file_rarest(n: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, texts = (batch.column(i).to_pylist() for i in range(3))
            for a, b in chunks(texts, CHARACTERS):
                sets = shingle_sets(texts[a:b], n)
                few = [rarest(s, counts.value, percent) for s in sets]
                sizes = [len(x) for x in few]
                whole = [len(s) for s in sets]
                room = [rooms(k, percent)[:size] for k, size in zip(whole, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(few).view(np.int64)),
                        *(pa.array(np.repeat(x, sizes), pa.int64()) for x in (ids[a:b], parts[a:b], whole)),
                        pa.array(np.concatenate(room), pa.int64()),
                    ],
                    ["list", "doc", "component", "n", "room"],
                )

    return run


def _open(again: DataFrame, n: int, percent: int) -> DataFrame:
    """The rarest shingles of the sets (doc, component, text), as list, with the size n of the set and the size of the
    largest partner that it has room for; only where a partner from another component may be."""
    spark = again.sparkSession
    sets = again.count()
    while True:
        seen = again.select("text").mapInArrow(cleared(_occurrences(n)), "counter long, times long").groupBy("counter").agg(F.sum("times").alias("times")).toArrow()
        counts = np.zeros(COUNTERS, np.int64)
        counts[seen["counter"].to_numpy()] = seen["times"].to_numpy()
        filed = again.mapInArrow(cleared(_file_rarest(n, percent, spark.sparkContext.broadcast(counts))), "list long, doc long, component long, n long, room long")
        rare = materialize(filed.distinct(), "jaccard-rarest")
        bounds = rare.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least"), F.max("room").alias("most"))
        bounds = materialize(bounds.filter("x <> y and least <= most").select("list", "least", "most"), "jaccard-shared")
        near = materialize(rare.join(bounds, "list").filter("room >= least and n <= most").drop("least", "most"), "jaccard-near")
        left = materialize(near.join(_several(near), "list", "left_semi"), "jaccard-still")
        docs = materialize(left.select("doc").distinct(), "jaccard-left")
        before, sets = sets, docs.count()
        if counts.sum() <= OCCURRENCES or 2 * sets > before:
            return left
        again = materialize(again.join(docs, "doc", "left_semi"), "jaccard-again")


def _several(entries: DataFrame) -> DataFrame:
    """The lists whose sets do not all hang together."""
    return entries.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("list")


def _verify(n: int, percent: int):
    """Rows of a hub's group, the hub first: emit the members that are similar to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hubs = None, []
        for batch in batches:
            hub_ids, salts, doc_ids = (batch.column(i).to_pylist() for i in range(3))
            texts = batch.column(3).to_pylist()
            a_out, b_out = [], []
            for a, b in chunks(texts, CHARACTERS):
                for i, s in zip(range(a, b), shingle_sets(texts[a:b], n)):
                    if group != (hub_ids[i], salts[i]):
                        group, hubs = (hub_ids[i], salts[i]), []
                    if doc_ids[i] == hub_ids[i]:
                        hubs.append(s)
                        continue
                    for h in hubs:
                        if min(len(h), len(s)) * 100 < percent * max(len(h), len(s)) or not len(s):
                            continue
                        both = np.intersect1d(h, s, assume_unique=True).size
                        if both * 100 >= percent * (len(h) + len(s) - both):
                            a_out.append(hub_ids[i])
                            b_out.append(doc_ids[i])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def _screened(pairs: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, doc) that may be similar, written."""
    facts = lambda name, i: sized.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n{i}"), F.col("counts").alias(f"c{i}"))
    half = materialize(materialize(pairs, "jaccard-pairs").join(facts("hub", 1), "hub"), "jaccard-half")
    both = half.join(facts("doc", 2), "doc").select("hub", "doc", "n1", "c1", "n2", "c2")
    return materialize(both.mapInArrow(cleared(_possible(percent)), "hub long, doc long").distinct(), "jaccard-possible")


def _linked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (hub, doc) that are similar, as (a, b)."""
    crowds = materialize(pairs.groupBy("hub").count().filter(F.col("count") > HUB_MEMBERS), "jaccard-crowds")
    dealt = materialize(
        pairs.join(crowds, "hub", "left").select("hub", "doc", F.pmod(F.xxhash64("doc"), F.ceil(F.coalesce("count", F.lit(1)) / HUB_MEMBERS)).cast("int").alias("salt")),
        "jaccard-dealt",
    )
    # the hub itself is one of the rows of each of its groups
    wanted = dealt.unionByName(dealt.select("hub", F.col("hub").alias("doc"), "salt").distinct())
    rows = wanted.join(texts.withColumnRenamed("doc_id", "doc"), "doc").select("hub", "salt", "doc", "text")
    ordered = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("doc") != F.col("hub"))
    return materialize(ordered.mapInArrow(cleared(_verify(n, percent)), "a long, b long"), "jaccard-links")


def _texts(source: DataFrame, pairs: DataFrame) -> DataFrame:
    wanted = materialize(pairs.select(F.col("doc").alias("doc_id")).union(pairs.select("hub")).distinct(), "jaccard-wanted")
    return materialize(source.join(wanted, "doc_id"), "jaccard-texts")


def size_counts(sized: DataFrame) -> dict[int, int]:
    """Size: sets of it. There are no more sizes than the largest set has elements, so they come in one job."""
    return {r.n_shingles: r["count"] for r in sized.filter("n_shingles > 0").groupBy("n_shingles").count().collect()}


def join(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row.

    doc_id must be an integer. Two documents link when their word n-grams have a Jaccard similarity of at least
    ``percent`` percent.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    sized = materialize(source.mapInArrow(cleared(_sizes(n)), "doc_id long, n_shingles long, digest binary, counts binary"), "jaccard-sizes")

    def meet() -> tuple[list[Band], DataFrame]:
        counts = size_counts(sized)
        plan = bands(counts, percent)
        total = sum(c * sum(b.keys(s) for b in plan if b.low <= s <= b.most) for s, c in counts.items())
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 13 * total // PARTITION_BYTES + 1)
        filed = source.mapInArrow(cleared(_file(n, percent, plan, parts)), "slice int, keys binary, bands binary, docs binary")
        return plan, materialize(filed.repartitionById(parts, "slice").mapInArrow(cleared(_meet), LISTS), "jaccard-keys")

    def name() -> tuple[DataFrame, DataFrame]:
        nodes = materialize(
            sized.filter("doc_id is not null and n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node")), "jaccard-nodes"
        )
        own = sized.filter("doc_id is not null").join(nodes, "digest", "left").select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node"))
        own = materialize(own.unionByName(sized.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("node"))), "jaccard-own")
        # documents of one set go by its node; a repeated doc_id, which has several, goes by itself
        names = own.filter("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
        return own, materialize(names.select("doc_id", "a", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("doc_id")).alias("name")), "jaccard-names")

    (plan, keys), (own, names) = together(meet, name)
    named = lambda df, column, to, by="name": df.join(names.select(F.col("doc_id").alias(column), F.col(by).alias(to)), column)

    # first round: the sets of a list against its hub
    lists = keys.filter("size > 2").groupBy("list", "band", "size", "chunk").agg(F.sum("times").alias("times"), F.any_value("members").alias("members"))
    entries = named(lists.select("list", "band", "size", "times", F.explode("members").alias("copy")), "copy", "doc")
    entries = materialize(entries.select("list", "band", "size", "times", "doc").distinct(), "jaccard-lists")
    crowded = F.col("size") > CROWDED
    crowd = materialize(entries.filter(crowded).groupBy("doc", "band").agg(F.sum("times").alias("crowd")), "jaccard-crowd")
    ranked = entries.join(crowd, ["doc", "band"], "left").select("list", "doc", F.struct(F.coalesce("crowd", F.lit(0)), F.xxhash64("doc"), "doc").alias("rank"))
    hubs = materialize(ranked.groupBy("list").agg(F.max_by("doc", "rank").alias("hub")), "jaccard-hubs")
    two = keys.filter("size = 2").select(F.col("members")[0].alias("x"), F.col("members")[1].alias("y"))
    two = named(named(two, "x", "hub"), "y", "doc").select("hub", "doc")
    first = entries.select("list", "doc").join(hubs, "list").select("hub", "doc").unionByName(two)
    first = _screened(first.filter("hub <> doc").distinct(), sized, percent)
    links = _linked(first, _texts(source, first), n, percent)

    # second round: sets of a list that do not hang together yet
    placed = materialize(
        entries.join(components(links).withColumnRenamed("node", "doc"), "doc", "left").select("list", "band", "size", "doc", F.coalesce("component", "doc").alias("component")),
        "jaccard-entries",
    )
    placed = placed.join(materialize(_several(placed), "jaccard-open"), "list", "left_semi")
    # a list of few sets is at most CROWDED * (CROWDED - 1) / 2 pairs
    short = placed.filter(~crowded).groupBy("list").agg(F.collect_list(F.struct("doc", "component")).alias("m"))
    short = short.select(F.explode("m").alias("u"), "m").select("u", F.explode("m").alias("v")).filter("u.doc < v.doc and u.component <> v.component")
    short = short.select(F.col("u.doc").alias("hub"), F.col("v.doc").alias("doc")).distinct()
    slack = F.element_at(F.array(*[F.lit(b.slack) for b in plan] or [F.lit(0)]), F.col("band") + 1)
    busy = placed.filter(crowded).join(crowd.filter(F.col("crowd") > slack), ["doc", "band"], "left_semi")
    busy = materialize(busy.groupBy("doc").agg(F.min("component").alias("component")), "jaccard-busy")
    again = materialize(busy.join(source, F.col("doc") == F.col("doc_id")).select("doc", "component", "text"), "jaccard-again")
    still = _open(again, n, percent)
    # only members outside a list's largest component are compared, with all of it
    by_part = still.groupBy("list", "component").agg(F.count(F.lit(1)).alias("n"))
    shape = materialize(
        by_part.groupBy("list").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("k")),
        "jaccard-shape",
    )
    grid = shape.groupBy("largest").agg(
        F.ceil(F.sum("n") / BLOCK_MEMBERS).cast("int").alias("rows"), F.ceil(F.sum("k") / BLOCK_OUTSIDERS).cast("int").alias("columns")
    )
    shape = materialize(shape.select("list", "largest").join(grid, "largest"), "jaccard-grid")
    facts = sized.filter("doc_id is not null").select("doc_id", F.col("n_shingles").alias("n"), "counts").distinct()
    known = materialize(still.join(facts.withColumnRenamed("doc_id", "doc"), ["doc", "n"]), "jaccard-known").join(shape, "list")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n, seed: F.pmod(F.xxhash64("doc", F.lit(seed)), F.col(n)).cast("int")
    rest = ["doc", "component", "n", "room", "counts"]
    members = known.select("largest", mine("rows", 1).alias("a"), every("columns").alias("b"), "list", F.lit(True).alias("member"), *rest)
    outside = known.filter("component <> largest").select("largest", every("rows").alias("a"), mine("columns", 2).alias("b"), "list", F.lit(False).alias("member"), *rest)
    blocks = members.unionByName(outside).repartition("largest", "a", "b").sortWithinPartitions("largest", "a", "b", "list", "member")
    second = blocks.mapInArrow(cleared(_cross(percent)), "hub long, doc long").unionByName(short).distinct()
    tried = first.select(F.least("hub", "doc").alias("hub"), F.greatest("hub", "doc").alias("doc"))
    second = _screened(materialize(second, "jaccard-second").join(tried, ["hub", "doc"], "left_anti"), sized, percent)
    more = _linked(second, _texts(source, second), n, percent)

    # links between documents, and between a document and the node of its set
    joined = named(named(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")), "u", "x", "a"), "v", "y", "a")
    joined = joined.select(F.col("x").alias("a"), F.col("y").alias("b"))
    # a repeated doc_id ties the nodes of its rows together
    ties = own.join(names, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b")
    whole = components(joined.unionByName(ties))
    return own.join(whole, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
