"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborlake.llm import blobs, components, exact_dedup, jaccard, suffix_array, suffix_dedup, worker
from tests.llm.conftest import SCHEMA, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def union_find(nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def tie(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    return find, tie


def shingles(text, n):
    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [tuple(words)])


def near(rows, n, percent):
    """(doc_id, shingles, component) of every row, comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    find, tie = union_find({i for i, _ in sets if i is not None})
    held = [(i, s) for i, s in sets if s and i is not None]
    for k, (i, s) in enumerate(held):
        for j, r in held[:k]:
            both = len(s & r)
            if 100 * both >= percent * (len(s) + len(r) - both):
                tie(i, j)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


def strip(rows, length):
    """(bytes, removed, runs, digest) of documents in order, by looking every string up."""
    seen, out = set(), {}
    for key in sorted(set(rows), key=lambda r: (r[0] is not None, r[0], zlib.crc32((r[1] or "").encode()))):
        raw = (key[1] or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            if raw[at : at + length] in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(raw[at : at + length])
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[key] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out


def test_exact_copies(edge_docs, edge_rows):
    got = exact_dedup.duplicates(edge_docs).collect()
    groups = defaultdict(list)
    for i, t, *_ in edge_rows:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        want.update((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_kept_rows_keep_their_columns(edge_docs, edge_rows, no_docs):
    got = exact_dedup.keep_last(edge_docs)
    assert got.columns == edge_docs.columns
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len({t or "" for _, t, *_ in edge_rows}) and set(rows) <= set(edge_rows)
    assert exact_dedup.keep_last(no_docs).count() == exact_dedup.duplicates(no_docs).count() == 0


def test_filter_misses_no_repeat(spark):
    hashed = spark.range(4000).selectExpr("xxhash64(id % 3000) as h").repartition(7)
    plane = exact_dedup.repeat_filter(hashed, 20)
    tested = exact_dedup.with_possible(hashed, plane, 20)
    repeated = tested.groupBy("h").count().filter("count > 1").select("h")
    assert tested.join(repeated, "h").filter("not possible").count() == 0
    # nearly all others pass
    assert tested.filter("possible").count() < 2100


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (1, 60)])
def test_near_copies(edge_docs, edge_rows, n, percent):
    got = Counter(tuple(r) for r in jaccard.join(edge_docs, n, percent).collect())
    assert got == near([r[:2] for r in edge_rows], n, percent)


def test_search_for_near_copies_lets_go_of_what_a_worker_kept():
    made = []

    def vocabulary(name):
        made.append(name)
        return name

    assert [worker.keep(vocabulary, "a") for _ in range(3)] == ["a"] * 3 and made == ["a"]
    for run in (jaccard._sizes(4), jaccard._meet, jaccard._verify(4, 85)):
        worker.keep(vocabulary, "a")
        for _ in worker.cleared(run)(iter([])):
            pass
        assert not worker._KEPT
    # one value at a time
    worker.keep(vocabulary, "a")
    assert worker.keep(vocabulary, "b") == "b" and len(worker._KEPT) == 1
    worker.forget()


def test_workers_of_the_join_keep_no_tokenizer(edge_docs):
    """Workers that have packed documents hold a tokenizer; the join's tasks run in the same ones."""
    import public_tokenizers

    from arborlake.llm import packing

    one = edge_docs.coalesce(1)
    packing.encode(one, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)

    def held(batches):
        import pyarrow as pa

        from arborlake.llm import worker

        n = len(worker._KEPT)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(batch), pa.int64())], ["n"])

    assert {r.n for r in one.select("text").mapInArrow(worker.cleared(held), "n long").collect()} == {0}


def test_sizes_are_counted_in_one_job(spark):
    """Not in a job for each partition, one after the other."""
    sized = spark.range(400).selectExpr("id % 90 as n_shingles")
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("sizes", "sizes")
        counts = jaccard.size_counts(sized)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("sizes")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts == {n: 5 if n <= 39 else 4 for n in range(1, 90)}
    assert 1 <= len(jobs) <= 3


def test_many_near_copies_and_common_words(spark):
    rng = random.Random(5)
    base = prose(rng, 200).split()
    texts = []
    for _ in range(150):  # copies with a few words changed: similar to some of the others
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = rng.choice("alpha beta gamma delta".split())
        texts.append(" ".join(words))
    line = "this line stands in every one of the documents and says nothing at all about them"
    texts += [f"{line} {' '.join(str(rng.randrange(10**6)) for _ in range(rng.randrange(3, 60)))}" for _ in range(150)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(100)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in jaccard.join(docs).collect()) == near(rows, 4, 85)


def test_rarest_shingles_meet():
    """Two similar sets share one of their rarest shingles, however these are counted."""
    rng = np.random.default_rng(6)
    for percent in (60, 80, 85, 100):
        for size in (1, 2, 7, 40, 333):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
                b = np.unique(np.concatenate([a[int(rng.integers(0, size // 8 + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, size // 8 + 1))).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both < percent * (len(a) + len(b) - both):
                    continue
                counts = rng.integers(0, 3, jaccard.COUNTERS)
                assert len(np.intersect1d(jaccard.rarest(a, counts, percent), jaccard.rarest(b, counts, percent)))
    assert len(jaccard.rarest(np.zeros(0, np.uint64), np.zeros(jaccard.COUNTERS, np.int64), 85)) == 0


def test_groups_that_do_not_hang_together(spark, monkeypatch):
    """Copies too far from their base, some near one another, an id that repeats with many texts, and every key crowded."""
    rng = random.Random(8)
    base = prose(rng, 150).split()
    rows = []
    for i in range(240):
        words = list(base)
        for _ in range(rng.choice([1, 2, 12, 18])):
            words[rng.randrange(len(words))] = f"own{rng.randrange(10**6)}"
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words[: rng.choice([140, 150])]))]
    rows += [(5000, t) for _, t in rows[::9]] + [(6000 + i, t) for i, (_, t) in enumerate(rows[::7])] + [(None, rows[0][1]), (7000, ""), (7001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = near(rows, 4, 85)
    assert Counter(tuple(r) for r in jaccard.join(docs).collect()) == expected
    monkeypatch.setattr(jaccard, "CROWDED", 2)
    assert Counter(tuple(r) for r in jaccard.join(docs).collect()) == expected


def test_rooms_hold_every_partner():
    """The first shingle that two similar sets share leaves each of them room for the other."""
    rng = np.random.default_rng(7)
    for percent in (60, 80, 85, 100):
        for size in (1, 2, 7, 40, 333):
            for _ in range(40):
                a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
                cut, own = (int(rng.integers(0, size // 4 + 1)) for _ in range(2))
                b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, own).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both < percent * (len(a) + len(b) - both):
                    continue
                counts = rng.integers(0, 3, jaccard.COUNTERS)
                x, y = (jaccard.rarest(s, counts, percent) for s in (a, b))
                first = next(s for s in x if s in y)
                assert jaccard.rooms(len(a), percent)[list(x).index(first)] >= len(b)
                assert jaccard.rooms(len(b), percent)[list(y).index(first)] >= len(a)


def test_sketches_of_a_pair_are_folded_to_its_shorter_one():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (30, 700, 1500, 3000, 9000)]
    sets += [np.concatenate([s[len(s) // 9 :], sets[0]]) for s in sets[1:]]
    packed = [jaccard.sketch(s) for s in sets]
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    got = jaccard._apart(packed, i, packed, j)
    for a, b, apart in zip(i, j, got):
        x, y = jaccard.folded([packed[a], packed[b]], min(len(packed[a]), len(packed[b])))
        assert apart == np.abs(x - y).sum() <= len(np.setxor1d(sets[a], sets[b]))


def far_copies(seed, copies, words=300):
    """Copies of a text that hang together with it, and as many that are too far from it, each in its own places."""
    rng = random.Random(seed)
    base = [f"{w}{i % 7}" for i, w in enumerate(prose(rng, words).split())]
    texts = []
    for i in range(2 * copies):
        new = list(base)
        for k in rng.sample(range(words), 2 if i % 2 else words // 33):
            new[k] = f"own{rng.randrange(10**9)}"
        texts.append(" ".join(new))
    return list(enumerate(texts))


def test_pairs_of_far_copies_do_not_grow_with_the_square(spark, monkeypatch):
    """Copies too far from their text, and from one another, are not paired with all of its near copies."""
    made, cross = spark.sparkContext.accumulator(0), jaccard._cross

    def counted(percent):
        run = cross(percent)

        def rows(batches):
            for batch in run(batches):
                made.add(len(batch))
                yield batch

        return rows

    monkeypatch.setattr(jaccard, "_cross", counted)
    for copies in (40, 160):
        rows = far_copies(13, copies)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        before = made.value
        assert Counter(tuple(r) for r in jaccard.join(docs, 5, 80).collect()) == near(rows, 5, 80)
        assert made.value - before <= 10 * copies


def test_copies_of_other_sizes_and_recounted_sets(spark, monkeypatch):
    """Copies that are longer and shorter than their text, also when the sets that are left are counted anew."""
    rng = random.Random(17)
    rows = far_copies(14, 40, 150)
    texts = [t.split() for _, t in rows]
    for t in list(texts):
        at, more = rng.randrange(len(t)), rng.randrange(1, 40)
        texts += [t[: max(5, at)], t[:at] + [f"x{rng.randrange(60)}" for _ in range(more)] + t[at:], t[more:]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1, rows[6][1]), (1, None), (2, rows[2][1]), (None, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(jaccard, "CROWDED", 3)
    for occurrences in (jaccard.OCCURRENCES, 0):
        monkeypatch.setattr(jaccard, "OCCURRENCES", occurrences)
        assert Counter(tuple(r) for r in jaccard.join(docs, 5, 80).collect()) == near(rows, 5, 80)


def test_short_texts_and_their_extensions(spark):
    """Many texts lie under the same empty segments, with and without an allowance."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(400):
        words = [word() for _ in range(rng.choice([8, 8, 8, *range(9, 20)]))]
        texts += [" ".join(words), " ".join(words + [word() for _ in range(rng.randrange(1, 4))])]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in jaccard.join(docs, 5, 80).collect()) == near(rows, 5, 80)


def test_crowded_keys_show_when_slack_is_used_up():
    """The keys that similar sets share weigh more than the slack, with those of segments with an allowance twice."""
    rng = np.random.default_rng(3)
    for size in (4, 5, 8, 10, 12, 15, 25, 50, 120):
        plan = jaccard.bands({s: 500 for s in range(1, size * 2)}, 80)
        band = next(band for band in plan if band.low <= size <= band.high)
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            more = jaccard.difference(size, size * 100 // 80, 80)
            b = np.unique(np.concatenate([a, rng.integers(0, 1 << 63, min(more, size // 4)).astype(np.uint64)]))
            keys, owner = jaccard.file_keys([a, b], plan, 80)
            shared = np.intersect1d(keys[owner == 0], keys[owner == 1])
            shared = shared[(shared & np.uint64(0xFF)) == plan.index(band)]
            assert (1 + (shared >> np.uint64(8) & np.uint64(1))).sum() > band.slack


def test_keys_are_counted_with_those_of_the_allowance():
    """Partitions of the candidate search are as many as the keys need, not only the segments."""
    rng = np.random.default_rng(4)
    for size in (20, 60, 150):
        plan = jaccard.bands({s: 200_000 for s in range(1, size * 2)}, 80)
        assert any(b.wide for b in plan if b.low <= size <= b.most)
        sets = [np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64)) for _ in range(50)]
        filed = len(jaccard.file_keys(sets, plan, 80)[0])
        counted = 50 * sum(b.keys(size) for b in plan if b.low <= size <= b.most)
        assert 0.9 * filed <= counted <= 1.1 * filed


def test_segments_never_miss():
    """Any two sets within the bound share a key outside the slack."""
    rng = np.random.default_rng(2)
    for size in (6, 9, 20, 61, 150, 400):
        plan = jaccard.bands({s: 500 for s in range(1, size * 2)}, 85)
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            most = jaccard.difference(len(a), len(a), 85)
            drop = int(rng.integers(0, most // 2 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both):
                continue
            keys, owner = jaccard.file_keys([a, b], plan, 85)
            shared = np.intersect1d(keys[owner == 0], keys[owner == 1])
            slack = min(band.slack for band in plan if band.low <= len(a) <= band.most)
            assert len(a) == both == len(b) or len(shared) > slack


def test_empty_join(no_docs):
    assert jaccard.join(no_docs).collect() == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, 1000 + i) for i in range(200)] + [(i, i + 1) for i in range(2000, 2100)]
    find, tie = union_find({x for e in edges for x in e})
    for a, b in edges:
        tie(a, b)
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.component) for r in got.collect()} == {(x, find(x)) for a, b in edges if a != b for x in (a, b)}


def test_suffix_arrays():
    rng = random.Random(9)
    for _ in range(150):
        letters = rng.choice([b"a", b"ab", b"abcdefgh", bytes(range(256))])
        length = rng.choice([4, 7, 20])
        parts = []
        for _ in range(rng.randrange(1, 10)):
            s = bytes(rng.choice(letters) for _ in range(rng.randrange(60)))
            if parts and rng.random() < 0.5:
                s = s[:9] + rng.choice(parts)[3:40] + s[9:]
            parts.append(s)
        text = np.array([c + 1 for c in b"".join(parts)] + [0], np.uint16)
        if len(text) > 1:
            order = suffix_array.suffix_array(text, 257, 10**6).tolist()
            assert order == sorted(range(len(text)), key=lambda i: text.tolist()[i:])
        seen = set()
        for s, found in zip(parts, suffix_array.repeats(parts, length)):
            want = []
            for i in range(len(s) - length + 1):
                if s[i : i + length] in seen:
                    want.append(i)
                seen.add(s[i : i + length])
            assert found.tolist() == want


@pytest.mark.parametrize("crowd, crowded", [(64, 1000), (1, 1000), (64, 1), (1, 1)])
def test_repeated_strings(edge_docs, edge_rows, crowd, crowded):
    """Also with nearly every gram treated as a crowded one."""
    want = strip([r[:2] for r in edge_rows], 100)
    got = suffix_dedup.digests(edge_docs, crowd=crowd, crowded=crowded).collect()
    assert Counter((r.doc_id, *tuple(r)[1:]) for r in got) == Counter((i, *want[i, t]) for i, t, *_ in edge_rows)


def test_cleaned_documents(edge_docs, edge_rows, no_docs):
    got = suffix_dedup.clean(edge_docs)
    assert got.schema.names == SCHEMA.names
    rows = got.collect()
    want = strip([r[:2] for r in edge_rows], 100)
    assert len(rows) == len(edge_rows)
    assert sum(len((r.text or "").encode()) for r in rows) <= sum(want[i, t][0] - want[i, t][1] for i, t, *_ in edge_rows)
    assert {r.text for r in rows if r.text is None} == {None}
    assert suffix_dedup.clean(no_docs).collect() == suffix_dedup.digests(no_docs).collect() == []


def _letters(rng, n):
    return bytes(rng.integers(97, 123, n, np.uint8)).decode()


def test_strings_of_a_phrase_in_different_contexts_are_not_fetched():
    """What two texts share here is shorter than the half that two equal strings would share."""
    rng = np.random.default_rng(4)
    phrase = _letters(rng, 45)
    texts = [_letters(rng, 150) + phrase + _letters(rng, 150) for _ in range(300)]
    for crowd, crowded in ((64, 1000), (1000, 100), (1000, 1000)):
        batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([1] * 300), pa.array(texts)], ["doc", "crc", "text"])
        announced = suffix_dedup._announce(100, 1, crowd)(iter([batch]))
        assert list(suffix_dedup._compare(1, crowded)(announced)) == []


def test_strings_that_no_other_segment_has_are_not_sorted():
    """Random segments around a phrase, some of which share more; nothing that repeats is lost."""
    rng = np.random.default_rng(6)
    phrase = _letters(rng, 70)
    sides = [(_letters(rng, 60), _letters(rng, 60)) for _ in range(4)]
    texts = [_letters(rng, 40) + sides[rng.integers(4)][0][-int(rng.integers(1, 60)) :] + phrase + sides[rng.integers(4)][1][: int(rng.integers(60))] + _letters(rng, 40) for _ in range(200)]
    raw = [t.encode() for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    owner, start, size, key, _, place = suffix_dedup.segments(np.frombuffer(b"".join(raw), np.uint8), begins, 100)
    order = suffix_dedup._neighbours(key)
    cut = [raw[o][s - begins[o] : s - begins[o] + z] for o, s, z in zip(owner[order], start[order], size[order])]
    at, first, last = suffix_dedup._trimmed(cut, key[order], size[order], place[order], 100)
    kept = {(i, p) for i, a, b in zip(at.tolist(), first.tolist(), last.tolist()) for p in range(a, b + 1)}
    strings = defaultdict(list)
    for i, text in enumerate(cut):
        for p in range(len(text) - 99):
            strings[text[p : p + 100]].append((i, p))
    repeated = {x for places in strings.values() if len(places) > 1 for x in places}
    assert repeated and repeated <= kept
    assert len(kept) < 0.7 * sum(map(len, strings.values()))


def _peak(rows):
    tracemalloc.start()
    for _ in rows:
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_memory_of_a_task_does_not_grow_with_its_batches():
    rng = np.random.default_rng(5)
    texts = [_letters(rng, 20_000) for _ in range(1600)]
    peaks = []
    for n in (400, 1600):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([1] * n), pa.array(texts[:n])], ["doc", "crc", "text"])
        peaks.append(_peak(suffix_dedup._announce(100, 8, 64)(iter([batch]))))
    assert peaks[1] < 1.5 * peaks[0]
    # texts whose strings all travel alone
    peaks = []
    for n in (10, 40):
        packed = [np.array([value], kind).tobytes() for value, kind in ((suffix_dedup.SINGLE, np.int8), (1, np.uint64), (0, suffix_dedup.DTYPES[4]), (20_000, suffix_dedup.DTYPES[5]), (0, np.int32))]
        columns = [pa.array(range(n)), pa.array([1] * n), pa.array(texts[:n]), *[pa.array([x] * n, pa.binary()) for x in packed]]
        batch = pa.RecordBatch.from_arrays(columns, ["doc", "crc", "text", "kinds", "keys", "starts", "sizes", "places"])
        peaks.append(_peak(suffix_dedup._fetch(100, 8)(iter([batch]))))
    assert peaks[1] < 1.5 * peaks[0]


def test_blobs_go_through_a_shuffle():
    values = np.arange(100, dtype=np.uint64)
    dealt = blobs.deal(3, (values % 7).astype(np.int64), [values, values.astype(np.int64) * 2])
    held = blobs.Gathered([dealt], ["<u8", "<i8"])
    got = sorted((int(a), int(b)) for key in held.keys() for a, b in zip(*held.take(key)))
    assert got == [(i, 2 * i) for i in range(100)]


def test_which_repeated_row_stays_does_not_depend_on_partitions(spark):
    rows = [(i % 4, f"text {i % 4}", f"v{i}", {"k": str(i % 4)}) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, m map<string,string>")
    found = [sorted(map(str, exact_dedup.keep_last(df.repartition(n, F.rand(n))).collect())) for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) == 4
