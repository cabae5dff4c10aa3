"""Licence notices in documents, by a positional index of rare words.

Documents are read twice. The first pass counts in how many of them each word of the notices stands; these counts
are the only statistics, one number for each word of the notices. Each notice is then indexed by its words of
highest IDF: word to (notice, place in it). The second pass looks up the indexed words of a document; every one
of them says where a notice would begin. Where enough different words say nearly the same beginning, the notice's
mandatory phrases are checked, and all of them must stand in that place.

*Phrases* are notices whose words must stand one after the other: their rarest word alone is looked up, at every
place, and the other words are checked at their places, so that no place is missed. *Notices* allow for words
put in or left out.

Cases: a null or empty text has no words, no places and score 0. Rows that repeat an id are judged by
themselves. Words are runs of letters, digits and code points beyond ASCII; only A to Z are lower-cased. Words of equal
document frequency are ranked by their bytes. A long text costs 4 bytes for each of its words. An empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.words import windows

_WORD, _OUTSIDE = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


@dataclass(frozen=True)
class Notice:
    """A label, the text of a notice, and phrases of it that must stand in a document."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Phrases that count wherever they stand, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Usual notices of public licences, and what in them tells them apart.
NOTICES = (
    Notice("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", ("affero general public license",)),
    Notice("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Notice(
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        ("apache org licenses license 2 0",),
    ),
    Notice("boost-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    Notice(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        ("redistribution and use in source and binary forms", "conditions are met"),
    ),
    Notice("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Notice("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Notice("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Notice("cc-by-nc-nd-4.0", "licensed under CC BY-NC-ND 4.0", ("cc by nc nd 4 0",)),
    Notice("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
    Notice("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Notice("cc0-1.0", "dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0",)),
    Notice("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    Notice("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Notice("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Notice(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation",
        ("free software foundation", "general public license"),
    ),
    Notice(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Notice("lgpl", "licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Notice("mit", "Released under the MIT License", ("mit license",)),
    Notice(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files, to deal in the Software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Notice("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Notice(
        "unlicense",
        "This is free and unencumbered software released into the public domain",
        ("free and unencumbered software released into the public domain",),
    ),
    Notice(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for "
        "any damages arising from the use of this software",
        ("as is without any express or implied warranty",),
    ),
)

#: Words of a notice that are looked up, those of highest IDF; the share of them that must agree; and how many words
#: they may be apart: so many, and one more for every so many words of the notice.
RARE, AGREE_PERCENT, SLACK, SLACK_WORDS = 8, 60, 3, 5

_SCORES = "doc_id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_MATCHES = "doc_id {}, label string, word long, words long, score double, base boolean"
#: Rows of a batch of matches.
BATCH_MATCHES = 50_000


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


class Index:
    """The notices with the counts of a corpus: which words are looked up, and what they say."""

    def __init__(self, phrases: Mapping[str, str], notices: Sequence[Notice], docs: int, frequency: Mapping[bytes, int]):
        self.number = {w: i + 1 for i, w in enumerate(vocabulary(phrases, notices))}
        self.idf = {i: math.log((1 + docs) / (1 + frequency.get(w, 0))) + 1 for w, i in self.number.items()}
        rank = {i: (frequency.get(w, 0), w) for w, i in self.number.items()}
        numbers = lambda text: [self.number[w] for w in words(text)]

        self.looked_up = np.zeros(len(self.number) + 1, bool)
        self.phrases = []
        for text, label in phrases.items():
            ids = numbers(text)
            anchor = min(range(len(ids)), key=lambda k: (rank[ids[k]], k))
            self.phrases.append((label, np.array(ids, np.int32), anchor))
            self.looked_up[ids[anchor]] = True
        self.notices = []
        for notice in notices:
            ids = numbers(notice.text)
            rare = sorted(set(ids), key=lambda i: rank[i])[:RARE]
            postings = {i: [k for k, x in enumerate(ids) if x == i] for i in rare}
            keys = [np.array(numbers(k), np.int32) for k in notice.keys]
            self.notices.append((notice.label, len(ids), postings, keys, SLACK + len(ids) // SLACK_WORDS))
            self.looked_up[rare] = True

    def ids(self, data: bytes) -> np.ndarray:
        """A number for each word of a text, 0 for words that no notice has."""
        get, parts = self.number.get, []
        for piece in windows(data.lower(), _OUTSIDE):
            found = _WORD.findall(piece)
            parts.append(np.fromiter(map(get, found, repeat(0)), np.int32, len(found)))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def matches(self, ids: np.ndarray) -> list[tuple[str, np.ndarray, int, np.ndarray, bool]]:
        """(label, first words, words, scores, whether a phrase) of the notices that stand in a document."""
        hits = np.flatnonzero(self.looked_up[ids])
        if not hits.size:
            return []
        at = ids[hits]
        places = {int(i): hits[at == i] for i in np.unique(at)}
        found = []
        for label, phrase, anchor in self.phrases:
            if (places_of := places.get(int(phrase[anchor]))) is not None:
                starts = _standing(ids, phrase, places_of - anchor)
                if starts.size:
                    found.append((label, starts, len(phrase), np.ones(len(starts)), True))
        for label, size, postings, keys, slack in self.notices:
            present = postings.keys() & places.keys()
            if 100 * len(present) < AGREE_PERCENT * len(postings):
                continue
            starts, scores = self._agreeing(postings, present, places, slack)
            for key in keys:
                starts, scores = _with_key(ids, key, starts, scores, size, slack)
            if starts.size:
                found.append((label, *_best(starts, scores, slack, size), False))
        return found

    def _agreeing(self, postings: dict, present: set, places: dict, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings from which on, within the slack, enough words say that the notice begins; and their weight."""
        says = {i: np.unique(np.concatenate([places[i] - k for k in postings[i]])) for i in sorted(present)}
        starts = np.unique(np.concatenate(list(says.values())))
        count, weight = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        for i, begins in says.items():
            near = np.searchsorted(begins, starts + slack, "right") > np.searchsorted(begins, starts, "left")
            count += near
            weight += near * self.idf[i]
        kept = 100 * count >= AGREE_PERCENT * len(postings)
        whole = sum(self.idf[i] for i in sorted(postings))
        return starts[kept], np.minimum(weight[kept] / whole, 1.0)


def _standing(ids: np.ndarray, phrase: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Those of the starts where the words of a phrase follow each other."""
    starts = starts[(starts >= 0) & (starts + len(phrase) <= len(ids))]
    for k, word in enumerate(phrase):
        starts = starts[ids[starts + k] == word]
    return starts


def _with_key(ids, key, starts, scores, size, slack):
    """Those of the beginnings that have a mandatory phrase between their first and last word, give or take the slack."""
    if not starts.size:
        return starts, scores
    stands = _standing(ids, key, np.flatnonzero(ids == key[0]))
    first = np.searchsorted(stands, starts - slack, "left")
    last = np.searchsorted(stands, starts + size + slack - len(key), "right")
    return starts[last > first], scores[last > first]


def _best(starts: np.ndarray, scores: np.ndarray, slack: int, size: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Of beginnings that lie within the slack of each other, the first of the highest score."""
    run = np.concatenate([[0], np.cumsum(np.diff(starts) > slack)])
    order = np.lexsort((starts, -scores, run))
    first = order[np.unique(run[order], return_index=True)[1]]
    return np.maximum(starts[first], 0), size, scores[first]


def vocabulary(phrases: Mapping[str, str], notices: Sequence[Notice]) -> list[bytes]:
    texts = [*phrases, *(n.text for n in notices), *(k for n in notices for k in n.keys)]
    return sorted({w for t in texts for w in words(t)})


def _bytes(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    for text in batch.column(name):
        raw = text.as_buffer()
        yield raw.to_pybytes() if raw is not None else b""


def build(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Sequence[Notice] = NOTICES, text: str = "text") -> Index:
    """The index, from document frequencies over all documents. Only one number for each word of the notices is collected."""
    known = frozenset(vocabulary(phrases, notices))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_with: Counter = Counter()
        for batch in batches:
            for data in _bytes(batch, "text"):
                present = set()
                for piece in windows(data.lower(), _OUTSIDE):
                    present |= known.intersection(_WORD.findall(piece))
                docs_with.update(present)
        yield pa.RecordBatch.from_arrays([pa.array(list(docs_with), pa.binary()), pa.array(list(docs_with.values()), pa.int64())], ["word", "docs"])

    texts = docs.select(F.col(f"`{text}`").alias("text"))
    counted = texts.mapInArrow(count, "word binary, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    return Index(phrases, notices, texts.count(), {bytes(r.word): r.docs for r in counted})


def _prepared(docs: DataFrame, index: Index, doc_id: str, text: str):
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source, docs.sparkSession.sparkContext.broadcast(index), source.schema["doc_id"].dataType.simpleString()


def scan(docs: DataFrame, index: Index, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base (places of phrases), first_word and last_word (the least and greatest
    of them, null without), base_labels, labels (of notices too), score (the greatest of a place, 0 without).

    The score of a place is the share of a notice's indexed words that agree on it, by IDF; 1 for a phrase.
    """
    source, shared, kind = _prepared(docs, index, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        names, kinds = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"], [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            rows = []
            for data in _bytes(batch, "text"):
                ids = held.ids(data)
                found = held.matches(ids)
                base = [(label, starts) for label, starts, _, _, phrase in found if phrase]
                rows.append((
                    len(ids), sum(len(s) for _, s in base),
                    min((int(s[0]) for _, s in base), default=None), max((int(s[-1]) for _, s in base), default=None),
                    ",".join(sorted({label for label, _ in base})), ",".join(sorted({f[0] for f in found})),
                    max((float(f[3].max()) for f in found), default=0.0),
                ))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", *names])

    return source.mapInArrow(run, _SCORES.format(kind))


def matches(docs: DataFrame, index: Index, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per place: doc_id, label, word (from 0), words (of the notice), score, base (whether a phrase)."""
    source, shared, kind = _prepared(docs, index, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for i, data in enumerate(_bytes(batch, "text")):
                for label, starts, size, scores, phrase in held.matches(held.ids(data)):
                    for at in range(0, len(starts), BATCH_MATCHES):
                        some = starts[at : at + BATCH_MATCHES]
                        same = lambda value, k: pa.array([value] * len(some), k)  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("doc_id").take(pa.array(np.full(len(some), i))), same(label, pa.string()),
                                pa.array(some.astype(np.int64)), same(size, pa.int64()),
                                pa.array(scores[at : at + BATCH_MATCHES]), same(phrase, pa.bool_()),
                            ],
                            ["doc_id", "label", "word", "words", "score", "base"],
                        )

    return source.mapInArrow(run, _MATCHES.format(kind))
