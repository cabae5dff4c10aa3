"""Toxicity by the nearest labelled examples.

A text is a TF-IDF vector over *marks*: words, and beginnings of longer words, that come with label 1 more often
than chance allows. The labelled examples stand in an inverted index cut into blocks; every mark knows the largest
weight of each block. A query visits the blocks by falling upper bound and stops when no block can hold a
nearer example than those found, so the nearest by cosine are exact. They vote with weights by distance,
against a prior vote of the labelled texts without marks; the examples are the evidence.

The vocabulary and the examples come from a sample of the labelled rows, of ``MAX_EXAMPLES`` expected rows for
each label. Labels are sampled by shares of their own, so in votes and prior an example counts for as many labelled rows
of its label as one sampled row stands for. Document frequencies are counted over all documents.

Cases: a null or empty text has no marks and gets the prior. With no labelled row the prior is 0. Several labels
of one document count by their mean (1 from a half on); null labels are ignored. Repeated rows get equal scores.
Examples that tie with the last of the ``NEIGHBOURS`` nearest vote as well; the evidence names the first of them by example
number. Very long texts are read whole, by one task each. With no documents there are no rows. Other columns are carried
by ``annotate``.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample and of the vocabulary, and the length of a word's beginning.
MAX_EXAMPLES = 6_000
MAX_MARKS = 512
PREFIX = 5
#: A mark stands in at least so many examples, and so many times as often in those of label 1.
LEAST_EXAMPLES, LEAST_RATIO = 3, 2.0
NEIGHBOURS = 12
BLOCK = 64
#: Weight of the prior against the votes, and the least distance.
PRIOR_WEIGHT, LEAST_DISTANCE = 0.5, 0.05
CACHED = 20_000

_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> list[str]:
    """Words of a text, and the beginnings of words longer than ``PREFIX`` with a star."""
    words = _WORD.findall((text or "").lower())
    return words + [w[:PREFIX] + "*" for w in words if len(w) > PREFIX]


@dataclass
class Index:
    """Vectors of the examples as postings by mark, with block maxima."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    labels: np.ndarray
    ids: list
    rows: list[dict[int, int]]
    prior: float = 0.0
    #: Labelled rows for each example of label 0 and of label 1.
    stands_for: tuple[float, float] = (1.0, 1.0)
    cache: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.words = {t: i for t, i in self.vocabulary.items() if not t.endswith("*")}
        self.prefixes = {t[:-1]: i for t, i in self.vocabulary.items() if t.endswith("*")}
        n, v = len(self.rows), len(self.idf)
        self.blocks = -(-n // BLOCK)
        lists: list[list[tuple[int, float]]] = [[] for _ in range(v)]
        for i, row in enumerate(self.rows):
            for mark, weight in self.vector(row).items():
                lists[mark].append((i, weight))
        self.postings, self.starts = [], []
        self.maxima = np.zeros((v, self.blocks))
        for mark, items in enumerate(lists):
            at = np.array([i for i, _ in items], np.int64)
            weights = np.array([w for _, w in items])
            np.maximum.at(self.maxima[mark], at // BLOCK, weights)
            self.postings.append((at, weights))
            self.starts.append(np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK))

    def count(self, text: str | None) -> dict[int, int]:
        """How often each mark stands in a text."""
        words, prefixes, out = self.words, self.prefixes, {}
        for word in _WORD.findall((text or "").lower()):
            if word in words:
                out[words[word]] = out.get(words[word], 0) + 1
            if len(word) > PREFIX and (start := word[:PREFIX]) in prefixes:
                out[prefixes[start]] = out.get(prefixes[start], 0) + 1
        return out

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {m: (1 + math.log(n)) * float(self.idf[m]) for m, n in sorted(counts.items())}
        length = math.sqrt(sum(x * x for x in raw.values()))
        return {m: x / length for m, x in raw.items()} if length else {}

    def nearest(self, counts: dict[int, int], k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine and all that tie with the k-th, as (cosine, example), ties in order of examples."""
        query = self.vector(counts)
        if not query or not self.blocks:
            return []
        bounds = sum(weight * self.maxima[mark] for mark, weight in query.items())
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bounds, kind="stable").tolist():
            # a little slack: a bound and a cosine are rounded apart
            if bounds[block] <= 0 or len(best) >= k and bounds[block] < best[k - 1][0] - 1e-9:
                break
            sums = np.zeros(BLOCK)
            for mark, weight in query.items():
                at, weights = self.postings[mark]
                first, last = self.starts[mark][block], self.starts[mark][block + 1]
                sums[at[first:last] - block * BLOCK] += weight * weights[first:last]
            found = np.flatnonzero(sums > (best[k - 1][0] - 1e-9 if len(best) >= k else 0))
            if len(found):
                best += [(round(float(sums[i]), 9), block * BLOCK + int(i)) for i in found]
                best.sort(key=lambda x: (-x[0], x[1]))
                if len(best) > k:
                    del best[bisect.bisect_right(best, -best[k - 1][0], key=lambda x: -x[0]) :]
        return best

    def score(self, text: str | None) -> tuple[float, list]:
        """Probability of label 1, and the ids of the nearest ``NEIGHBOURS`` examples that it rests on; those tied with the last vote too."""
        counts = self.count(text)
        if not counts:
            return self.prior, []
        key = tuple(sorted(counts.items()))
        if key not in self.cache:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            votes = weights = 0.0
            found = self.nearest(counts)
            for cosine, i in found:
                weight = self.stands_for[int(self.labels[i])] / (LEAST_DISTANCE + 1 - cosine)
                votes += weight * self.labels[i]
                weights += weight
            self.cache[key] = ((votes + PRIOR_WEIGHT * self.prior) / (weights + PRIOR_WEIGHT), [self.ids[i] for _, i in found[:NEIGHBOURS]])
        return self.cache[key]


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(folds)) == fold


def _labelled(docs: DataFrame, labels: DataFrame, folds: int, fold: int) -> tuple[DataFrame, tuple[float, float]]:
    """doc_id, toxic, text of a sample of the labelled rows outside the fold; labelled rows for each sampled one of either label."""
    marked = (
        labels.filter(F.col("toxic").isNotNull() & ~held_out("doc_id", folds, fold))
        .groupBy("doc_id")
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    )
    counts = {row.toxic: row["count"] for row in marked.groupBy("toxic").count().collect()}
    # a hash below the share that makes MAX_EXAMPLES of the label's rows
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, MAX_EXAMPLES / n))).otherwise(share)
    sampled = marked.filter(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) < share * 1_000_000)
    taken = counts
    if max(counts.values(), default=0) > MAX_EXAMPLES:
        taken = {row.toxic: row["count"] for row in sampled.groupBy("toxic").count().collect()}
    texts = docs.select("doc_id", "text").join(F.broadcast(sampled), "doc_id")
    # rows that repeat a doc_id: one of them, the same one always
    # few bytes but much work: one part for each of the session's shuffle partitions
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")).repartition(parts)
    return sample, tuple(counts[label] / taken[label] if taken.get(label) else 1.0 for label in (0, 1))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch: every term with its number of texts of label 1 and of label 0."""
    for batch in batches:
        found: tuple[Counter, Counter] = Counter(), Counter()
        for text, toxic in zip(batch.column(0), batch.column(1)):
            found[toxic.as_py()].update(set(terms(text.as_py())))
        names = sorted(found[0] | found[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *[pa.array([found[label][t] for t in names], pa.int64()) for label in (1, 0)]], ["term", "a", "b"]
        )


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> Index:
    """Learn from the labelled documents whose crc32(doc_id) mod ``folds`` is not ``fold``."""
    sample, stands_for = _labelled(docs, labels, folds, fold)
    sample = sample.persist()
    n = {row.toxic: row["count"] for row in sample.groupBy("toxic").count().collect()}
    positive, negative = n.get(1, 0), n.get(0, 0)
    total = positive + negative
    marks: list[str] = []
    if positive and negative:
        counted = (
            sample.select("text", F.col("toxic").cast("long"))
            .mapInArrow(_term_rows, "term string, a long, b long")
            .groupBy("term")
            .agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
            .filter(F.col("a") + F.col("b") >= LEAST_EXAMPLES)
        )
        a, b = F.col("a"), F.col("b")
        odd = a * (negative - b) - b * (positive - a)
        chi = total * odd * odd / (F.lit(float(positive) * negative) * (a + b) * F.greatest(total - a - b, F.lit(0.5)))
        # a chance of 1 in 20 that any of the terms gets so far by itself
        least = 2 * math.log(max(counted.count(), 1) / 0.05)
        rows = counted.withColumn("chi", chi).filter((F.col("chi") > least) & (a / positive > LEAST_RATIO * b / negative))
        marks = [row.term for row in rows.orderBy(F.desc("chi"), "term").limit(MAX_MARKS).collect()]
    vocabulary = {t: i for i, t in enumerate(sorted(marks))}
    idf = _document_frequencies(docs, vocabulary)
    counter = Index(vocabulary, idf, np.zeros(0), [], [])
    examples = sorted(_counted(sample, counter), key=lambda r: (max(r[2], key=lambda m: (idf[m], m), default=-1), r[0] is not None, r[0]))
    bare = [toxic for _, toxic, counts in examples if not counts]
    held = [e for e in examples if e[2]]
    # weighed back to the shares of all labelled rows
    whole = (negative * stands_for[0], positive * stands_for[1])
    plain, marked = (len(bare) - sum(bare)) * stands_for[0], sum(bare) * stands_for[1]
    prior = (marked + 0.5 * whole[1] / sum(whole)) / (plain + marked + 0.5) if total else 0.0
    sample.unpersist()
    return Index(vocabulary, idf, np.array([t for _, t, _ in held], float), [i for i, _, _ in held], [c for _, _, c in held], prior, stands_for)


def _counted(sample: DataFrame, counter: Index) -> list[tuple]:
    """doc_id, toxic and mark counts of the sample: at most so many numbers as the bounds allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([list(c) for c in counts], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
                ["doc_id", "toxic", "marks", "times"],
            )

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id {kind}, toxic int, marks array<int>, times array<int>").collect()
    return [(r.doc_id, r.toxic, dict(zip(r.marks, r.times))) for r in rows]


def _document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """Smoothed idf of the marks over all documents. Tasks count, Spark adds up; the driver gets a row for each mark."""
    size = len(vocabulary)
    counter = Index(vocabulary, np.ones(size), np.zeros(0), [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the place after the marks counts the documents
        found = np.zeros(size + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found[[*counter.count(text.as_py()), size]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1), pa.int64()), pa.array(found)], ["mark", "found"])

    found = np.zeros(size + 1)
    for row in docs.select("text").mapInArrow(run, "mark long, found long").groupBy("mark").agg(F.sum("found").alias("found")).collect():
        found[row.mark] = row.found
    return np.log((1 + found[size]) / (1 + found[:size])) + 1


def annotate(docs: DataFrame, model: Index, text: str = "text", score: str = "score", evidence: str = "evidence") -> DataFrame:
    """``docs`` with a score from 0 to 1 and the ids of the examples behind it. Columns that already have these
    names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(f"`{text}`"), *[F.col(f"`{n}`") for n in docs.columns if n not in (text, score, evidence)])
    names = [*source.columns, score, evidence]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([s for s, _ in found], pa.float64()), pa.array([[str(x) for x in e] for _, e in found], pa.list_(pa.string()))],
                names,
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    kept = [n for n in docs.columns if n not in (score, evidence)]
    return source.mapInArrow(run, f"{kinds}, `{score}` double, `{evidence}` array<string>").select(*[F.col(f"`{n}`") for n in (*kept, score, evidence)])


def reject(docs: DataFrame, model: Index, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``least``, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py())[0] < least for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def scores(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (doc_ids of the nearest examples) of every document."""
    scored = annotate(docs.select("doc_id", "text"), fit(docs, labels, folds, fold))
    return scored.select(
        "doc_id", F.coalesce(held_out("doc_id", folds, fold), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )
