"""Language of words and documents by a linear-chain conditional random field.

A word's features are its first and last letters, its letter n-grams and, if it is in the lexicon of the training
words, the word itself. The chain's transitions are learned with the features, so a word that fits several
languages takes that of its neighbours and a text may change its language midway. Forward-backward gives each
word a probability for each language; a document's is the mean over its words.

Training takes stretches of documents with a known language and joins stretches at random into code-switched
sequences; it maximises the conditional likelihood of the words' languages.

Forward-backward runs over all words of a batch at once: the words stand in one line, a document's first word
forgets what came before it, the line is cut into pieces of ``PIECE`` words, the pieces' matrix products are
made side by side and chained, and then every piece is filled in from its ends.

Cases: a text that is null or has no letter is `und` with score 0, and so is every text where nothing could be
learned. Ties go to the language that is first by name. Repeated rows get equal results. A null doc_id is in
no fold and is not learned from. Very long texts are read whole, by one task each. With no documents there are no
rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.pretokens import chunks

#: The training sample: expected documents of a language, stretches of a document, words of a stretch.
DOCUMENTS, STRETCHES, STRETCH_WORDS = 300, 6, 24
#: Documents of a language times the square of the number of languages; up to ten languages lend ``DOCUMENTS`` each.
ROOM = 30_000
#: Numbers held at one time for the expected moves between words.
HELD = 4_000_000
#: A feature is used if so many different words have it; a word is in the lexicon if it was seen so often.
LEAST_WORDS, LEAST_SEEN = 2, 3
ROUNDS, RATE, RIDGE = 40, 0.15, 1e-4
PIECE = 64
CACHED = 400_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in lower case; none if it has no letter."""
    found = _WORD.findall((text or "").lower())
    return found if any(not w.isnumeric() or any(map(str.isalpha, w)) for w in found) else []


def features(word: str) -> list[str]:
    n = len(word)
    out = [f"={word}"]
    out += [f"<{word[:k]}" for k in range(1, min(n, 3) + 1)]
    out += [f">{word[-k:]}" for k in range(1, min(n, 4) + 1)]
    out += [word[i : i + 2] for i in range(n - 1)]
    out += [word[i : i + 3] for i in range(n - 2)]
    return out


def _scaled(x: np.ndarray, axes) -> np.ndarray:
    return x / x.max(axis=axes, keepdims=True)


def forward_backward(potentials: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward vectors and marginals of every word.

    potentials: exp of the words' scores, (n, k); first: whether a word begins a sequence; moves, start: exp of the
    transitions' and of the first word's scores.
    """
    n, k = potentials.shape
    rows = -(-n // PIECE)
    pad = rows * PIECE - n
    p = np.concatenate([potentials, np.ones((pad, k))]).reshape(rows, PIECE, k)
    f = np.concatenate([first, np.ones(pad, bool)]).reshape(rows, PIECE)
    ahead = np.broadcast_to(start, (k, k))

    def step(vectors: np.ndarray, j: int) -> np.ndarray:
        """(rows, m, k) forward over word j of every piece."""
        moved = vectors @ moves
        fresh = vectors.sum(axis=2, keepdims=True) * start
        return np.where(f[:, j, None, None], fresh, moved) * p[:, j, None, :]

    product = np.broadcast_to(np.eye(k), (rows, k, k))
    for j in range(PIECE):
        product = _scaled(step(product, j), (1, 2))
    enter, leave = np.empty((rows, k)), np.empty((rows, k))
    vector = np.full(k, 1.0 / k)
    for i in range(rows):
        enter[i] = vector
        vector = vector @ product[i]
        vector /= vector.sum()
    vector = np.ones(k)
    for i in range(rows - 1, -1, -1):
        leave[i] = vector
        vector = product[i] @ vector
        vector /= vector.sum()
    alpha, beta = np.empty((rows, PIECE, k)), np.empty((rows, PIECE, k))
    current = enter[:, None, :]
    for j in range(PIECE):
        current = _scaled(step(current, j), (1, 2))
        alpha[:, j] = current[:, 0]
    current = leave
    for j in range(PIECE - 1, -1, -1):
        beta[:, j] = current
        weighted = p[:, j] * current
        current = _scaled(np.where(f[:, j, None], weighted @ ahead.T, weighted @ moves.T), 1)
    alpha, beta = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]
    marginal = alpha * beta
    return alpha, beta, marginal / marginal.sum(axis=1, keepdims=True)


@dataclass
class Field:
    """A trained field. ``names`` are the languages; a worker remembers the scores of words."""

    names: list[str]
    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def scores(self, line: list[str]) -> np.ndarray:
        """Scores (n, languages) of words."""
        known, k = self.known, len(self.names)
        if self.table is None or len(known) > CACHED:
            known.clear()
            self.table = np.zeros((1024, k))
        new = [w for w in set(line) if w not in known]
        if new:
            get, flat, ends = self.index.get, [], []
            for w in new:
                flat += [i for f in features(w) if (i := get(f)) is not None]
                ends.append(len(flat))
            sums = np.concatenate([np.zeros((1, k)), np.cumsum(self.weights[np.array(flat, np.int64)], axis=0)])
            ends = np.array(ends)
            size = len(known)
            if size + len(new) > len(self.table):
                self.table = np.concatenate([self.table[:size], np.zeros((max(size, len(new)) + len(new), k))])
            self.table[size : size + len(new)] = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
            known.update(zip(new, range(size, size + len(new))))
        return self.table[np.fromiter(map(known.__getitem__, line), np.int64, len(line))]

    def marginals(self, line: list[str], first: np.ndarray) -> np.ndarray:
        scores = self.scores(line)
        potentials = np.exp(scores - scores.max(axis=1, keepdims=True))
        return forward_backward(potentials, first, np.exp(self.moves), np.exp(self.start))[2]


def train(stretches: list[tuple[str, list[str]]], seed: int = 7) -> Field:
    """Fit a field to (language, words) stretches."""
    names = sorted({lang for lang, _ in stretches})
    k = len(names)
    if not k:
        return Field([], {}, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    stretches = sorted(stretches)
    order = np.random.default_rng(seed).permutation(len(stretches))
    line, gold, first = [], [], []
    for place, i in enumerate(order):
        lang, found = stretches[i]
        line += found
        gold += [names.index(lang)] * len(found)
        first += [place % 3 == 0] + [False] * (len(found) - 1)  # three stretches are a sequence
    counts = Counter(line)
    vocabulary = {w: i for i, w in enumerate(counts)}
    at = np.array([vocabulary[w] for w in line])
    gold, first = np.array(gold), np.array(first)
    per_word = [[f for f in features(w) if not f.startswith("=") or counts[w] >= LEAST_SEEN] for w in vocabulary]
    seen = Counter(f for fs in per_word for f in set(fs))
    index: dict[str, int] = {}
    flat, owner = [], []
    for i, fs in enumerate(per_word):
        for f in fs:
            if f[0] == "=" or seen[f] >= LEAST_WORDS:
                flat.append(index.setdefault(f, len(index)))
                owner.append(i)
    flat, owner = np.array(flat, np.int64), np.array(owner, np.int64)
    w = [np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)]
    mean, square = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    inner = np.flatnonzero(~first)
    for step in range(1, ROUNDS + 1):
        per_label = [np.bincount(owner, w[0][flat, j], len(vocabulary)) for j in range(k)]
        scores = np.stack(per_label, axis=1)[at]
        potentials = np.exp(scores - scores.max(axis=1, keepdims=True))
        moves = np.exp(w[1])
        alpha, beta, marginal = forward_backward(potentials, first, moves, np.exp(w[2]))
        residual = -marginal
        residual[np.arange(len(gold)), gold] += 1
        by_word = [np.bincount(at, residual[:, j], len(vocabulary)) for j in range(k)]
        up = np.stack([np.bincount(flat, by_word[j][owner], len(index)) for j in range(k)], axis=1)
        pairs = np.zeros((k, k))
        for some in np.array_split(inner, -(-len(inner) * k * k // HELD) or 1):
            each = alpha[some - 1][:, :, None] * moves[None] * (potentials[some] * beta[some])[:, None, :]
            pairs += (each / each.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        kept = np.zeros((k, k))
        np.add.at(kept, (gold[inner - 1], gold[inner]), 1)
        for x, m, s, g in zip(w, mean, square, [up, kept - pairs, residual[first].sum(axis=0)]):
            g = g / len(gold) - RIDGE / 100 * x
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Field(names, index, *w)


def documents_of_each(languages: int) -> float:
    """Expected documents that each of so many languages lends to the fit. Training holds a number for each word and language, so this
    falls with the square of the languages; it is one at least."""
    return min(float(DOCUMENTS), max(1.0, ROOM / languages**2))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, lines = [], []
        for lang, text in zip(batch.column(0), batch.column(1)):
            found = words(text.as_py())
            pieces = [found[i : i + STRETCH_WORDS] for i in range(0, len(found), STRETCH_WORDS)]
            # any of a document's stretches, by the hash of its words
            pieces.sort(key=lambda p: zlib.crc32(" ".join(p).encode()))
            lines += pieces[:STRETCHES]
            langs += [lang.as_py()] * len(pieces[:STRETCHES])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(lines, pa.list_(pa.string()))], ["lang", "words"])


def fit(docs: DataFrame, folds: int = 4, fold: int = 2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Field:
    """Learn from the documents whose crc32(doc_id) mod ``folds`` is not ``fold`` and whose language is known."""
    rest = F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(folds)) != fold
    known = docs.filter(rest & F.col(lang).isNotNull())
    place = F.pmod(F.xxhash64(doc_id, F.lit(1)), F.lit(1_000_000))
    counts = known.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"), F.min(place).alias("first")).collect()
    if not counts:
        return train([])
    most = documents_of_each(len(counts))
    # the document of the least hash is always in, so no language is left out
    below = F.create_map(*[F.lit(x) for row in counts for x in (row.lang, max(most / row.n * 1_000_000, row.first + 0.5))])
    sample = known.filter(place < F.try_element_at(below, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    # one job over all partitions; the rows are bounded by the sample
    rows = sample.mapInArrow(_stretches, "lang string, words array<string>").collect()
    return train([(r.lang, list(r.words)) for r in rows])


def _batches(docs: DataFrame, model: Field, make, schema: str) -> DataFrame:
    """Apply ``make(ids, words by document, bounds, marginals, names)`` to runs of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in chunks(texts):
                found = [words(t) if m.names else [] for t in texts[begin:end]]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
                line = [w for x in found for w in x]
                marginals = np.zeros((0, len(m.names)))
                if line:
                    first = np.zeros(len(line), bool)
                    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
                    marginals = m.marginals(line, first)
                yield make(batch.column(0).slice(begin, end - begin), found, bounds, marginals, m.names)

    return docs.mapInArrow(run, schema)


def _predicted(ids: pa.Array, found: list[list[str]], bounds: np.ndarray, marginals: np.ndarray, names: list[str]) -> pa.RecordBatch:
    counts = np.diff(bounds)
    langs, scores = [UNKNOWN] * len(counts), np.zeros(len(counts))
    held = np.flatnonzero(counts)
    if len(held):
        means = np.add.reduceat(marginals, bounds[:-1][held], axis=0) / counts[held, None]
        best = means.argmax(axis=1)
        scores[held] = np.clip(means[np.arange(len(held)), best], 0, 1)
        for i, j in zip(held.tolist(), best.tolist()):
            langs[i] = names[j]
    return pa.RecordBatch.from_arrays([ids, pa.array(langs), pa.array(scores), pa.array(counts)], ["doc_id", "lang_pred", "score", "n_words"])


def _labelled(ids: pa.Array, found: list[list[str]], bounds: np.ndarray, marginals: np.ndarray, names: list[str]) -> pa.RecordBatch:
    best = marginals.argmax(axis=1) if len(names) else []
    labels = [[names[j] for j in best[a:b]] for a, b in zip(bounds, bounds[1:])]
    kind = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array(found, kind), pa.array(labels, kind)], ["doc_id", "words", "labels"])


def label_words(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, words, labels: the likeliest language of every word."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _batches(docs.select("doc_id", "text"), model, _labelled, f"doc_id {kind}, words array<string>, labels array<string>")


def predict(docs: DataFrame, model: Field, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _batches(docs.select("doc_id", "text"), model, _predicted, f"doc_id {kind}, lang_pred string, score double, n_words long")
    held = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(folds)) == fold
    return rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words")
