"""How far the sources of a language are apart in their words, and which words set a source apart.

Equal texts of a language are collapsed before anything is tokenized: each batch sends one row for each text
with its sources and their multiplicities, the rows of a text meet, and its terms are counted once, then added
to every source by weight. Weighted document frequencies pick the kept terms of a language.

Two sources are compared without the terms that neither of them has: what a source adds against a source that
lacks its terms depends on their counts alone, and is summed over the few distinct counts; only terms that both
have are joined, for the difference.

Cases: null texts, languages and sources are ''. Rows that repeat an id, or have none, are documents like any
other. Groups without terms count like those whose counts are all 0; a language without kept terms has pairs of
value 0 and no terms. Ties are ranked by the bytes of the item. Long texts are tokenized window by window. An
empty table gives an empty result; other columns are ignored, whatever their names. Arithmetic is exact in 64
bits for languages of fewer than 10**8 kept terms and 9 * 10**15 occurrences; beyond, Spark reports an overflow.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.words import windows
from arborlake.storage import materialize

#: Documents of a language that a kept term needs; steps of 10**3 in the scale of a share; ranks of terms.
MIN_DOCS, THOUSANDS, TOP = 3, 3, 200
#: Distinct terms, and bytes of them, that a task holds before it hands them on.
HELD_TERMS, HELD_BYTES = 500_000, 32 << 20
#: A language's groups are dealt over so many sub-keys where they meet others of the language.
SALTS = 16

_TERM, _OUTSIDE = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
_TEXTS = "lang string, h long, text string, sources array<string>, counts array<long>"
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: bytes) -> Counter:
    """Runs of letters and of code points beyond ASCII; only A to Z are lower-cased."""
    found: Counter = Counter()
    for piece in windows(text.lower(), _OUTSIDE):
        found.update(_TERM.findall(piece))
    return found


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of a batch, with its sources and how often each has it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        same = pa.Table.from_batches([batch]).group_by(["lang", "h", "text", "source"]).aggregate([([], "count_all")])
        listed = same.group_by(["lang", "h", "text"]).aggregate([("source", "list"), ("count_all", "list")])
        yield from listed.rename_columns(["lang", "h", "text", "sources", "counts"]).to_batches()


class _Held:
    """Counts on their way out of a task."""

    def __init__(self):
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.terms = self.bytes = 0

    def add(self, lang: str, text: bytes, weights: dict[str, int]) -> None:
        found = terms(text)
        for source, weight in weights.items():
            counts, docs = self.groups.setdefault((lang, source), (Counter(), Counter()))
            before = len(docs)
            docs.update(found.keys() if weight == 1 else dict.fromkeys(found, weight))
            counts.update(found if weight == 1 else {t: n * weight for t, n in found.items()})
            self.terms += len(docs) - before
            # an upper bound: terms that were there already are counted again
            self.bytes += sum(map(len, found)) if len(docs) > before else 0

    def full(self) -> bool:
        return self.terms > HELD_TERMS or self.bytes > HELD_BYTES

    def hand_on(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in self.groups.items():
            found = list(counts)
            for at in range(0, len(found), 20_000):
                some = found[at : at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array([t.decode() for t in some]),
                        pa.array([counts[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
        self.__init__()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their texts: equal texts follow each other and are tokenized once."""
    held, current, weights = _Held(), None, {}
    for batch in batches:
        for lang, text, sources, counts in zip(*(batch.column(c) for c in ("lang", "text", "sources", "counts"))):
            key = lang.as_py(), text.as_buffer().to_pybytes()
            if key != current:
                if current:
                    held.add(*current, weights)
                    if held.full():
                        yield from held.hand_on()
                current, weights = key, {}
            for source, n in zip(sources.as_py(), counts.as_py()):
                weights[source] = weights.get(source, 0) + n
    if current:
        held.add(*current, weights)
    yield from held.hand_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it), from lang, source and text."""
    hashed = docs.select("lang", "source", "text", F.xxhash64("text").alias("h"))
    collapsed = hashed.mapInArrow(_collapse, _TEXTS).repartition("lang", "h").sortWithinPartitions("lang", "h", "text")
    # tasks have added up their terms already: to sum once more before the shuffle would only cost time
    counted = collapsed.mapInArrow(_count, _COUNTS).repartition("lang", "source", "term")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, thousands: int) -> Column:
    """1 + floor(1000**thousands * (n + 1) / total) by long division, so that no step leaves 64 bits."""
    quotient, rest = F.lit(0).cast("long"), n + 1
    for _ in range(thousands):
        quotient = quotient * 1000 + _whole(rest * 1000, total)
        rest = rest * 1000 % total
    return quotient + 1


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _apart(p: Column, q: Column) -> Column:
    return _whole((p - q) * (p - q), q)


def _salted(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))


def _repeated(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, thousands: int = THOUSANDS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language with the sum of floor((p - q)**2 / q) over the kept terms, p
    the share of a term in the source, q that in the other. Part ``term``: the first ``top`` terms of the source
    whose share is above that in the whole language.
    """
    empty = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    # a term's sources side by side: its sums, and one of its rows that stands for it
    by_source = Window.partitionBy("lang", "term").orderBy("source")
    of_term = by_source.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = term_counts(rows).select(
        "lang", "source", "term", "n", F.sum("n").over(of_term).alias("n_lang"), F.sum("docs").over(of_term).alias("docs"), (F.row_number().over(by_source) == 1).alias("first")
    )
    cells = materialize(counts.filter(F.col("docs") >= min_docs).drop("docs"), "divergence-cells")
    sizes = cells.filter("first").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("n_lang"))

    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0).cast("long"))
    total = lambda n: F.greatest(zero(n) + zero("kept"), F.lit(1).cast("long"))
    groups = (
        rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
        .select("lang", "source", zero("kept").alias("kept"), zero("held").alias("held"), total("n").alias("total"), total("n_lang").alias("total_lang"))
    )
    groups = materialize(groups.withColumn("base", _share(F.lit(0).cast("long"), F.col("total"), thousands)), "divergence-groups")

    shares = cells.join(groups.select("lang", "source", "total", "total_lang", "base"), ["lang", "source"])
    shares = shares.withColumn("p", _share(F.col("n"), F.col("total"), thousands))
    shares = shares.withColumn("q", _share(F.col("n_lang"), F.col("total_lang"), thousands))
    shares = materialize(shares.select("lang", "source", "term", "base", "p", "q"), "divergence-shares")

    return _ranked(_pairs(groups, shares), "pair").unionByName(_ranked(_terms(shares), "term", top))


def _ranked(values: DataFrame, part: str, top: int | None = None) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = values.withColumn("rank", F.row_number().over(by))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _terms(shares: DataFrame) -> DataFrame:
    above = shares.filter(F.col("p") > F.col("q"))
    return above.select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Sum over all kept terms for each ordered pair of sources of a language."""
    one = groups.select("lang", "source", "kept", "held", "base")
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"))
    differ = F.col("source") != F.col("item")
    base, other_base, p = F.col("base"), F.col("other_base"), F.col("p")

    # terms that the source lacks, as if the other lacked them too
    met = _salted(one, "source").join(_repeated(other), ["lang", "salt"]).filter(differ)
    lacking = met.select("lang", "source", "item", ((F.col("kept") - F.col("held")) * _apart(base, other_base)).alias("v"))
    # terms that the source has, as if the other lacked them; then terms of the other, as if the source lacked them
    distinct = materialize(shares.groupBy("lang", "source", "base", "p").agg(F.count(F.lit(1)).alias("k")), "divergence-distinct")
    having = _salted(distinct, "source", "p").join(_repeated(other), ["lang", "salt"]).filter(differ)
    having = having.select("lang", "source", "item", (F.col("k") * _apart(p, other_base)).alias("v"))
    theirs = distinct.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"), F.col("p").alias("other_p"), "k")
    theirs = _salted(theirs, "item", "other_p").join(_repeated(one.select("lang", "source", "base")), ["lang", "salt"]).filter(differ)
    theirs = theirs.select("lang", "source", "item", (F.col("k") * (_apart(base, F.col("other_p")) - _apart(base, other_base))).alias("v"))
    # terms of both, in place of the two guesses
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("base").alias("other_base"), F.col("p").alias("other_p"))
    both = shares.select("lang", "term", "source", "base", "p").join(right, ["lang", "term"]).filter(differ)
    q = F.col("other_p")
    both = both.select(
        "lang", "source", "item", (_apart(p, q) - _apart(p, other_base) - _apart(base, q) + _apart(base, other_base)).alias("v")
    )
    parts = lacking.unionByName(having).unionByName(theirs).unionByName(both)
    return parts.groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))
