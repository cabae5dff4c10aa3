"""Divergence of sources, filling in the middle, licence notices."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborlake.llm import divergence, infill, licenses, queries
from arborlake.llm.words import windows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- windows


@settings(max_examples=200, deadline=None)
@given(st.text("ab é\n", max_size=40), st.integers(1, 9))
def test_windows_cut_no_word(text, size):
    outside, data = re.compile(rb"[^a-z\x80-\xff]"), text.encode()
    pieces = list(windows(data, outside, size))
    assert b"".join(pieces) == data
    word = re.compile(rb"[a-z\x80-\xff]+")
    assert [w for p in pieces for w in word.findall(p)] == word.findall(data)


# --- op11


def audited(rows, min_docs=3, top=200):
    """rows of (text, lang, source) -> Counter of result rows, by the definition."""
    docs = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)) for t, _, _ in docs]
    out = Counter()
    for lang in {d[1] for d in docs}:
        here = [(w, d[2]) for w, d in zip(words, docs) if d[1] == lang]
        df, n_lang, n = Counter(), Counter(), defaultdict(Counter)
        for w, source in here:
            df.update(set(w))
            n_lang.update(w)
            n[source].update(w)
        kept = [t for t in df if df[t] >= min_docs]
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p, whole = {s: share(n[s]) for s in n}, share(n_lang)
        ranked = lambda found: sorted(found, key=lambda x: (-x[1], x[0].encode()))
        for s in p:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in p if o != s]
            terms = [(t, (p[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if n[s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", ranked(pairs)), ("term", ranked(terms)[:top])):
                out.update((lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found))
    return out


def sourced(seed=3, n=260):
    rng = random.Random(seed)
    words = ["River", "stone", "été", "中文字", "it's", "Ärger", "a-b", "x1y2", "ÀB", "k\x7fk", "zebra", "tea"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    rows = []
    for _ in range(n):
        source = rng.choice(["big", "big", "big", "s1", "s2", None, "", "σ"])
        rows.append((" ".join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "en", "de", None, "lonely"]), source))
    rows += [rows[0]] * 90 + [(rows[0][0], rows[0][1], "s1")] * 7 + [(rows[0][0], rows[0][1], f"only{i}") for i in range(4)]
    rows += [(None, "en", "textless"), ("", "xx", "a"), (None, "xx", "b"), ("123 !", "xx", None), ("Once", "yy", "a"), ("Long Long word " * 9000 + "é" * 5000, "en", "s2")]
    return rows


@pytest.mark.parametrize("partitions", [1, 7])
def test_divergence(spark, partitions):
    rows = sourced()
    clash = "text string, lang string, source string, n long, h string, term string, salt string, p string, kept string"
    docs = spark.createDataFrame([(*r, None, "h", "t", "s", "p", "k") for r in rows], clash).repartition(partitions)
    assert Counter(tuple(r) for r in divergence.audit(docs).collect()) == audited(rows)


def test_divergence_by_parameters(spark, monkeypatch):
    rows = sourced(4, 60)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = divergence.audit(docs, min_docs=1, top=3)
    assert Counter(tuple(r) for r in got.collect()) == audited(rows, 1, 3)
    assert divergence.audit(docs.limit(0)).collect() == []
    with monkeypatch.context() as patched:
        patched.setattr(divergence, "HELD_TERMS", 5)
        patched.setattr(divergence, "HELD_BYTES", 5)
        held, texts = divergence._Held(), [r for r in rows if r[0]][:20]
        parts = []
        for text, lang, source in texts:
            held.add(lang, text.encode(), {source: 2})
            if held.full():
                parts += held.hand_on()
        parts += held.hand_on()
    assert len(parts) > 5
    n, docs_with = Counter(), Counter()
    for b in parts:
        for lang, source, term, count, with_it in zip(*(c.to_pylist() for c in b.columns)):
            n[lang, source, term] += count
            docs_with[lang, source, term] += with_it
    want, want_docs = Counter(), Counter()
    for text, lang, source in texts:
        for term, count in divergence.terms(text.encode()).items():
            want[lang, source, term.decode()] += 2 * count
            want_docs[lang, source, term.decode()] += 2
    assert n == want and docs_with == want_docs


def test_shares_stay_exact_where_products_leave_64_bits(spark):
    rows = [(n, total) for total in (1, 7, 10**9, 10**15, 8 * 10**15 + 3) for n in (0, total // 3, total - 1)]
    df = spark.createDataFrame(rows, "n long, total long").withColumn("p", divergence._share(F.col("n"), F.col("total"), 3))
    for r in df.collect():
        assert r.p == 1 + 10**9 * (r.n + 1) // r.total


def test_equal_texts_are_tokenized_once(spark):
    """A text in many partitions and sources reaches the tokenizer in one run of rows."""
    docs = spark.createDataFrame([("same text", "en", f"s{i % 5}") for i in range(500)], "text string, lang string, source string").repartition(9)
    collapsed = docs.withColumn("h", F.xxhash64("text")).select("lang", "source", "text", "h").mapInArrow(divergence._collapse, divergence._TEXTS)
    assert collapsed.count() <= 9
    assert {(r.term, r.source, r.n, r.docs) for r in divergence.term_counts(docs).collect()} == {(t, f"s{i}", 100, 100) for t in ("same", "text") for i in range(5)}


def test_term_counts_are_shuffled_as_the_tasks_have_added_them_up(spark):
    """A task's counts are few rows of a term already; the first sum stands behind the shuffle."""
    docs = spark.createDataFrame([("same text", "en", "s")], "text string, lang string, source string")
    plan = divergence.term_counts(docs)._jdf.queryExecution().executedPlan().toString()
    sums = [line for line in plan.splitlines() if "HashAggregate" in line or "Exchange" in line]
    assert ["Aggregate" in line for line in sums] == [True, True, False, False]


def test_terms_of_a_language_are_counted_in_the_pass_that_keeps_them(spark, monkeypatch):
    """No table of terms is written beside that of the counts and joined with it."""
    written = {}

    def noted(df, label, *rest):
        written[label] = df
        return kept(df, label, *rest)

    kept = divergence.materialize
    monkeypatch.setattr(divergence, "materialize", noted)
    rows = sourced(5, 40)
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert Counter(tuple(r) for r in got.collect()) == audited(rows)
    cells = written["divergence-cells"]
    assert "Join" not in cells._jdf.queryExecution().executedPlan().toString()
    # every kept term of a language has one row that stands for it
    assert {r["count"] for r in cells.filter("first").groupBy("lang", "term").count().collect()} == {1}


# --- op12


def taken(doc_id, text, seed=7, percent=100, spm_percent=50):
    """(n, form, prefix, middle, suffix), by the definition."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    form = "plain" if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= percent else "spm" if h[3] % 100 < spm_percent else "psm"
    return len(units), form, "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])


LINES = st.lists(st.sampled_from(["\n", "a", "é", "🙂", "\n\n", "\r", "<", "<P", "long line "]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(LINES, st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(1, 9))
def test_cuts_by_descent(text, first, second, block):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((first % (len(units) + 1), second % (len(units) + 1)))
    want = len(units), len("".join(units[:a])), len("".join(units[a:b]))
    assert infill.cut(np.frombuffer(text.encode(), np.uint8), first, second, block) == want


def test_fenwick_sums():
    counts = np.arange(1, 38)
    tree = infill.fenwick(counts)
    for k in range(38):
        assert infill.Blocks._before(tree, k) == counts[:k].sum()


def test_infilled_documents(spark, edge_docs, edge_rows, no_docs):
    more = [(900 + i, t) for i, t in enumerate(["a<S>b\nc", "<P>", "no end\nof line", "\n", "\n\n\n", "é\n🙂 x\n" * 3000, "<", "x<M\n>", "one"])]
    both = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [r[:2] for r in edge_rows] + more
    for percent, spm in ((100, 50), (60, 0), (0, 50)):
        want = Counter()
        for doc_id, text in rows:
            n, form, prefix, middle, suffix = taken(doc_id, text or "", 7, percent, spm)
            output = {"plain": text or "", "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
            plain = form == "plain"
            want[doc_id, n, form, None if plain else len(prefix), None if plain else len(middle), sha(output), sha(text or "")] += 1
        assert Counter(tuple(r) for r in infill.digests(both, 7, percent, spm).collect()) == want
    assert {"psm", "spm", "plain"} == {taken(i, t or "")[1] for i, t in rows}
    assert infill.digests(no_docs).collect() == []
    clashing = edge_docs.withColumnRenamed("h", "h1").withColumnRenamed("c0", "cuts").withColumnRenamed("kind", "form").withColumn("digest", F.lit("x"))
    assert infill.transform(clashing).count() == len(edge_rows)


def test_marks_that_could_arise_by_themselves_are_refused(no_docs):
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "[S]", "<M>"), ("<P<", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.transform(no_docs, marks=marks)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_fenwick_infill"])
def test_queries_against_sql(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = con.execute(queries.ORACLES[name])
    assert [c[0] for c in found.description] == df.columns
    assert Counter(map(tuple, df.collect())) == Counter(found.fetchall())


# --- op13


def all_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def base_of(text):
    """(words, {label: places}), by the definition."""
    words = all_words(text)
    found = {}
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        found[label] = [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
    return words, found


def noticed(words, notice, df, n_docs):
    """The greatest score of a notice in a document, None if it does not stand there: every beginning tried in turn."""
    ids, slack = all_words(notice.text), licenses.SLACK + len(all_words(notice.text)) // licenses.SLACK_WORDS
    rare = sorted(set(ids), key=lambda w: (df[w], w.encode()))[: licenses.RARE]
    idf = {w: math.log((1 + n_docs) / (1 + df[w])) + 1 for w in rare}
    begins = {w: {p - k for p, x in enumerate(words) if x == w for k, y in enumerate(ids) if y == w} for w in rare}
    best = None
    for start in sorted(set().union(*begins.values())):
        near = [w for w in rare if any(start + d in begins[w] for d in range(slack + 1))]
        if 100 * len(near) < licenses.AGREE_PERCENT * len(rare):
            continue
        inside = [k.split() for k in notice.keys]
        ends = start + len(ids) + slack
        if all(any(words[p : p + len(k)] == k for p in range(max(0, start - slack), min(len(words), ends) - len(k) + 1)) for k in inside):
            best = max(best or 0.0, sum(idf[w] for w in near) / sum(idf.values()))
    return best


def licensed(seed=5):
    rng = random.Random(seed)
    filler = "the of river and stone license public under software version to this is by permission free all rights cc general".split()
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = [prose(rng.randrange(60)) for _ in range(40)]
    for notice in licenses.NOTICES:
        words = notice.text.split()
        put_in = list(words)
        for _ in range(3):
            put_in.insert(rng.randrange(len(put_in) + 1), "Foo")
        left_out = [w for w in words if rng.random() < 0.8]
        texts += [f"{prose(9)} {' '.join(x)} {prose(9)}" for x in (words, put_in, left_out)] + [notice.text.upper()]
    texts += ["CC BY", "cc-by cc_by", "cc by cc by cc", "General  Public\nLicense", "all rights  reserved. All Rights Reserved!", "all right reserved", "éall rights reserved", "cc 1by", None, "", "...", "license " * 4000]
    return [(i % 90, t) for i, t in enumerate(texts)] + [(None, "cc by"), (None, None)]


def test_licences(spark):
    rows = licensed()
    clash = "doc_id long, text string, ids string, word string, labels string, n_words string"
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], clash).repartition(3)
    index = licenses.build(docs)
    df = Counter(w for _, t in rows for w in set(all_words(t)))
    want = Counter()
    for doc_id, text in rows:
        words, base = base_of(text)
        places = [p for found in base.values() for p in found]
        labels, score = {label for label, found in base.items() if found}, 1.0 if places else 0.0
        kept = ",".join(sorted(labels))
        for notice in licenses.NOTICES:
            if (found := noticed(words, notice, df, len(rows))) is not None:
                labels.add(notice.label)
                score = max(score, found)
        want[doc_id, len(words), len(places), min(places, default=None), max(places, default=None), kept, ",".join(sorted(labels)), round(score, 9)] += 1
    got = Counter((*tuple(r)[:-1], round(r.score, 9)) for r in licenses.scan(docs, index).collect())
    assert got == want
    assert {n.label for n in licenses.NOTICES} <= {x for r in want for x in r[6].split(",")}
    assert licenses.scan(docs.limit(0), index).collect() == []
    empty = licenses.build(docs.limit(0))
    assert licenses.scan(docs.filter("text = 'CC BY'"), empty).collect()[0].base_labels == "cc-by"


def test_places(spark):
    docs = spark.createDataFrame([(1, "cc by x cc by"), (2, "All rights reserved. Released under the MIT License"), (3, "nothing")], "doc_id long, text string")
    got = sorted((r.doc_id, r.label, r.word, r.words, r.base) for r in licenses.matches(docs, licenses.build(docs)).collect())
    assert got == [(1, "cc-by", 0, 2, True), (1, "cc-by", 3, 2, True), (2, "mit", 3, 5, False), (2, "reserved", 0, 3, True)]


def test_base_places_over_the_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = Counter()
    for r in docs.collect():
        words, base = base_of(r.text)
        places = [p for found in base.values() for p in found]
        want[r.doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(x for x in base if base[x]))] += 1
    got = queries.QUERIES["op13_rare_word_licenses"](spark, folder).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert Counter(map(tuple, got.collect())) == want
