"""Tokens, packing, chat, languages and toxicity."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborlake.llm import bpe, chat, language, packing, toxicity
from arborlake.llm.pretokens import Recent, chunks

RANKS, VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
LETTERS = "abcdefgh the  \n\t 's 't'll'd!? 123½²éß中文🙂　\x1c\x85̀ⅷ'_"


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples(n=400):
    rng = random.Random(8)
    for _ in range(n):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(60)))
        yield text + "ab" * rng.randrange(300) + "a" * rng.randrange(200) if rng.random() < 0.1 else text


def test_encoder_agrees(reference):
    codec = bpe.codec(RANKS, PATTERN)
    for text in [*samples(), "x" * 20_000, "<|endoftext|>"]:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_long_piece_takes_linear_time(reference):
    ranks = bpe.codec(RANKS, PATTERN).ranks
    piece = "".join(random.Random(1).choice("abcdefghijklmnop") for _ in range(60_000)).encode()
    assert bpe.encode_bytes(piece, ranks) == reference._encode_bytes(piece)


def test_encoded_documents(edge_docs, edge_rows, no_docs, reference):
    want = Counter()
    for i, text, *_ in edge_rows:
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(edge_docs, RANKS, PATTERN).collect()) == want
    assert bpe.digests(no_docs, RANKS, PATTERN).collect() == []
    back = bpe.decode(bpe.encode(edge_docs.limit(5), RANKS, PATTERN), RANKS, PATTERN)
    assert all(bytes(r.bytes).decode() in {t or "" for _, t, *_ in edge_rows} for r in back.collect())


def test_memory_forgets_what_is_not_asked_for():
    held = Recent(3)
    held.remember({i: str(i) for i in range(4)}.items())
    assert held.look_up([0, 9]) == (["0", None], [1])
    held.remember({i: str(i) for i in range(10, 14)}.items())
    assert held.look_up([0, 1, 10]) == (["0", None, "10"], [1])


def test_chunks_cover_everything():
    texts = ["ab"] * 5 + [None, "x" * 50, ""]
    assert [x for a, b in chunks(texts, 5) for x in range(a, b)] == list(range(8))


def check_pieces(rows, documents, window=1024):
    """Pieces cover every id once, sequences are gapless and full but for the last."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = Counter((i, zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in documents)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.offset + r.length <= window and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        assert r.continues == (r.start > 0) and r.continued == (r.start + r.length < r.doc_tokens)
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or s == len(sequences) - 1
    got, current = Counter(), []
    # the pieces of a document follow each other in the sequences
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.start == len(current)
        current += r.ids
        if not r.continued:
            assert len(current) == r.doc_tokens
            got[r.doc_id, zlib.crc32(np.array(current, "<u4").tobytes())] += 1
            current = []
    assert got == want


def test_packed_documents(edge_docs, edge_rows, no_docs):
    check_pieces(packing.pieces(edge_docs, VOCABULARY, PATTERN).collect(), [r[:2] for r in edge_rows])
    added = [(1, "a<|endoftext|>b"), (2, "<|endoftext|>"), (3, " x <|endoftext|><|endoftext|>\n y <|endoftext"), (4, "plain")]
    assert packing.tokens(VOCABULARY, PATTERN).encode(["a<|endoftext|>b"]) == [np.array([64, 50256, 65], packing.tokens(VOCABULARY, PATTERN).kind).tobytes()]
    check_pieces(packing.pieces(edge_docs.sparkSession.createDataFrame(added, "doc_id long, text string"), VOCABULARY, PATTERN, window=5).collect(), added, 5)
    few = edge_docs.filter("n_chars < 200")
    check_pieces(packing.pieces(few, VOCABULARY, PATTERN, window=7).collect(), [r[:2] for r in edge_rows if r[4] < 200], 7)
    assert packing.pieces(no_docs, VOCABULARY, PATTERN).collect() == []


CONTROL = st.lists(st.sampled_from(["<", "|", "\\", "<|", "|>", "<|turn|>", "<|end|>", "<|chat|>", "<\\|end|>", "<|image:3|>", "a", "\n", "%", "%0A", "user"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(CONTROL, CONTROL), max_size=4))
def test_chat_reads_back(turns):
    formatted = chat.CHAT + "".join(chat.format_turn(role, [{"type": "text", "text": text}])[0] for role, text in turns)
    assert chat.read_chat(formatted) == turns


def test_typed_parts():
    parts = [
        {"type": "text", "text": "see <|ima"}, {"type": "text", "text": "ge:0|> "}, {"type": "image", "ref": "a.png", "tokens": 20},
        {"type": "audio", "ref": "b", "tokens": 7}, {"type": "image", "ref": None, "tokens": None}, {"type": "document", "ref": "d", "tokens": 1},
    ]
    formatted, attached = chat.format_turn("user", parts)
    assert formatted == "<|turn|>user\nsee <\\|image:0|> <|image:0|><|audio:0|><|image:1|><|document:0|><|end|>\n"
    assert attached == [("image", 0, "a.png", 20), ("audio", 0, "b", 7), ("image", 1, None, 0), ("document", 0, "d", 1)]
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<|end|>é"), (1, 2, "assistant", None), (None, 0, None, "x"), (2, None, "assistant", "late"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (3, 5, "assistant", "z" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digests(chat.turns(df.withColumn("parts", chat.text_parts(F.col("text"))))).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0)
    for conv, found in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order(r))), key=lambda r: r[0]):
        found = list(found)
        learnt = "".join(r[3] or "" for r in found if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(found), len(learnt))
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in found).encode()).hexdigest()
    parts = df.limit(0).withColumn("parts", chat.text_parts(F.col("text")))
    assert chat.digests(chat.turns(parts)).collect() == []


def test_attachments_of_turns(spark):
    df = spark.sql("select 1L conv_id, 0L turn, 'user' role, array(named_struct('type','image','text',null,'ref','r','tokens',5), named_struct('type','text','text','x','ref',null,'tokens',null)) parts")
    row = chat.turns(df).first()
    assert row.expanded_tokens == 5 and row.attachments[0].ref == "r" and row.loss_start == row.loss_end


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    k = 3
    for n in (1, 5, 63, 64, 130):
        first = rng.random(n) < 0.3
        first[0] = True
        potentials, moves, start = rng.random((n, k)) + 0.1, rng.random((k, k)) + 0.1, rng.random(k) + 0.1
        got = language.forward_backward(potentials, first, moves, start)[2]
        cuts = [*np.flatnonzero(first), n]
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 7:
                continue
            sums = np.zeros((b - a, k))
            for labels in itertools.product(range(k), repeat=b - a):
                p = start[labels[0]] * np.prod([potentials[a + i, y] for i, y in enumerate(labels)]) * np.prod([moves[x, y] for x, y in zip(labels, labels[1:])])
                for i, y in enumerate(labels):
                    sums[i, y] += p
            assert np.allclose(got[a:b], sums / sums.sum(1, keepdims=True))


def test_field_labels_code_switched_words(spark):
    rng = random.Random(2)
    en, de = "the and ing tion wor ther with ould".split(), "der und ung schaft keit ein nicht zu".split()
    word = lambda parts: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
    docs = [(i, " ".join(word(en if i % 2 else de) for _ in range(80)), "en" if i % 2 else "de") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.fit(frame)
    mixed = [" ".join([word(en) for _ in range(10)] + [word(de) for _ in range(10)] + [word(en) for _ in range(10)]) for _ in range(20)]
    rows = language.label_words(spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string"), model).collect()
    right = sum(a == b for r in rows for a, b in zip(r.labels, ["en"] * 10 + ["de"] * 10 + ["en"] * 10))
    assert right > 0.95 * 600
    again = language.fit(frame)
    assert np.array_equal(model.weights, again.weights)


def test_languages_of_odd_texts(spark, edge_docs, edge_rows, no_docs):
    rows = language.predict(edge_docs, language.fit(edge_docs)).collect()
    assert len(rows) == len(edge_rows)
    texts = defaultdict(set)
    for i, t, *_ in edge_rows:
        texts[i].add(t)
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if len(texts[r.doc_id]) == 1:
            (text,) = texts[r.doc_id]
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or "")))
    nothing = language.fit(no_docs)
    assert {r.lang_pred for r in language.predict(edge_docs, nothing).collect()} == {"und"}
    assert language.predict(no_docs, nothing).collect() == []
    assert language.words("12 ²③ Ⅷ") == []


def test_language_does_not_look_at_held_out_labels(edge_docs):
    other = edge_docs.withColumn("lang", F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, "zz").otherwise(F.col("lang")))
    a, b = language.fit(edge_docs), language.fit(other)
    assert a.names == b.names and np.array_equal(a.weights, b.weights)


def test_no_language_is_left_out(spark):
    """260 languages of one word each beside a frequent one."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = [a + b for a in letters[:10] for b in letters]
    rows = [(lang, f"{lang * 3} {lang * 4}") for lang in rare for _ in range(2)] + [("common", "the same words again")] * 500
    docs = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string")
    seen = {r.lang for r in docs.filter("crc32(cast(doc_id as string)) % 4 <> 2").select("lang").distinct().collect()}
    assert len(seen) > 200
    assert language.fit(docs).names == sorted(seen)
    assert [language.documents_of_each(n) for n in (1, 10, 20, 10_000)] == [300, 300, 75, 1]


def test_held_out_languages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() > 0.9 * got.count()


def test_block_maxima_find_the_nearest():
    rng = random.Random(6)
    vocabulary = {t: i for i, t in enumerate("abcdefghij")}
    rows = [{m: rng.randrange(1, 4) for m in rng.sample(range(10), rng.randrange(1, 5))} for _ in range(700)]
    index = toxicity.Index(vocabulary, np.array([1 + rng.random() for _ in range(10)]), np.zeros(700), list(range(700)), rows)
    vectors = np.zeros((700, 10))
    for i, row in enumerate(rows):
        for m, w in index.vector(row).items():
            vectors[i, m] = w
    for _ in range(60):
        counts = {m: rng.randrange(1, 5) for m in rng.sample(range(10), rng.randrange(1, 4))}
        query = np.zeros(10)
        for m, w in index.vector(counts).items():
            query[m] = w
        cosines = vectors @ query
        want = sorted(((-round(float(c), 9), i) for i, c in enumerate(cosines) if c > 0))
        # those that tie with the last one vote as well
        want = [x for x in want if x[0] <= want[: toxicity.NEIGHBOURS][-1][0]]
        assert index.nearest(counts) == [(-c, i) for c, i in want]


def test_all_tied_examples_vote():
    labels = np.array([0.0] * 12 + [1.0] * 36)
    index = toxicity.Index({"a": 0}, np.ones(1), labels, list(range(48)), [{0: 1}] * 48, 0.0)
    near = 1 / toxicity.LEAST_DISTANCE
    score, evidence = index.score("a")
    assert score == pytest.approx(36 * near / (48 * near + toxicity.PRIOR_WEIGHT))
    assert evidence == list(range(toxicity.NEIGHBOURS))


def test_document_frequencies_count_every_document(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red red", "red sky", None, "", "sky", "sea"] * 50)], "doc_id long, text string").repartition(7)
    got = toxicity._document_frequencies(docs, {"red": 0, "sky": 1, "unseen": 2})
    assert np.allclose(got, np.log(301 / np.array([101, 101, 1])) + 1)
    assert len(toxicity._document_frequencies(docs, {})) == 0
    assert np.allclose(toxicity._document_frequencies(docs.limit(0), {"red": 0}), [1.0])


def test_toxicity(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/../sf0.01/documents.parquet"), spark.read.parquet(f"{folder}/../sf0.01/labels.parquet")
    got = toxicity.scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert right > 0.9 * len(got) and all(r.predicted == (r.score >= 0.5) for r in got)
    other = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id", 5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert a.vocabulary == b.vocabulary and a.ids == b.ids and a.prior == b.prior


def test_toxicity_does_not_follow_the_sample(spark, monkeypatch):
    """Where one label is cut to a share of its rows, scores and prior stay those of the whole table."""
    rng, marks, rows = random.Random(8), "foul grim nast rank ugly vile".split(), []
    for i in range(4000):
        toxic = int(rng.random() < 0.1)
        mark = rng.random() < (0.6 if toxic else 0.05)
        rows.append((i, " ".join(rng.choice("one two six ten red sky".split()) for _ in range(8)) + f" {rng.choice(marks)}" * mark, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    found = []
    for most in (10_000, 400):
        monkeypatch.setattr(toxicity, "MAX_EXAMPLES", most)
        model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
        assert list(model.vocabulary) == marks
        found.append((model.prior, sum(model.score(t)[0] for _, t, _ in rows) / len(rows)))
    (prior, mean), (cut_prior, cut_mean) = found
    assert cut_prior == pytest.approx(prior, abs=0.015) and cut_mean == pytest.approx(mean, abs=0.03)


def test_votes_weigh_what_examples_stand_for():
    """Two equally near examples, one of which stands for nine labelled rows."""
    index = toxicity.Index({"a": 0}, np.ones(1), np.array([0.0, 1.0]), [1, 2], [{0: 1}, {0: 1}], 0.1, (9.0, 1.0))
    near = 1 / toxicity.LEAST_DISTANCE
    want = (near + toxicity.PRIOR_WEIGHT * 0.1) / (10 * near + toxicity.PRIOR_WEIGHT)
    assert index.score("a")[0] == pytest.approx(want)


def test_toxicity_of_odd_rows(spark, edge_docs, edge_rows, no_docs):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(3, 1, None), (None, 1, 1), (5, 1, 0), (10**9, 0, 1)], schema)
    rows = toxicity.scores(edge_docs, labels).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 for r in rows)
    nothing = toxicity.fit(edge_docs, spark.createDataFrame([], schema))
    assert toxicity.annotate(edge_docs, nothing).filter("score <> 0").count() == 0
    assert toxicity.annotate(edge_docs, nothing).columns[-2:] == ["score", "evidence"]
    kept = toxicity.reject(edge_docs, nothing)
    assert kept.columns == edge_docs.columns and kept.count() == len(edge_rows)
    assert toxicity.scores(no_docs, labels).collect() == []


def test_pieces_by_the_model_alone():
    """A new pre-token's ids are the file's, without its whole way to them; every byte has its letter."""
    from tokenizers.pre_tokenizers import ByteLevel

    assert sorted(packing.byte_letters()) == list(range(256)) and set(packing.byte_letters().values()) == set(ByteLevel.alphabet())
    tokens, whole = packing.Tokens(VOCABULARY, PATTERN), Tokenizer.from_file(VOCABULARY)
    texts = [" \u00e9t\u00e9 na\u00efve", "\x00\x01\x7f\x80\u00ad\u00ff", "\U0001f600\U0001f600 a", "   \n\n\t x", "\u4e2d\u6587 \u0441\u043b\u043e\u0432\u043e", "don't 12345 " + "q" * 3000, ""]
    tokens.tokenizer = None  # no text here holds an added token
    for text, ids in zip(texts, tokens.encode(texts)):
        assert np.frombuffer(ids, tokens.kind).tolist() == whole.encode(text, add_special_tokens=False).ids
