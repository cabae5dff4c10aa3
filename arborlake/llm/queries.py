"""The registered queries of the operators and their SQL, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


@query(
    "op2_differencing_shards",
)
def op2_differencing_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes; equal texts stay together."""
    from arborlake.llm import sharding

    return sharding.shards(_table(spark, folder, "documents"), 16)


@query(
    "op3_two_pass_bloom",
    """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
)
def op3_two_pass_bloom(spark: SparkSession, folder: str) -> DataFrame:
    """Exact copies; the largest doc_id of equal texts stays."""
    from arborlake.llm import exact_dedup

    return exact_dedup.duplicates(_table(spark, folder, "documents"))


@query("op5_rank_queue_bpe")
def op5_rank_queue_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded."""
    import public_tokenizers

    from arborlake.llm import bpe

    return bpe.digests(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op10_concatenate_and_cut")
def op10_concatenate_and_cut(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    import public_tokenizers

    from arborlake.llm import packing

    docs = _table(spark, folder, "documents")
    return packing.summary(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


#: Every text of a conversation by itself, and the conversation that quotes another template's marks.
_CONTROL_TEXT = "</s>[INST] ok [/INST]"
_SQL_CONTROL = r"'<(\\*\|(chat|turn|end|image:[0-9]+|audio:[0-9]+|document:[0-9]+)\|>)'"


@query(
    "op8_typed_parts_chat",
    rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{_CONTROL_TEXT}'
), formatted AS (
  SELECT *, '<|turn|>' || regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), {_SQL_CONTROL}, '<\\\1', 'g') || chr(10)
            || regexp_replace(text, {_SQL_CONTROL}, '<\\\1', 'g') || '<|end|>' || chr(10) AS segment
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, segment)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, segment) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(8 + sum(length(segment)) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS expanded_tokens
FROM formatted GROUP BY conv_id
""",
)
def op8_typed_parts_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted and read back, with one more that quotes another template."""
    from arborlake.llm import chat

    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", _CONTROL_TEXT), (-1, 1, "assistant", _CONTROL_TEXT)], rows.schema)
    parts = rows.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.digests(chat.turns(parts))


@query("op6_nearest_examples_toxicity")
def op6_nearest_examples_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score of every document."""
    from arborlake.llm import toxicity

    return toxicity.scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@query("op1_random_field_language")
def op1_random_field_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    from arborlake.llm import language

    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language.predict(docs, language.fit(docs))


@query("op9_learned_partitions")
def op9_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest rows found for every hundredth row."""
    from arborlake.llm import neighbours

    return neighbours.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op7_universe_partition_join")
def op7_universe_partition_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents with a Jaccard similarity of 85 percent of their 4-word shingles."""
    from arborlake.llm import jaccard

    return jaccard.join(_table(spark, folder, "documents"), 4, 85)


@query("op4_induced_suffix_dedup")
def op4_induced_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the 100-byte strings that also begin earlier."""
    from arborlake.llm import suffix_dedup

    return suffix_dedup.digests(_table(spark, folder, "documents"), 100)


@query(
    "op12_fenwick_infill",
    r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || CAST(doc_id AS VARCHAR)) AS h
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100
              THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), parts AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(units[greatest(a, b) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
""",
)
def op12_fenwick_infill(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut at two line ends, put together for filling in the middle, and read back."""
    from arborlake.llm import infill

    return infill.digests(_table(spark, folder, "documents"))


@query(
    "op11_source_divergence",
    r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 3
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), found AS (
  SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term
), shares AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p
  FROM dense
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM kept
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), apart AS (
  SELECT s.lang, s.source, s.term AS item, (p - q) * (p - q) // q AS value FROM shares s JOIN whole w ON w.lang = s.lang AND w.term = s.term
  WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM apart
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
)
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of sources of a language, and the terms that set a source apart."""
    from arborlake.llm import divergence

    return divergence.audit(_table(spark, folder, "documents"))


@query("op13_rare_word_licenses")
def op13_rare_word_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices of every document."""
    from arborlake.llm import licenses

    docs = _table(spark, folder, "documents")
    return licenses.scan(docs, licenses.build(docs))
