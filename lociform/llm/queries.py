"""The fixed queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociform.llm import chat, compression, decontamination, divergence, licenses, maxent, minhash, mixing, negatives, pii, rules, simhash, toxicity
from lociform.llm.common import fold, prepare, table


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what a reader finds in the formatted conversations, and of the text under the loss mask."""
    said = "</s>[INST] ok [/INST]"
    record = json.dumps({"messages": [{"role": role, "content": said} for role in ("user", "assistant")]})
    rows = chat.turn_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    told = spark.createDataFrame([(-1, record)], "conv_id long, record string")
    turns = rows.unionByName(told.select("conv_id", chat.canonical_turns(F.col("record")).alias("turns")))
    return chat.digests(chat.format_chats(turns))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
-- every backslash and every control string in a text adds one character; <|im_start|>, line feed, <|im_end|>, line feed: 24
e AS (
  SELECT *, length(text) + length(role) + 24 + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in which a benchmark item stands, with the item."""
    prepare(spark)
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    prepare(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    prepare(spark)
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by compressed sizes."""
    prepare(spark)
    documents = table(spark, sf_dir, "documents")
    model = compression.fit(documents, table(spark, sf_dir, "labels"))
    scored = compression.score(documents, model, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences declared in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the quality rules."""
    documents = table(spark, sf_dir, "documents")
    model = rules.fit(documents, table(spark, sf_dir, "labels"))
    return rules.judge(documents, model, ["doc_id"]).select("doc_id", *rules.BASE, "base_failed", "kept")


def op5_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the language model, beside that under token frequencies."""
    return maxent.score(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 1)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of base spans, and all spans."""
    found = pii.detect(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by character n-grams."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that tell each from its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, some labels moved by one."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and near-duplicate component of every document, at a similarity of 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')))) END AS s FROM w),
-- equal sets are one from here on
e AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT rep, n, unnest(s) AS g FROM e),
l AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep, rep AS c FROM e UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.rep AND r.c < u.b),
m AS (SELECT rep, min(c) AS c FROM r GROUP BY rep)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id, coalesce(m.c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN e ON e.s = s.s LEFT JOIN m ON m.rep = e.rep
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_license": op2_license,
    "op3_compression": op3_compression,
    "op4_rules": op4_rules,
    "op5_maxent": op5_maxent,
    "op6_pii": op6_pii,
    "op7_chat": op7_chat,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_divergence": op11_divergence,
    "op12_negatives": op12_negatives,
    "op13_minhash": op13_minhash,
}
SQL: dict[str, str] = {
    "op2_license": licenses.scan_sql(),
    "op7_chat": OP7_SQL,
    "op11_divergence": divergence.audit_sql(),
    "op12_negatives": negatives.NEGATIVES_SQL,
    "op13_minhash": OP13_SQL,
}
