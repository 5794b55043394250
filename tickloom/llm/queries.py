"""The registered query of each operator, over the whole of its table, and the SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, chat, jaccard, kneser_ney, langid, lines, mixing, neardup_vectors, pii, rules
from tickloom.session import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars", "copy", "slot")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    of = F.transform("base", lambda s: s["kind"])
    n = [(F.size("base") - F.size(F.array_remove(of, k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *n, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kneser_ney.classify(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    own_id = F.when(F.col("_doc") != kneser_ney.LEAST, F.col("_doc")).alias("doc_id")
    return found.select(own_id, F.col("_lang").alias("lang"), "n_chars", "perplexity", "threshold", "kept")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.link(table(spark, sf_dir, "embeddings"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.learn(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_spans")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.learn_and_apply(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.format_and_read(rows.unionByName(probe), BYTE_BPE).drop("n_tokens")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


#: Connected components of `links` (a, b both ways) over `nodes` (id), as `comps` (id, component_id).
COMPONENTS = """, reach AS (
  SELECT id, id AS other FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
), comps AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
JACCARD_SQL = f"""WITH RECURSIVE words AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^ \\t\\n\\v\\f\\r]+') AS w FROM documents
), nodes AS (SELECT id FROM words), shingles AS (
  SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id), common AS (
  SELECT x.id AS a, y.id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
){COMPONENTS}
SELECT id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM comps LEFT JOIN sizes USING (id)"""
VECTORS_SQL = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), links AS (
  SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.id <> y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.95
){COMPONENTS}
SELECT id AS vec_id, CAST(count(l.b) AS BIGINT) AS n_links, component_id, id = component_id AS kept FROM comps LEFT JOIN links l ON l.a = id GROUP BY id, component_id"""
ANY_CONTROL = "|".join(re.escape(c).replace("'", "''") for c in sorted(chat.CONTROL, key=len, reverse=True))
CHAT_SQL = f"""WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, len(regexp_extract_all(role || chr(1) || text, '{chat.E}')) + 2 * len(regexp_extract_all(role || chr(1) || text, '{ANY_CONTROL}')) AS escapes FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({sum(map(len, chat.MARKS))} + length(role) + length(text) + escapes) AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op3_quality": op3_quality, "op4_jaccard": op4_jaccard, "op5_lines": op5_lines, "op2_pii": op2_pii, "op6_vectors": op6_vectors, "op7_langid": op7_langid, "op8_rules": op8_rules, "op9_chat": op9_chat, "op10_bpe": op10_bpe}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE, "op4_jaccard": JACCARD_SQL, "op5_lines": lines.ORACLE, "op6_vectors": VECTORS_SQL, "op9_chat": CHAT_SQL}
