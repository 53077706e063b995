"""Queries over the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.bpe import encode_documents
from vellum.llm.chat import format_conversations, read_back, reply_trees
from vellum.llm.classifier import classify_documents
from vellum.llm.common import table
from vellum.llm.merkle import folded, leaf_digest, merkle_manifest, proof_digest
from vellum.llm.packing import pack_documents
from vellum.llm.passages import drop_repeats
from vellum.llm.pii import KINDS, find_personal_data, written
from vellum.llm.quality_rules import rate_documents
from vellum.llm.secret_scan import scan_documents
from vellum.llm.sharding import shard_documents
from vellum.llm.simhash import near_copies
from vellum.llm.spelling import MISSPELT, group_variants
from vellum.llm.syncmers import compare_with_edits


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_documents(table(spark, sf_dir, "documents"))


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def count(k: int):
        return F.size(F.filter("base_spans", lambda x: x["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: candidates, secrets, and the secrets as kind:start:end in their order."""
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    return scan_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_candidates", "n_secrets", spans.alias("spans"))


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *(F.round(c, 9).alias(c) for c in ("evidence", "path_good", "posterior")), "kept")


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(probe))
    return read_back(format_conversations(reply_trees(turns.union(added))))


def op11_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has an even CRC-32 are tampered with: they lose the line feeds of their text and should not verify."""
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.when(F.crc32(F.coalesce(fields["doc_id"].cast("string"), F.lit("")).cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    docs = docs.select("doc_id", "source", leaf_digest(list(fields.values())).alias("digest"), leaf_digest([*list(fields.values())[:-1], tampered]).alias("digest_now"))
    found = merkle_manifest(docs, F.col("digest")).withColumn("folded_root", folded(F.col("digest_now"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_symmetric_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"), misspelt=MISSPELT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_quality_rules, op3_weak_supervision, op4_secret_forest, op5_syncmers, op6_histogram_sort, op7_word_bpe, op8_best_fit_packing, op9_quality_classifier, op10_reply_trees, op11_level_doubling, op12_merkle_manifest, op13_symmetric_delete)}


CHAT_SQL = r"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<!*(\|(im_start|im_end|endoftext|startoftext)\|>|/?s>|</?SYS>>)|\[!*/?INST\]')) AS escaped FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + escaped + 10 + 1) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


QUALITY_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS found
  FROM (SELECT r, i, w[i:i + 4] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words))
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM windows, (SELECT unnest(range(5)) AS k) WHERE found > 1 GROUP BY r
), raw AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), lines AS (
  SELECT r, host, list_filter(list_transform(string_split(regexp_replace(lower(text), '[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM texts
), each AS (
  SELECT r, host, l, unnest(l) AS line FROM lines
), counts AS (
  SELECT host, line, count(DISTINCT l) AS n FROM each GROUP BY host, line
), often AS (
  SELECT host, line FROM counts WHERE n >= 20
), placed AS (
  SELECT r, host, l, i, l[i] AS line, len(string_split(l[i], ' ')) AS words FROM (SELECT r, host, l, unnest(range(1, len(l) + 1)) AS i FROM lines)
), kinds AS (
  SELECT r, CASE WHEN left_words < 10 OR left_words < 0.2 * words THEN [longest] ELSE l END AS kind FROM (
    SELECT p.r, any_value(p.l) AS l, sum(p.words) AS words, coalesce(sum(p.words) FILTER (WHERE o.line IS NULL), 0) AS left_words,
      arg_max(p.line, p.words * 1000000000 - p.i) FILTER (WHERE o.line IS NOT NULL) AS longest
    FROM placed p LEFT JOIN often o ON p.host = o.host AND p.line = o.line GROUP BY p.r)
), gone AS (
  SELECT e.host, e.line FROM each e JOIN often o ON e.host = o.host AND e.line = o.line JOIN kinds k ON e.r = k.r GROUP BY e.host, e.line HAVING count(DISTINCT k.kind) >= 20
), kept_lines AS (
  SELECT r, count(g.line) AS removed, coalesce(sum(len(string_split(e.line, ' '))) FILTER (WHERE g.line IS NULL), 0) AS left_words
  FROM each e LEFT JOIN gone g ON e.host = g.host AND e.line = g.line GROUP BY r
), rated AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(raw.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(removed, 0) AS removed_lines, CAST(coalesce(left_words, 0) AS BIGINT) AS left_words
  FROM texts JOIN words USING (r) LEFT JOIN covered USING (r) LEFT JOIN raw USING (r) LEFT JOIN kept_lines USING (r)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM rated
)
SELECT *, NOT base_failed AND left_words >= 10 AND left_words >= 0.2 * n_words AS kept FROM judged
"""


PASSAGES_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)
), later AS (
  SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM windows) WHERE doc_id > least
), gone AS (
  SELECT DISTINCT r, i + k AS i FROM later, (SELECT unnest(range(50)) AS k)
), placed AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
  SELECT p.r, string_agg(word, ' ' ORDER BY p.i) AS text, count(*) AS n FROM placed p ANTI JOIN gone g ON p.r = g.r AND p.i = g.i GROUP BY p.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words LEFT JOIN kept k USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """SQL has neither XXH64 nor the tokenizers, forests and fingerprints of the other queries; those are tested by brute force."""
    return {"op2_quality_rules": QUALITY_SQL, "op10_reply_trees": CHAT_SQL, "op11_level_doubling": PASSAGES_SQL}
