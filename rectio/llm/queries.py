"""The registered queries of the training-data operators; each covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rectio.llm import bpe, decontaminate, embeddings, hilbert, langid, lattice, pii, quality, simhash, toxicity
from rectio.llm.common import fold, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", learn=fold(4) != 2)
    return toxicity.score(docs, network).select(
        "doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, pii.session_key(spark), count_col="n_replaced")


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )
    placed = hilbert.hilbert_shards(docs, ["lang", "source", "size"], ["doc_id", "size", "text_crc32"], shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ensemble = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", learn=fold(5) != 0)
    return quality.score(docs, ensemble).select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_links(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lattice.score_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), learn=fold(10) != 0)
    return found.select("doc_id", (fold(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)
    return found.select("doc_id", simhash.to_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, learn=fold(4) != 2)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), window=13).drop("text")


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What :func:`op6_lattice_scores` tells of word counts, all of which SQL can tell as well."""
    return op6_lattice_scores(spark, sf_dir).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_pii_surrogates": op2_pii_surrogates,
        "op3_hilbert_shards": op3_hilbert_shards,
        "op4_quality_rules": op4_quality_rules,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_lattice_scores": op6_lattice_scores,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_language_id": op8_language_id,
        "op9_bpe": op9_bpe,
        "op10_decontamination": op10_decontamination,
        "base_scores": base_scores,
    }


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of an id's decimal digits, byte by byte through the polynomial's table.
_CRC = """crc(i, c) AS (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
    FROM range(256) t(i)),
  crc_table(t) AS (SELECT list(c ORDER BY i) FROM crc),
  folds(doc_id, crc) AS (
    SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)),
        lambda x, y: xor(x >> 8, t[(xor(x, y) & 255)::INTEGER + 1])), 4294967295)
    FROM documents, crc_table)"""

_EMBEDDINGS = """WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) >= 0.95 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
  reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
  root AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
  degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(r.component_id, e.vec_id) AS component_id, coalesce(r.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN root r USING (vec_id) LEFT JOIN degree d USING (vec_id)"""

_CONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  i AS (SELECT item_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS text
    FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT n FROM windows),
  places AS (
    SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS text
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
  found AS MATERIALIZED (SELECT p.doc_id, p.k, p.n, item_id FROM places p JOIN windows USING (n, text)),
  hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS k FROM found) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

_BASE = f"""WITH {_CRC},
  tokens AS (SELECT doc_id, crc % 10 <> 0 AS learn, unnest(list_append(regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+'), ' ')) AS w
    FROM documents JOIN folds USING (doc_id)),
  counts AS (SELECT w, count(*) AS c FROM tokens WHERE learn GROUP BY w),
  sums AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM counts)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(c) AS BIGINT) AS n_known, CAST(max(n) AS BIGINT) AS train_tokens,
  round(sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 4) AS base_score
FROM tokens LEFT JOIN counts USING (w), sums GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: networks, keyed permutations, hashes, the curve's ties and vocabularies are beyond it."""
    return {"op5_embedding_near_dedup": _EMBEDDINGS, "op10_decontamination": _CONTAMINATION, "base_scores": _BASE}
