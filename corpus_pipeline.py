"""A corpus in five stages: toxicity, near-dedup, decontamination, surrogates for personal data, BPE.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept. All but
the last return the columns of ``documents``. Between stages rows are written as Parquet to the
folder that the executors share, and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rectio.llm import bpe, decontaminate, pii, simhash, toxicity
from rectio.llm.common import ensure_checkpoint_dir, table, unused


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go.

    The network is trained on a bounded sample of the labelled rows of the whole table, and every
    row of ``docs`` is scored, whole texts of any length. Null, empty and word-less texts have the
    score of no words and stay unless that is rejected; repeated rows have one score and share their
    lot, rows with null ids stay or go by their text, an empty table gives an empty one, and further
    columns may have any names.
    """
    network = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    [out] = unused(docs, "toxicity")
    return toxicity.score(docs, network, out=out).where(F.col(out) < toxicity.THRESHOLD).drop(out)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    The operator's contract holds here too: shingles of three words, links at three or fewer
    differing bits. Shingles of five words would find fewer near copies at the same bits. Null, empty
    and word-less texts are one group. Of repeated rows one stays, and of rows with one id and texts
    of several groups one for each group that the id represents. Rows with a null id all stay, for
    none of them can be named. Texts of any length are read whole, an empty table gives an empty
    one, and further columns may have any names.
    """
    return simhash.keep_one_each(docs, simhash.simhash_components(docs, shingle_words=3))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in passages of the benchmark go.

    Null, empty and word-less texts have no words and stay, rows with null ids and repeated rows stay
    or go by their text, and texts of any length are read whole. An empty table gives an empty
    one, without a benchmark every row stays, and further columns may have any names.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates; ``n_chars`` follows the new text.

    The key is the session's setting ``spark.rectio.pii.key``, or a fresh one. Null texts stay null
    with a null ``n_chars``, empty ones empty; every row stays, repeated ones with equal
    surrogates, and so do null ids. Texts and entities may be of any length, an empty table gives
    an empty one, and further columns may have any names.
    """
    out = pii.replace_pii(docs, pii.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, with the digests of the ids and of what they decode to.

    Null and empty texts have no tokens, repeated rows and null ids one row each, texts of any length
    are encoded whole, an empty table gives an empty one, and further columns of ``docs`` are left out.
    """
    coded = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: The network, the fingerprints' hash and the vocabulary are beyond SQL; the tests hold a
#: brute-force version against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
