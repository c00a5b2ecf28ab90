"""SimHash near-duplicate detection by one-wildcard deletion variants of fingerprint halves.

A fingerprint has 64 bits and two of them link at three or fewer differing bits. Cut into two
halves, one half of a linked pair differs by one bit at most, so both fingerprints share one of
the 32 variants of that half in which a single bit is blanked. Variants are the keys of an
equality join; the whole fingerprints are verified inside the join's condition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rectio.llm.common import connected_components, cut, join_classes, unused

SEED = 42
MAX_BITS = 3
#: Fingerprints that may share a half before its variants are refined by the other half.
HOT_HALF = 2000
_CHUNK = 1 << 18


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case and all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _shingle_hashes(words: list[bytes], size: int, first: int, last: int) -> list[int]:
    """XXH64 of the shingles that start at the words ``first`` to ``last - 1``."""
    part = words[first : last + size - 1]
    lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    joined = b" ".join(part)
    size = min(size, len(part))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist())]


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes, how many have each of the 64 bits set; two bits share a lane."""
    counts = np.empty((len(starts), 64), dtype=np.int64)
    lanes, low = np.uint64(0x0000000100000001), np.uint64(0xFFFFFFFF)
    for bit in range(32):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, starts)
        counts[:, bit] = (sums & low).astype(np.int64)
        counts[:, bit + 32] = (sums >> np.uint64(32)).astype(np.int64)
    return counts


def fingerprints_of(texts: list[str | None], shingle_words: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints; texts without words get zero."""
    counts = np.zeros((len(texts), 64), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    pending: list[int] = []
    runs: list[tuple[int, int]] = []

    def flush() -> None:
        if not runs:
            return
        sums = _bit_counts(np.array(pending, dtype=np.uint64), np.array([start for _, start in runs]))
        np.add.at(counts, [row for row, _ in runs], sums)
        pending.clear()
        runs.clear()

    for row, text in enumerate(texts):
        words = words_of(text)
        if not words:
            continue
        shingles = max(1, len(words) - shingle_words + 1)
        total[row] = shingles
        for first in range(0, shingles, _CHUNK):
            runs.append((row, len(pending)))
            pending += _shingle_hashes(words, shingle_words, first, min(first + _CHUNK, shingles))
            if len(pending) >= _CHUNK:
                flush()
    flush()
    bits = (2 * counts > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` is the fingerprint's 64 bits as a signed long.

    Null and word-less texts get fingerprint zero, repeated rows and null ids stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints_of(batch.column(1).to_pylist(), shingle_words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "fp"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _half(which: int) -> Column:
    return F.shiftrightunsigned("fp", 32 * which).bitwiseAND(F.lit(0xFFFFFFFF))


def _blanked(half: Column, bit: Column) -> Column:
    return half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)")))


def _links(keyed: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    """Pairs of one key that differ in few enough bits; a pair counts at one blanked bit of a half."""
    a, b = keyed.alias("a"), keyed.alias("b")
    apart = F.col("a.half").bitwiseXOR(F.col("b.half"))
    condition = (
        (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
        & ((apart == F.expr("shiftleft(1L, a.bit)")) | ((apart == 0) & (F.col("a.bit") == 0)))
    )
    for key in keys:
        condition = (F.col(f"a.{key}") == F.col(f"b.{key}")) & condition
    return a.join(b, condition).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def near_pairs(prints: DataFrame, max_bits: int = MAX_BITS, hot_half: int = HOT_HALF) -> DataFrame:
    """Links ``(a, b)`` between representatives of ``prints(fp, rep)``, whose ``fp`` are distinct.

    Every pair with up to ``max_bits`` (three at most) differing bits is found. Variants of a half
    that more than ``hot_half`` fingerprints share get the one-wildcard variants of both quarters
    of the other half as a second key, which bounds each key to 2**18 fingerprints and loses no
    pair: the other half differs by three bits at most, so one quarter by one.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("two halves with one wildcard find up to three differing bits")
    halves = F.array(*[F.struct(F.lit(which).alias("seg"), _half(which).alias("half")) for which in (0, 1)])
    by_half = prints.select("fp", "rep", F.explode(halves).alias("x")).select("fp", "rep", "x.seg", "x.half")
    bits = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit")
    variants = by_half.select("*", bits).withColumn("key", _blanked(F.col("half"), F.col("bit")))
    hot = cut(by_half.groupBy("seg", "half").count().where(F.col("count") > hot_half).select("seg", "half"))
    keys = ["seg", "bit", "key"]
    if hot.isEmpty():
        return _links(variants, keys, max_bits)
    hot_keys = hot.select("seg", "half", bits).withColumn("key", _blanked(F.col("half"), F.col("bit")))
    hot_keys = hot_keys.select(*keys).distinct()
    other = F.when(F.col("seg") == 0, _half(1)).otherwise(_half(0))
    refined = variants.join(hot_keys, keys, "left_semi").withColumn("other", other)
    refined = refined.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit2")
    ).withColumn("key2", F.expr("""
        CASE WHEN bit2 < 16 THEN (other & 65535L) & ~shiftleft(1L, bit2)
             ELSE shiftright(other, 16) & ~shiftleft(1L, bit2 - 16) END"""))
    normal = _links(variants.join(hot_keys, keys, "left_anti"), keys, max_bits)
    return normal.unionByName(_links(refined, [*keys, "bit2", "key2"], max_bits))


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    max_bits: int = MAX_BITS,
    hot_half: int = HOT_HALF,
) -> DataFrame:
    """``(doc_id, fp, component_id, component_fp)`` for each row of ``docs``.

    Equal fingerprints are one class; classes link by :func:`near_pairs`, ``component_id`` is the
    smallest id reachable, and ``component_fp`` the smallest fingerprint. An empty table gives
    none, null texts have fingerprint zero, texts of any length are read whole, repeated rows are kept,
    rows with a null id link by their text only (and have a null component if no row with an id is
    reachable); other columns play no part. A fingerprint that many rows share is broadcast.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle_words))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    # classes link by their fingerprint, since rows with one id may have several
    linked = connected_components(near_pairs(classes.select("fp", F.col("fp").alias("rep")), max_bits, hot_half))
    labels = classes.join(linked, classes.fp == linked.id, "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("root"))
    least = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = cut(labels.join(least, "root").select("fp", "n", "component_id", F.col("root").alias("component_fp")))
    return join_classes(rows, labels, "fp").select("doc_id", "fp", "component_id", "component_fp")


def keep_one_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """The rows of ``docs`` that represent their component in ``classes``; all columns stay as they are, whatever their names.

    Of rows with one id one stays for each component that the id represents. A row with a null id stays, because no other row can stand for it by id.
    """
    kept = classes.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    everyone = classes.groupBy("doc_id").agg(F.count("*").alias("all"))
    key, many = unused(docs, "kept", "many")
    kept = cut(kept.join(everyone, "doc_id").select(F.col("doc_id").alias(key), (F.col("all") > 1).alias(many)))
    at = F.col(f"`{id_col}`")
    single = docs.join(kept.where(~F.col(many)), at == F.col(key), "left_semi")
    out = single.unionByName(docs.where(at.isNull()))
    repeated = kept.where(F.col(many))
    if repeated.isEmpty():
        return out
    # ids that occur more than once: their texts' fingerprints tell which of them represent a component
    again = docs.join(repeated, at == F.col(key), "left_semi").dropDuplicates([id_col, text_col])
    [row] = unused(docs, "row")
    again = cut(again.withColumn(row, F.monotonically_increasing_id()))
    prints = fingerprints(again.select(F.col(row).alias("doc_id"), F.col(f"`{text_col}`").alias("text")), shingle_words=shingle_words)
    prints = prints.select(F.col("doc_id").alias(row), "fp").join(again.select(row, at.alias("id")), row)
    stays = classes.where("doc_id = component_id").select(F.col("doc_id").alias("id"), "fp", "component_fp").distinct()
    one = prints.join(stays, ["id", "fp"]).groupBy("id", "component_fp").agg(F.min(row).alias(row))
    return out.unionByName(again.join(one, row, "left_semi").drop(row))


def to_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
