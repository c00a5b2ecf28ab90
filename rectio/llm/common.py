"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, for columns in between."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids fall in fold -1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(-1))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names; without one, only a local master has a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="rectio-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_new(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns last; those that it has under their names give way."""
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {k.lower() for k in columns}]
    return df.select(*kept, *[v.alias(k) for k, v in columns.items()])


#: Keys that may hold more than one in so many rows each; there are no more than that of them.
HOT_SHARE = 1000


def join_classes(rows: DataFrame, classes: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` joined to ``classes``, one row for each ``key`` with the number ``n`` of rows that have it.

    Classes that hold over one in ``HOT_SHARE`` of all rows are broadcast, at most that many by this
    definition, so no task gathers the rows of one; all others meet theirs in a shuffle.
    """
    total = classes.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(classes.where(F.col(n) * HOT_SHARE > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(classes.where(F.col(n) * HOT_SHARE <= total), key)
    return rows.join(hot, key).unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every vertex that has an edge.

    ``edges`` has two long columns ``a`` and ``b``. Large-star and small-star rounds
    alternate until the edge set is a forest of stars (Kiveris et al., 2014), each of them an
    aggregation and an equality join; no vertex gathers its neighbours into one row, and the
    neighbours of a hub are split over tasks by adaptive execution's skew join. Returns
    ``(id, component)``, without a row for the ids that no edge names. Self-loops and nulls
    link nothing; repeated and reversed edges count once.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if mark["n"] == 0 or mark == seen:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
