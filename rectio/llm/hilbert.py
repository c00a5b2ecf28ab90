"""Shards along a Hilbert curve through several metadata dimensions, with DataFrame functions only.

Each dimension is quantised to 2**bits ranges by splitters that keep its order, the ranges are
the coordinates of a cell, and the cells' places on the curve order the rows. Equal runs of
that order are the shards, so a shard spans few values of every dimension and files that hold it
can be skipped by their minima and maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rectio.llm.common import cut, unused

BITS = 4
SHARDS = 24
#: Parts of a cell that are numbered apart, so that a cell that holds most rows isn't one task.
SALTS = 1024


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Place on the curve of a cell, by Skilling's transposition (2004), as one expression."""
    n = len(coordinates)
    if n < 2 or n * bits > 62:
        raise ValueError("two dimensions or more, and 62 bits at most")
    start = F.array(*[c.cast("long") for c in coordinates])
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))

    def turn(x: Column, k: Column) -> Column:
        q, i = power(F.lit(bits - 1) - F.floor(k / n)), (k % n).cast("int")
        mask, own = q - 1, F.get(x, i)
        differ = x[0].bitwiseXOR(own).bitwiseAND(mask)
        return F.transform(
            x,
            lambda v, j: F.when(
                own.bitwiseAND(q) != 0, F.when(j == 0, v.bitwiseXOR(mask)).otherwise(v)
            ).otherwise(F.when((i != 0) & ((j == 0) | (j == i)), v.bitwiseXOR(differ)).otherwise(v)),
        )

    if bits > 1:
        start = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * n - 1)), start, turn)
    # Gray code: each coordinate takes the ones before it
    def gray(x: Column) -> Column:
        parts = [x[0]]
        for i in range(1, n):
            parts.append(parts[-1].bitwiseXOR(x[i]))
        return F.array(*parts)

    coded = F.element_at(F.transform(F.array(start), gray), 1)

    def settle(x: Column) -> Column:
        flip = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(x[n - 1].bitwiseAND(F.lit(1 << b)) != 0, (1 << b) - 1).otherwise(0).cast("long"))
        moved = F.transform(F.array(flip), lambda f: F.transform(x, lambda v: v.bitwiseXOR(f)))
        return F.element_at(moved, 1)

    def woven(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits):
            for i in range(n):
                bit = F.shiftright(x[i], b).bitwiseAND(F.lit(1).cast("long"))
                out = out + F.shiftleft(bit, b * n + n - 1 - i)
        return out

    settled = F.element_at(F.transform(F.array(coded), settle), 1)
    return F.element_at(F.transform(F.array(settled), woven), 1)


def splitters(df: DataFrame, column: str, bits: int) -> list:
    """Up to 2**bits - 1 ascending bounds: quantiles of numbers, or evenly spaced ones of all distinct texts.

    The distinct texts are sorted by range over the tasks; a count for each range tells where the bounds are.
    """
    parts = 1 << bits
    if isinstance(df.schema[column].dataType, T.StringType):
        texts = cut(df.select(F.col(column).alias("text")).where(F.col(column).isNotNull()).distinct().orderBy("text"))
        texts = texts.withColumn("at", F.monotonically_increasing_id())
        ranges = texts.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
        total, before, places = sum(r["n"] for r in ranges), 0, []
        wanted = {k * total // parts for k in range(1, parts)} if total else set()
        for r in ranges:
            places += [(r["part"] << 33) + k - before for k in wanted if before <= k < before + r["n"]]
            before += r["n"]
        return sorted(r["text"] for r in texts.where(F.col("at").isin(*places)).collect()) if places else []
    found = df.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 1000)).first()[0]
    return sorted(set(found or []))


def quantised(column: Column, bounds: list) -> Column:
    """How many bounds the value reaches; null counts as below all."""
    if not bounds:
        return F.lit(0)
    reached = F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= column)
    return F.coalesce(F.size(reached), F.lit(0))


def hilbert_shards(
    df: DataFrame, dimensions: list[str], tie: list[str], shards: int = SHARDS, bits: int = BITS, salts: int = SALTS
) -> DataFrame:
    """``df`` with ``curve, shard, slot``: shards ``0`` to ``shards - 1`` whose counts are one apart at most.

    ``tie`` orders the rows of a cell, by the hash of its first column and then by all; rows alike in
    all of them may trade places. Null dimensions sort first, an empty table stays empty, repeated
    rows are kept, and texts among the dimensions may be of any length. Columns of ``df`` with one of
    the three new names serve as dimensions and ties, then give way. A cell is numbered in ``salts``
    parts, so that one that holds a third of all rows is many tasks' work; a table of one row for
    each cell, at most 2**(bits * dimensions), is all that one task sees.
    """
    own = df.columns
    spare = dict(zip(("curve", "shard", "slot"), unused(df, "curve__", "shard__", "slot__")))
    df = df.select(*[F.col(f"`{c}`").alias(spare.get(c, c)) for c in own])
    dimensions, tie = [spare.get(d, d) for d in dimensions], [spare.get(t, t) for t in tie]
    bounds = {d: splitters(df, d, bits) for d in dimensions}
    curve = hilbert_index([quantised(F.col(d), bounds[d]) for d in dimensions], bits)
    rows = cut(df.withColumn("curve", curve).withColumn("__salt", F.pmod(F.xxhash64(tie[0]), F.lit(salts))))
    parts = rows.groupBy("curve", "__salt").agg(F.count("*").alias("__n"))
    cells = parts.groupBy("curve").agg(F.sum("__n").alias("__n"))
    # one row for each cell of the curve at most, 2**(bits * dimensions)
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select(
        "curve", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__cell"), F.sum("__n").over(every).alias("__all")
    )
    within = Window.partitionBy("curve").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("curve", "__salt", F.coalesce(F.sum("__n").over(within), F.lit(0)).alias("__part"))
    starts = parts.join(cells, "curve").select("curve", "__salt", (F.col("__cell") + F.col("__part")).alias("__start"), "__all")
    order = Window.partitionBy("curve", "__salt").orderBy(F.xxhash64(tie[0]), *tie)
    ranked = rows.withColumn("__row", F.row_number().over(order)).join(starts, ["curve", "__salt"])
    rank = F.col("__start") + F.col("__row") - 1
    ranked = ranked.withColumn("__rank", rank).withColumn("shard", F.expr(f"(__rank * {shards}) div __all").cast("int"))
    first = F.expr(f"(shard * __all + {shards - 1}) div {shards}")
    kept = [F.col(f"`{c}`") for c in own if c not in spare]
    return ranked.withColumn("slot", F.col("__rank") - first).select(*kept, "curve", "shard", "slot")


def write_shards(df: DataFrame, sharded: DataFrame, key: str, path: str) -> None:
    """Write the rows of ``df`` as one folder of Parquet for each shard, in curve order inside."""
    placed = df.join(sharded.select(key, "shard", "slot"), key)
    placed.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
