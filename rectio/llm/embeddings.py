"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are rotated to the principal axes of a sample, so leading coordinates hold the most. Tiles of
vectors are compared pairwise on different tasks: the product of the leading coordinates plus the
product of the norms of the rest bounds the cosine, pairs whose bound can't reach the threshold
stop there, the others go on to more coordinates, and the last test is the cosine of the vectors as
given, in double precision. Any rotation gives the same links; the sample only sets the pace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rectio.llm.common import connected_components, cut, join_classes

THRESHOLD = 0.95
#: Vectors of a tile, about; a task holds two tiles.
TILE = 8192
#: Ranges of the leading coordinate that vectors are counted by, to cut it into tiles.
CELLS = 1 << 16
#: Vectors that the axes are fitted to, the first by a hash of their components.
AXES_SAMPLE = 8192
_BLOCK = 1024
_SLACK = 1e-4  # for single precision in the bounds
_EDGE = 1e-9  # more than two ways of summing differ by


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Columns are the axes, by falling share of the unit vectors' second moment."""
    unit = units(vectors)
    return np.linalg.eigh(unit.T @ unit)[1][:, ::-1]


def _stages(width: int) -> list[int]:
    return sorted({min(width, k) for k in (max(1, width // 4), max(1, width // 2))})


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each place reaches over the links."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(left: np.ndarray, right: np.ndarray | None, axes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked pairs, by blocks. Without ``right`` the pairs of ``left`` with itself, each once."""
    same = right is None
    sides = [left] if same else [left, right]
    unit = [units(x) for x in sides]
    turned = [u @ axes for u in unit]
    ua, ub, ta, tb = unit[0], unit[-1], turned[0], turned[-1]
    stages = _stages(axes.shape[1])
    rest = [[np.sqrt(np.maximum((t[:, k:] ** 2).sum(axis=1), 0)) for k in stages] for t in turned]
    ra, rb = rest[0], rest[-1]
    first = stages[0]
    bound = [np.concatenate([t[:, :first], r[0][:, None]], axis=1).astype(np.float32) for t, r in zip(turned, rest)]
    for low in range(0, len(ta), _BLOCK):
        rows = slice(low, min(low + _BLOCK, len(ta)))
        columns = low if same else 0
        reach = bound[0][rows] @ bound[-1][columns:].T
        a, b = np.nonzero(reach >= threshold - _SLACK)
        a, b = a + low, b + columns
        if same:
            a, b = a[a < b], b[a < b]
        if len(a) > 200_000:  # a dense block is cheaper whole; what lies at the threshold is decided as all else is
            x = ua[rows] @ ub[columns:].T
            sure, near = x >= threshold + _EDGE, np.abs(x - threshold) < _EDGE
            p, q = np.nonzero(near)
            near[p, q] = np.einsum("ij,ij->i", ua[p + low], ub[q + columns]) >= threshold
            a, b = np.nonzero(sure | near)
            a, b = a + low, b + columns
            if same:
                a, b = a[a < b], b[a < b]
            yield a, b
            continue
        found = []
        for at in range(0, len(a), 50_000):
            p, q = a[at : at + 50_000], b[at : at + 50_000]
            so_far = np.einsum("ij,ij->i", ta[p, :first], tb[q, :first])
            for k, (before, after) in enumerate(zip(stages, stages[1:]), start=1):
                so_far += np.einsum("ij,ij->i", ta[p, before:after], tb[q, before:after])
                alive = so_far + ra[k][p] * rb[k][q] >= threshold - _SLACK
                p, q, so_far = p[alive], q[alive], so_far[alive]
            linked = np.einsum("ij,ij->i", ua[p], ub[q]) >= threshold
            found.append((p[linked], q[linked]))
        if found:
            yield np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def _valid(column: str) -> Column:
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)


def _tiled_links(classes: DataFrame, width: int, threshold: float, tile: int) -> DataFrame:
    """``(class, links, other)``: vectors linked to a class beyond its own, and edges of spanning forests."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("v"), "class").limit(AXES_SAMPLE).select("v").toPandas()["v"]
    axes = principal_axes(np.array([np.asarray(v, dtype=np.float64) for v in sample]))
    shared = spark.sparkContext.broadcast(axes)

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            lead = units(values) @ shared.value[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead, pa.float64())], names=["class", "n", "v", "lead"])

    # written, for sums may differ in their last bits from run to run
    placed = cut(classes.select("class", "n", "v").mapInArrow(leading, "class long, n long, v array<double>, lead double"))
    placed = placed.withColumn("cell", F.floor((F.col("lead") + 1) * (CELLS / 2)))
    # cells in their order are merged to bins of about a tile; one row for each cell, CELLS and two at most
    cells = placed.groupBy("cell").agg(F.count("*").alias("c"))
    past = F.coalesce(F.sum("c").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("cell", "c", F.floor(past / tile).alias("bin"))
    cells = cells.select("cell", "bin", F.ceil(F.sum("c").over(Window.partitionBy("bin")) / tile).alias("parts"))
    # a bin of many like values is dealt on to tiles by a hash
    part = F.pmod(F.xxhash64("class"), F.col("parts"))
    placed = placed.join(F.broadcast(cells), "cell").withColumn("tile", F.concat_ws("-", "bin", part)).drop("cell", "parts", "bin")
    # the tiles whose least leading coordinates lie within another's range and a bit more, met by equal steps of it
    apart = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    step = lambda x: F.floor(x / max(apart, 1e-3))
    tiles = placed.groupBy("tile").agg(F.min("lead").alias("low"), F.max("lead").alias("high"))
    left = tiles.select(F.struct("low", "tile").alias("a"), "high", F.explode(F.sequence(step(F.col("low")), step(F.col("high") + apart))).alias("step"))
    right = tiles.select(F.struct("low", "tile").alias("b"), step(F.col("low")).alias("step"))
    pairs = left.join(right, "step").where((F.col("a") <= F.col("b")) & (F.col("b.low") - F.col("high") <= apart))
    pairs = cut(pairs.select(F.col("a.tile").alias("a"), F.col("b.tile").alias("b")))
    pair = F.concat_ws("/", "a", "b").alias("pair")
    sides = pairs.select(F.col("a").alias("tile"), pair, F.lit(0).alias("side")).unionByName(
        pairs.where("a <> b").select(F.col("b").alias("tile"), pair, F.lit(1).alias("side"))
    )
    as_bytes = placed.join(sides, "tile").select("pair", "side", "class", "n", "v")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        axes = shared.value
        group = group.sort_values(["side", "class"], ignore_index=True)
        vectors = np.stack(group["v"].to_numpy()).astype(np.float64)
        number, weight = group["class"].to_numpy(), group["n"].to_numpy()
        border = int((group["side"] == 0).sum())
        whole = border == len(group)
        links = np.zeros(len(group), dtype=np.int64)
        kept_a, kept_b = [], []
        for a, b in compare(vectors[:border], None if whole else vectors[border:], axes, threshold):
            b = b if whole else b + border
            links += np.bincount(a, weight[b], len(group)).astype(np.int64) + np.bincount(b, weight[a], len(group)).astype(np.int64)
            root = _roots(len(group), a, b)
            moved = np.flatnonzero(root != np.arange(len(group)))
            kept_a.append(moved)
            kept_b.append(root[moved])
        root = _roots(len(group), np.concatenate(kept_a), np.concatenate(kept_b)) if kept_a else np.arange(len(group))
        linked = np.flatnonzero(links)
        return pd.DataFrame({"class": number[linked], "links": links[linked], "other": number[root[linked]]})

    # two tiles a group
    return as_bytes.groupBy("pair").applyInPandas(run, "class long, links long, other long")


def embedding_links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row.

    Equal vectors are one class, compared once and counted as often as they occur. A null, empty or
    zero vector and one with null or non-finite components links with nothing, nor do vectors of
    different length. Components are doubles from the start and of any magnitude. Repeated rows are
    kept, an empty table gives none, other columns play no part. Rows with a null id take part, but
    are no one's ``component_id`` unless all of their component are null.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = _valid("v")
    valid = rows.where(good)
    classes = valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = cut(cut(classes).withColumn("class", F.monotonically_increasing_id()))
    found = None
    for width in [r[0] for r in classes.select(F.size("v")).distinct().collect()]:
        part = _tiled_links(classes.where(F.size("v") == width), width, threshold, tile)
        found = part if found is None else found.unionByName(part)
    alone = rows.where(~good).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    if found is None:
        return alone
    found = cut(found)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    linked = connected_components(found.select(F.col("class").alias("a"), F.col("other").alias("b")))
    of = classes.join(linked, classes["class"] == linked["id"], "left").select("class", "rep", F.coalesce("component", "class").alias("root"))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = of.join(least, "root").join(links, "class", "left").select("class", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    labelled = cut(classes.join(labels, "class").select("v", "n", "component_id", (F.col("links") + F.col("n") - 1).alias("n_links")))
    out = join_classes(valid, labelled, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone)
