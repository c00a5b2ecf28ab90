"""Places of records: which rows are the first of a file, the n-th of all, or some that are evenly spaced.

Rows carry ``path``, ``block`` and ``at``: the file, where its split begins, and a number that rises by
one from row to row of a split. One small row for each split, its first ``at`` and its count, thus
tells every row's number in its file and in all; rows themselves are neither sorted nor shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places that are looked up by a list; more of them are found by a join with the splits.
LISTED = 10_000
#: Splits that are broadcast.
FEW_SPLITS = 10_000
_SPLIT = ["path", "block", "part"]


def placed(rows: DataFrame) -> DataFrame:
    """``rows(value, path, block)`` with ``at``; must come after all filters."""
    return rows.withColumn("at", F.monotonically_increasing_id())


def _part() -> Column:
    return F.shiftright("at", 33).alias("part")


def splits(rows: DataFrame, **more: Column) -> DataFrame:
    """``(path, block, part, first, n)``, a row for each split, with aggregates ``more`` of it."""
    return rows.groupBy("path", "block", _part()).agg(F.min("at").alias("first"), F.count("*").alias("n"), *[v.alias(k) for k, v in more.items()])


def located(found: DataFrame) -> DataFrame:
    """``splits`` with ``in_file`` and ``before``, the rows before a split in its file and in all files by name, and ``total``."""
    order = ["path", "block", "part"]
    past = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return found.select("*", past(Window.partitionBy("path").orderBy("block", "part")).alias("in_file"), past(Window.orderBy(*order)).alias("before"), F.sum("n").over(every).alias("total"))


def _met(rows: DataFrame, where: DataFrame) -> DataFrame:
    """``rows`` joined to their splits in ``where``."""
    few = where.limit(FEW_SPLITS + 1).count() <= FEW_SPLITS
    return rows.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(where) if few else where, _SPLIT)


def spaced(guess_max: float) -> Column:
    """Places in a located split of evenly spaced rows and of the last one, as an array of ``at``."""
    number = F.least(F.col("total"), F.lit(int(min(guess_max, 1 << 60))))
    step = F.floor(F.col("total") / number)
    low = F.ceil(F.col("before") / step)
    high = F.least(number - 2, F.floor((F.col("before") + F.col("n") - 1) / step))
    inside = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda j: F.col("first") + j * step - F.col("before")))
    last = F.when(F.col("before") + F.col("n") == F.col("total"), F.array(F.col("first") + F.col("n") - 1))
    none = F.array().cast("array<bigint>")
    return F.concat(F.coalesce(inside, none), F.coalesce(last, none))


def survey(found: DataFrame, guess_max: float) -> dict:
    """One pass over the splits: the largest of each aggregate that ``found`` has besides, and what :func:`pick` needs."""
    kept = [F.max(c).alias(c) for c in found.columns if c not in (*_SPLIT, "first", "n")]
    if guess_max < 1 or guess_max > LISTED:
        return found.agg(F.sum("n").alias("total"), *kept).first().asDict()
    places = spaced(guess_max)
    return located(found).agg(F.flatten(F.collect_list(F.when(F.size(places) > 0, places))).alias("places"), *kept).first().asDict()


def pick(rows: DataFrame, found: DataFrame, told: dict, guess_max: float) -> DataFrame:
    """Evenly spaced rows and the last one, ``guess_max`` at most."""
    if "places" in told:
        return rows.where(F.col("at").isin(*(told["places"] or [])))
    if (told["total"] or 0) <= guess_max:
        return rows
    at = F.col("before") + F.col("at") - F.col("first")
    step = F.floor(F.col("total") / F.lit(int(guess_max)))
    wanted = ((at % step == 0) & (at / step < int(guess_max) - 1)) | (at == F.col("total") - 1)
    return _met(rows, located(found).select(*_SPLIT, "first", "before", "total")).where(wanted)


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each file; ``at`` still rises by one."""
    where = located(splits(rows)).where(F.col("in_file") < n)
    where = where.select(*_SPLIT, (F.col("first") + F.least("n", n - F.col("in_file"))).alias("stop"))
    return _met(rows, where).where("at < stop").drop("stop", "part")


def numbered(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``found``, some of ``rows`` with more columns, with ``ordinal``: the number of a row in its file from 1 on."""
    where = located(splits(rows)).select(*_SPLIT, "first", "in_file")
    met = _met(found, where).withColumn("ordinal", F.col("in_file") + F.col("at") - F.col("first") + 1)
    return met.drop("first", "in_file", "part")


def at_numbers(rows: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """``rows`` with these numbers in all files by name, from 1 on, and their ``number``."""
    wanted = F.array(*[F.lit(int(k)).cast("long") for k in numbers])
    where = located(splits(rows))
    own = F.filter(wanted, lambda k: (k > F.col("before")) & (k <= F.col("before") + F.col("n")))
    places = where.select(F.explode(own).alias("number"), "first", "before").select("number", (F.col("first") + F.col("number") - 1 - F.col("before")).alias("at"))
    known = {r["at"]: r["number"] for r in places.collect()}  # no more than were asked for
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.create_map().cast("map<bigint,bigint>")
    return rows.where(F.col("at").isin(*known)).withColumn("number", table[F.col("at")])
