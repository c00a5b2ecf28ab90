"""Type guesses from a fixed sample of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rectio.functions.locale import Locale, default_locale
from rectio.functions.parsers import GUESS_ORDER, can_parse


def guess_types(rows: DataFrame, columns: Sequence[str], loc: Locale, guess_integer: bool = False) -> list[str]:
    """Type of each text column by all its rows, in one pass: the first type that every value fits."""
    kinds = [k for k in GUESS_ORDER if k != "integer" or guess_integer]
    # a row for each value, so that each type's expression is there once
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in columns])).alias("v")).select("v.c", "v.x")
    tests = [F.every(can_parse(F.col("x"), kind, loc)).alias(kind) for kind in kinds]
    found = {r["c"]: r for r in values.where("x IS NOT NULL").groupBy("c").agg(*tests).collect()}
    return [next((k for k in kinds if found[c][k]), "character") if c in found else "logical" for c in columns]


def guess_type(spark: SparkSession, values: Sequence[str | None], na: Sequence[str] = ("", "NA"), locale: Locale | None = None, guess_integer: bool = False) -> str:
    """Type that a list of texts would be read as."""
    if not values:
        return "character"
    df = spark.createDataFrame([(v,) for v in values], "x string").select(F.when(~F.col("x").isin(*na), F.col("x")).alias("x") if na else "x")
    return guess_types(df, ["x"], locale or default_locale(), guess_integer)[0]
