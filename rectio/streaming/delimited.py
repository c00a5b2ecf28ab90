"""Delimited lines of a growing folder as a stream, with a specification given in full."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rectio.functions import tokens as tk
from rectio.functions.locale import Locale, default_locale
from rectio.functions.parsers import parse_column
from rectio.plans import spec as sp


def read_stream(
    spark: SparkSession, folder: str, col_types: sp.ColSpec, delim: str = ",", quote: str = '"', comment: str = "",
    na: Sequence[str] = ("", "NA"), locale: Locale | None = None, header: bool = False,
) -> DataFrame:
    """Records are lines; with ``header`` lines that equal the column names are left out."""
    loc, d = locale or default_locale(), tk.Dialect(delim, quote, comment)
    names = list(col_types.cols)
    lines = spark.readStream.text(folder).where(F.trim("value") != "")
    if header:
        lines = lines.where(F.col("value") != delim.join(map(str, names)))
    if comment:
        lines = lines.where(~F.col("value").startswith(comment)).withColumn("value", tk.uncommented(F.col("value"), d))
    rows = lines.select(F.explode(F.array(F.struct(tk.tokens(F.col("value"), d).alias("raw")))).alias("t"))
    rows = rows.select(tk.widened(F.col("t.raw"), d, len(names)).alias("tok"))
    out = []
    for k, (name, c) in enumerate(col_types.cols.items()):
        if c.kind != "skip":
            x = tk.content(F.get("tok", F.lit(k)), d)
            x = F.when(~x.isin(*na), x) if na else x
            out.append(parse_column(x, c.kind, loc, c.format, c.levels).alias(str(name)))
    return rows.select(*out)
