"""DataFrames as delimited text: every row is rendered by one expression and written in parallel."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rectio.functions.datetimes import let

_HOOKS: list[tuple[Callable[[T.DataType], bool], Callable[[Column], Column]]] = []


def register_output(test: Callable[[T.DataType], bool], render: Callable[[Column], Column]) -> None:
    """Let ``render`` turn columns of the types that pass ``test`` into text."""
    _HOOKS.insert(0, (test, render))


def _double(x: Column) -> Column:
    """Shortest digits that read back alike.

    Whole numbers are plain below 1e15, fractions down to 0.001; others have an exponent, whole ones
    after all their digits and fractions after the first.
    """

    def spelt(p: Column) -> Column:
        bare, point = p["bare"], p["point"]
        n = F.length(bare)
        whole = F.when(point - n <= F.greatest(F.lit(2), 15 - n), F.rpad(bare, point, "0")).otherwise(F.concat(bare, F.lit("e"), (point - n).cast("string")))
        inside = F.concat(F.substring(bare, F.lit(1), point), F.lit("."), F.substring(bare, point + 1, n))
        rest = F.when(n > 1, F.concat(F.lit("."), F.substring(bare, F.lit(2), n))).otherwise("")
        small = F.concat(F.substring(bare, 1, 1), rest, F.lit("e"), (point - 1).cast("string"))
        return F.when(point >= n, whole).when(point > 0, inside).when(point > -3, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), bare)).otherwise(small)

    def parts(t: Column) -> Column:
        mantissa = F.regexp_replace(t, "E.*$", "")
        whole = F.substring_index(mantissa, ".", 1)
        digits = F.regexp_replace(mantissa, "[.]", "")
        lead = F.length(digits) - F.length(F.ltrim(digits, F.lit("0")))
        power = F.regexp_extract(t, "E(-?[0-9]+)$", 1).cast("int")
        return F.struct(F.trim(digits, F.lit("0")).alias("bare"), (F.length(whole) + power - lead).alias("point"))

    def body(t: Column) -> Column:
        plain = F.when(t.endswith(".0"), F.substring(t, F.lit(1), F.length(t) - 2)).otherwise(t)
        usual = F.when(t == "-0.0", "0").otherwise(plain)
        sign = F.when(t.startswith("-"), "-").otherwise("")
        scientific = F.concat(sign, let(let(F.ltrim(t, F.lit("-")), parts), spelt))
        infinite = F.concat(sign, F.lit("Inf"))
        return F.when(t == "NaN", None).when(t.contains("E"), scientific).when(t.endswith("y"), infinite).otherwise(usual)

    return let(x.cast("string"), body)


def output_column(x: Column, kind: T.DataType) -> Column:
    """Text of a column before quoting; null and NaN stay null."""
    for test, render in _HOOKS:
        if test(kind):
            return render(x)
    if isinstance(kind, T.BooleanType):
        return F.when(x, "TRUE").when(~x, "FALSE")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _double(x.cast("double"))
    if isinstance(kind, T.TimestampType):
        x = F.to_utc_timestamp(x, F.current_timezone())
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):  # the cast leaves out zeros at the end of a fraction
        return F.concat(F.replace(x.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    if isinstance(kind, T.DayTimeIntervalType):
        x = x.cast("interval day to second")
        part = lambda p: F.extract(F.lit(p), x)
        whole = F.abs(part("DAY").cast("decimal(18,6)") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND"))
        s = F.floor(whole)
        fraction = F.rtrim(F.substring((whole - s).cast("decimal(9,6)").cast("string"), 2, 7), F.lit("0"))
        two = lambda v: F.lpad(v.cast("string"), 2, "0")
        clock = F.concat_ws(":", F.when(s >= 360000, F.floor(s / 3600).cast("string")).otherwise(two(F.floor(s / 3600))), two(F.floor(s / 60) % 60), F.concat(two(s % 60), F.when(fraction != ".", fraction).otherwise("")))
        return F.when(x.isNotNull(), F.concat(F.when(x < F.expr("INTERVAL '0' SECOND"), "-").otherwise(""), clock))
    return x.cast("string")


def _quoted(x: Column, delim: str, quote: str, escape: str, na: str) -> Column:
    mark = {"double": '"', "backslash": "\\", "none": ""}[escape]
    inner = F.replace(x, F.lit('"'), F.lit(mark + '"')) if mark else x
    wrapped = F.concat(F.lit('"'), inner, F.lit('"'))
    if quote == "all":
        return wrapped
    if quote == "none":
        return inner
    special = x.contains('"') | x.contains("\n") | x.contains("\r") | (x.contains(delim) if delim else F.lit(False))
    return F.when((x != na) & special, wrapped).otherwise(inner)


def rendered(df: DataFrame, delim: str = "\t", na: str = "NA", quote: str = "needed", escape: str = "double") -> DataFrame:
    """One column ``value`` with a line for each row."""
    cells = []
    for f in df.schema.fields:
        x = output_column(F.col(f"`{f.name}`"), f.dataType)
        text = not isinstance(f.dataType, (T.NumericType, T.BooleanType))
        cells.append(F.coalesce(_quoted(x, delim, quote, escape, na) if text else x, F.lit(na)))
    return df.select(F.concat_ws(delim, *cells).alias("value")) if cells else df.select(F.lit("").alias("value")).limit(0)


def header_line(df: DataFrame, delim: str = "\t", quote: str = "needed", escape: str = "double") -> str:
    mark = {"double": '"', "backslash": "\\", "none": ""}[escape]

    def one(name: str) -> str:
        inner = name.replace('"', mark + '"') if mark else name
        special = any(c in name for c in '"\n\r') or (delim and delim in name)
        return f'"{inner}"' if quote == "all" or (quote == "needed" and special) else inner

    return delim.join(map(one, df.columns))


def _opened(path: str, mode: str):
    if path.endswith(".zip"):
        if mode != "wb":
            raise ValueError("nothing can be appended to a zip file")
        name = os.path.basename(path).removesuffix(".zip")
        archive = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)
        member = archive.open(name, "w", force_zip64=True)
        close = member.close

        def closed() -> None:
            close()
            archive.close()

        member.close = closed
        return member
    kind = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}.get(os.path.splitext(path)[1], open)
    return kind(path, mode)


def write_delim(
    df: DataFrame, file, delim: str = "\t", eol: str = "\n", na: str = "NA", col_names: bool | None = None, append: bool = False,
    quote: str = "needed", escape: str = "double", bom: bool = False,
) -> DataFrame:
    """Write one delimited file, or to an open binary stream, row by row from the executors' output.

    For output that no single file should hold use :func:`write_delim_dir`. Without columns the
    file is empty, without rows it has the header only, and appending no rows leaves it alone.
    """
    col_names = (not append) if col_names is None else col_names
    if append and df.isEmpty() and not col_names:
        return df
    stream = file if hasattr(file, "write") else _opened(file, "ab" if append else "wb")
    try:
        if bom and not append and stream is not file:
            stream.write(b"\xef\xbb\xbf")
        if df.columns:
            if col_names:
                stream.write((header_line(df, delim, quote, escape) + eol).encode())
            for row in rendered(df, delim, na, quote, escape).toLocalIterator(prefetchPartitions=True):
                stream.write((row[0] + eol).encode())
    finally:
        if stream is not file:
            stream.close()
    return df


def write_delim_dir(
    df: DataFrame, path: str, delim: str = "\t", eol: str = "\n", na: str = "NA", col_names: bool = True, quote: str = "needed", escape: str = "double",
    compression: str | None = None, mode: str = "error",
) -> None:
    """Write a folder of delimited files in parallel, each with the header."""
    lines = rendered(df, delim, na, quote, escape)
    write_text_dir(lines, path, header_line(df, delim, quote, escape) if col_names else None, eol, compression, mode)


def write_text_dir(lines: DataFrame, path: str, head: str | None = None, eol: str = "\n", compression: str | None = None, mode: str = "error") -> None:
    """Write the column ``value`` as a folder of text files that each begin with ``head``.

    A task writes one file, and the first row of its partition takes the head along.
    """
    value = F.col("value")
    if head is not None:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        value = F.when(first, F.concat(F.lit(head + eol), value)).otherwise(value)

    def write(rows: DataFrame, how: str) -> None:
        writer = rows.write.mode(how).option("lineSep", eol).option("maxRecordsPerFile", 0)
        writer.option("compression", compression or "none").text(path)

    write(lines.select(value.alias("value")), mode)
    spark = lines.sparkSession
    if head is not None and mode != "append" and spark.read.text(path).isEmpty():
        write(spark.createDataFrame([(head,)], "value string").coalesce(1), "append")


def format_delim(df: DataFrame, delim: str = "\t", eol: str = "\n", na: str = "NA", col_names: bool = True, quote: str = "needed", escape: str = "double", bom: bool = False) -> str:
    """The text that :func:`write_delim` would write; for small results."""
    out = io.BytesIO()
    if bom:
        out.write(b"\xef\xbb\xbf")
    write_delim(df, out, delim, eol, na, col_names, False, quote, escape)
    return out.getvalue().decode()


def write_lines(df: DataFrame, file, eol: str = "\n", na: str = "NA", append: bool = False) -> DataFrame:
    """Write the first column as lines."""
    return write_delim(df.select(df.columns[0]), file, "", eol, na, False, append, "none", "none")
