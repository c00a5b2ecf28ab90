"""Fixed-width text: layouts, and a reader that slices the bytes of every line."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rectio.functions.locale import Locale, default_locale
from rectio.functions.parsers import expected, parse_column
from rectio.functions.tokens import Dialect
from rectio.operators.guess import guess_types
from rectio.plans import select as sel
from rectio.plans import spec as sp
from rectio.sources.delimited import _AT, RectFrame, _path_column, drop_prefix
from rectio.sources.rows import first_rows, numbered, pick, placed, splits, survey
from rectio.sources.sniff import decoded, head_lines, is_blank
from rectio.sources.staging import resolve


@dataclass(frozen=True)
class Layout:
    """Columns from byte ``begin`` up to ``end``, counted from 0; an end of None is the line's."""

    begin: tuple[int, ...]
    end: tuple[int | None, ...]
    names: tuple[str, ...]

    def __post_init__(self):
        for b, e in zip(self.begin, self.end):
            if e is not None and b > e:
                raise ValueError(f"a column begins at {b} and ends at {e}")


def fwf_widths(widths: Sequence[int | None], col_names: Sequence[str] | None = None) -> Layout:
    """Columns side by side; only the last width may be None."""
    begin, at = [], 0
    for w in widths:
        begin.append(at)
        at += w or 0
    end = [None if w is None else b + w for b, w in zip(begin, widths)]
    return Layout(tuple(begin), tuple(end), tuple(sp.make_names(col_names, len(begin))))


def fwf_positions(start: Sequence[int], end: Sequence[int | None], col_names: Sequence[str] | None = None) -> Layout:
    """Columns from one place to another, counted from 1, both included."""
    if len(start) != len(end):
        raise ValueError("start and end must have the same length")
    return Layout(tuple(s - 1 for s in start), tuple(end), tuple(sp.make_names(col_names, len(start))))


def fwf_cols(**columns: int | tuple[int, int]) -> Layout:
    """Named widths, or named pairs of places."""
    if all(isinstance(v, int) or v is None for v in columns.values()):
        return fwf_widths(list(columns.values()), list(columns))
    pairs = list(columns.values())
    return fwf_positions([p[0] for p in pairs], [p[1] for p in pairs], list(columns))


def fwf_empty(spark: SparkSession, file, skip: int = 0, col_names: Sequence[str] | None = None, comment: str = "", n: int = 100) -> Layout:
    """A column ends where the first n + 1 lines are all blank; the last one is open."""
    inputs, charset = resolve(spark, file)
    lines = [x for x in head_lines(spark, inputs[0].first, skip + n + 1, charset)[skip:] if not (comment and x.startswith(comment))]
    data = [x.encode() for x in lines]
    width = max(map(len, data), default=0)
    blank = [all(k >= len(x) or x[k : k + 1] in b" \r" for x in data) for k in range(width)]
    begin, end = [], []
    for k in range(width):
        if not blank[k] and (k == 0 or blank[k - 1]):
            begin.append(k)
        if blank[k] and k and not blank[k - 1]:
            end.append(k)
    ends: list[int | None] = [*end[: max(0, len(begin) - 1)], None] if begin else []
    return Layout(tuple(begin), tuple(ends), tuple(sp.make_names(col_names, len(begin))))


def _opened(layout: Layout, lines: DataFrame, comment: str) -> Layout:
    """The first lines' columns, parted where all of ``lines(value, ...)`` are blank.

    What later lines hold between two columns goes to the one it adjoins: these are parted at the last
    blanks that all lines share. Where they share none the first lines' places stay.
    """
    gaps = [(e, b) for e, b in zip(layout.end, layout.begin[1:])]
    places = sorted({*range(layout.begin[0]), *(p for e, b in gaps for p in range(e, b))}) if layout.begin else []
    wanted = np.zeros(places[-1] + 1 if places else 0, bool)
    wanted[places] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(wanted), bool)
        for batch in batches:
            for line in batch.column(0).to_pylist():
                if not (comment and line.startswith(comment.encode())):
                    line = np.frombuffer(line, np.uint8, min(len(line), len(wanted)))
                    held[: len(line)] |= (line != 32) & (line != 13)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(held & wanted), pa.int64())], names=["place"])

    # no more rows than places
    held = {r[0] for r in lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, "place long").distinct().collect()} if places else set()
    begin, end = list(layout.begin), list(layout.end)
    begin[:1] = [min([*held, b]) for b in begin[:1]]
    for k, (e, b) in enumerate(gaps):
        blank = [p for p in range(e, b) if p not in held]
        if blank:
            begin[k + 1] = blank[-1] + 1
            end[k] = next(p for p in range(blank[-1], e - 1, -1) if p == e or p - 1 in held)
    return Layout(tuple(begin), tuple(end), layout.names)


def read_fwf(
    spark: SparkSession, file, col_positions: Layout | None = None, col_types=None, col_select=None, id: str | None = None,
    locale: Locale | None = None, na: Sequence[str] = ("", "NA"), comment: str = "", skip_empty_rows: bool = True, trim_ws: bool = True,
    skip: int = 0, n_max: float = math.inf, guess_max: int = 100, name_repair="unique",
) -> RectFrame:
    """Read fixed-width files; places are bytes of the UTF-8 text, and may overlap.

    Blank and comment lines are left out before the first record only. Without ``col_positions``
    the first lines of the first file tell the columns, and one pass over all lines their ends.
    """
    loc = locale or default_locale()
    sources = file if isinstance(file, (list, tuple)) else [file]
    layout = col_positions or fwf_empty(spark, sources[0], skip, comment=comment)
    inputs, charset = resolve(spark, sources, loc.encoding)
    paths = {x.path: x.shown for x in inputs}
    d = Dialect(quote="", comment=comment, trim_ws=trim_ws, skip_empty_rows=skip_empty_rows)
    df = spark.read.text(list(paths)).select("value", _path_column(paths).alias("path"), F.col("_metadata.file_block_start").alias("block"))
    df = decoded(df, charset)
    if skip > 0 or comment or _blank_first(spark, inputs, charset, skip_empty_rows):
        df = drop_prefix(df, d, skip, False)
    if col_positions is None:
        layout = _opened(layout, df, comment)
    df = placed(df)
    if 0 <= n_max < math.inf:
        df = first_rows(df, int(n_max))
    names = sp.repair_names(list(layout.names), name_repair)
    collectors = sp.standardise(sp.as_col_spec(col_types), names)
    columns = names + ([id] if id else [])
    chosen = sel.resolve(col_select, columns)
    if id:
        chosen = [x for x in chosen if x[0] == id] + [x for x in chosen if x[0] != id] if col_select is None else chosen
        chosen = chosen if id in [old for old, _ in chosen] else [(id, id), *chosen]
    wanted = {old for old, _ in chosen}
    collectors = [c if n in wanted else sp.col_skip() for n, c in zip(names, collectors)]

    def cut(k: int) -> Column:
        data = F.col("value").cast("binary")
        b, e = layout.begin[k], layout.end[k]
        x = F.decode(F.substring(data, F.lit(b + 1), F.lit(1 << 30) if e is None else F.lit(e - b)), "UTF-8")
        return F.btrim(x, F.lit(" \t\r\x00")) if trim_ws else x

    used = [k for k, c in enumerate(collectors) if c.kind != "skip"]
    texts = df.select(*_AT, *[cut(k).alias(f"c{k}") for k in used])
    if na:
        texts = texts.select(*_AT, *[F.when(~F.col(f"c{k}").isin(*na), F.col(f"c{k}")).alias(f"c{k}") for k in used])

    guessing = [k for k, c in enumerate(collectors) if c.kind == "guess"]
    if guessing:
        found = splits(df)
        for k, kind in zip(guessing, guess_types(pick(texts, found, survey(found, guess_max), guess_max), [f"c{k}" for k in guessing], loc)):
            collectors[k] = sp.Collector(kind)
    parsed = {names[k]: parse_column(F.col(f"c{k}"), collectors[k].kind, loc, collectors[k].format, collectors[k].levels) for k in used}
    if id:
        parsed[id] = F.col("path")

    def problems() -> DataFrame:
        found = []
        for k in used:
            c, x = collectors[k], F.col(f"c{k}")
            if c.kind == "character":
                bad, told, actual = x.contains("\x00"), "", F.lit("embedded null")
            else:
                bad, told, actual = x.isNotNull() & parse_column(x, c.kind, loc, c.format, c.levels).isNull(), expected(c.kind, c.format), x
            found.append(F.when(bad, F.struct(F.lit(k + 1).alias("col"), F.lit(told).alias("expected"), actual.alias("actual"))))
        listed = texts.select(*_AT, F.explode(F.filter(F.array(*found), lambda p: p.isNotNull())).alias("p"))
        return numbered(listed, df.select(*_AT)).select(F.col("ordinal").alias("row"), "p.col", "p.expected", "p.actual", F.col("path").alias("file"))

    out = [parsed[old].alias(new) for old, new in chosen if old in parsed]
    spec = sp.ColSpec({n: c for n, c in zip(names, collectors) if c.kind != "skip"})
    return RectFrame(texts.select(*out), spec, problems if used else None, texts, out)


def _blank_first(spark: SparkSession, inputs, charset: str | None, skip_empty_rows: bool) -> bool:
    """Whether blank lines may come before the first record: by the first line of a single file, in general for several."""
    if not skip_empty_rows:
        return False
    if sum(len(x.files) for x in inputs) > 1:
        return True
    return any(is_blank(line) for x in inputs for line in head_lines(spark, x.first, 1, charset))


def read_lines(
    spark: SparkSession, file, n_max: float = math.inf, skip: int = 0, na: Sequence[str] = (), skip_empty_rows: bool = False, locale: Locale | None = None
) -> DataFrame:
    """One column ``V1`` with the lines of all files."""
    loc = locale or default_locale()
    inputs, charset = resolve(spark, file, loc.encoding)
    paths = {x.path: x.shown for x in inputs}
    df = spark.read.text(list(paths)).select("value", _path_column(paths).alias("path"), F.col("_metadata.file_block_start").alias("block"))
    df = decoded(df, charset)
    if skip > 0:
        df = drop_prefix(df, Dialect(quote="", skip_empty_rows=skip_empty_rows), skip, False)
    if skip_empty_rows:
        df = df.where(F.trim(F.translate("value", "\t\r\x00", "   ")) != "")
    if 0 <= n_max < math.inf:
        df = first_rows(placed(df), int(n_max))
    x = F.col("value")
    return df.select((F.when(~x.isin(*na), x) if na else x).alias("V1"))
