"""Delimited text as typed DataFrames.

Files whose records are lines are read by Spark's text source in splits; a header alone before the
data is dropped by a line-wise csv scan, a longer prefix by an Arrow pass over the first split.
Records that hold line feeds are joined from the lines of their split, and across splits piece by piece.
"""

from __future__ import annotations

import math
import uuid
import warnings
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rectio.functions import tokens as tk
from rectio.functions.datetimes import let
from rectio.functions.locale import Locale, default_locale
from rectio.functions.parsers import expected, parse_column
from rectio.operators.guess import guess_types
from rectio.plans import select as sel
from rectio.plans import spec as sp
from rectio.sources.rows import at_numbers, first_rows, numbered, pick, placed, splits, survey
from rectio.sources.sniff import LATIN, Prefix, closed, decoded, first_record, guess_delim, is_blank, read_head
from rectio.sources.staging import Input, first_bytes, resolve, shared_folder

_AT = ["path", "block", "at"]


class ParseIssue(UserWarning):
    """Some values of the input did not parse."""


@dataclass
class RectFrame:
    """A typed DataFrame with its specification; :meth:`problems` is computed when asked for."""

    df: DataFrame
    spec: sp.ColSpec
    _problems: Callable[[], DataFrame] | None = None
    _texts: DataFrame | None = None
    _out: list[Column] | None = None

    def problems(self) -> DataFrame:
        """``row, col, expected, actual, file`` of what did not parse; rows count the header."""
        if self._problems is None:
            schema = "row long, col int, expected string, actual string, file string"
            return self.df.sparkSession.createDataFrame([], schema)
        return self._problems().distinct().orderBy("file", "row", "col")

    def warn(self) -> bool:
        """Look for problems, and warn of a :class:`ParseIssue` if there are any."""
        some = self._problems is not None and not self._problems().isEmpty()
        if some:
            warnings.warn("some values did not parse; see problems()", ParseIssue, stacklevel=2)
        return some

    def show_col_types(self) -> str:
        """Delimiter and columns by type, printed and returned; rows aren't counted, for that would read them."""
        kinds = self.spec.summary()
        lines = [f"Columns: {sum(map(len, kinds.values()))}"] + ([f"Delimiter: {self.spec.delim!r}"] if self.spec.delim else [])
        lines += [f"{kind} ({len(names)}): {', '.join(names)}" for kind, names in kinds.items()]
        print("\n".join(lines))
        return "\n".join(lines)

    def rows(self, numbers: Sequence[int | None], name: str = "row") -> DataFrame:
        """The rows with these numbers, from 1 on over all files by name; ``name`` tells their order.

        A number beyond the last row, or None, gives a row of nulls; one may be asked for twice.
        """
        own = sorted({k for k in numbers if k is not None})
        if self._texts is None:
            picked = self.df.limit(0).select(F.lit(0).alias("__number"), *self.df.columns)
        else:
            picked = at_numbers(self._texts, own).select(F.col("number").alias("__number"), *self._out)
        asked = self.df.sparkSession.createDataFrame([(i + 1, k) for i, k in enumerate(numbers)], "__asked int, __number long")
        return asked.join(picked, "__number", "left").select(F.col("__asked").alias(name), *[F.col(f"`{c}`") for c in self.df.columns])

    def levels(self, name: str) -> DataFrame:
        """``(level, code)`` of a factor: as specified, or by first appearance over all files by name.

        With ``include_na`` a null is a level as well, where it appears first.
        """
        meta = next(f.metadata for f in self.df.schema.fields if f.name == name)
        if meta.get("levels") is not None:
            levels = [*meta["levels"], *([None] if meta["na_level"] else [])]
            return self.df.sparkSession.createDataFrame([(v, k + 1) for k, v in enumerate(levels)], "level string, code int")
        if self._texts is None:
            return self.df.sparkSession.createDataFrame([], "level string, code int")
        seen = self._texts.select(*_AT, self._out[self.df.columns.index(name)].alias("level"))
        seen = seen if meta.get("na_level") else seen.where(F.col("level").isNotNull())
        first = seen.groupBy("level").agg(F.min(F.struct(*_AT)).alias("first"))
        return first.select("level", F.row_number().over(Window.orderBy("first")).alias("code"))


def _path_column(paths: dict[str, str]) -> Column:
    """The caller's name of the file that a row is from."""
    whole = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    known = {p.removeprefix("file://").removeprefix("file:"): shown for p, shown in paths.items()}
    pairs = [F.lit(x) for p, shown in known.items() if p != shown for x in (p, shown)]
    return F.coalesce(F.create_map(*pairs)[whole], whole) if pairs else whole


def _blank(value: Column) -> Column:
    return F.trim(F.translate(value, "\t\r\x00", "   ")) == ""


def drop_prefix(df: DataFrame, d: tk.Dialect, skip: int, header: bool) -> DataFrame:
    """Rows ``(value, path, block)`` without the lines before the data of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = prefix = None
        for batch in batches:
            keep = []
            for line, path, block in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (path, block) != last:
                    last, prefix = (path, block), Prefix(d, skip, header)
                keep.append(block > 0 or not prefix.before(line))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _lines(spark: SparkSession, paths: dict[str, str], d: tk.Dialect, skip: int, header: bool, charset: str | None) -> DataFrame:
    """``(value, path, block)`` of every data line."""
    meta = (_path_column(paths).alias("path"), F.col("_metadata.file_block_start").alias("block"))
    plain = skip <= 0 and not d.comment and d.skip_empty_rows
    if header and plain and (charset is None or charset in LATIN):
        # the csv source drops each file's first line; a line with its separator comes whole as a corrupt record
        mark = "\x01" if d.delim != "\x01" else "\x02"
        scan = spark.read.option("header", True).option("sep", mark).option("maxColumns", 200_000).option("quote", "").option("escape", "").option("mode", "PERMISSIVE")
        scan = scan.option("columnNameOfCorruptRecord", "whole").option("encoding", "ISO-8859-1" if charset else "UTF-8")
        df = scan.schema("value string, whole string").csv(list(paths)).select(F.coalesce("whole", "value", F.lit("")).alias("value"), *meta)
    else:
        df = decoded(spark.read.text(list(paths)).select("value", *meta), charset)
        if header or skip > 0:
            df = drop_prefix(df, d, skip, header)
    if d.comment:
        df = df.where(~F.col("value").startswith(d.comment)).withColumn("value", tk.uncommented(F.col("value"), d))
    if d.skip_empty_rows:
        df = df.where(~_blank(F.col("value")))
    return df


@dataclass
class _Split:
    """What a split's lines do to each state that may come before them, and what does come before them."""

    ends: list[int]
    begins: list[bool]  # whether a record begins here
    filled: bool  # whether it has a line that may be a header
    state: int = tk.CLOSED
    origin: int = 0  # the split in which the record before the first line began
    header: bool = False  # whether its first record is the header


def _split_states(lines: DataFrame, d: tk.Dialect, blanks: bool, header: bool) -> dict[tuple[str, int], _Split]:
    """Each split's state, from one small row of every split of ``lines(value, path, block)``."""
    states = range(4 if d.escape_backslash else 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        for batch in batches:
            for line, path, block in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not out or (path, block) != tuple(out[-1][:2]):
                    out.append([path, block, [*states], [s == tk.CLOSED for s in states], False])
                row = out[-1]
                after = {s: tk.after_line(line, s, d)[1] for s in set(row[2])}
                row[2] = [after[s] for s in row[2]]
                row[3] = [x or s == tk.CLOSED for x, s in zip(row[3], row[2])]
                row[4] = row[4] or blanks or not is_blank(line)
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.bool_()]
        names = ["path", "block", "ends", "begins", "filled"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    found = lines.mapInArrow(run, "path string, block long, ends array<long>, begins array<boolean>, filled boolean").collect()
    out, last = {}, None
    for r in sorted(found, key=lambda r: (r["path"], r["block"])):
        now = _Split(list(r["ends"]), list(r["begins"]), r["filled"], origin=r["block"], header=header)
        if last is not None and last[0] == r["path"]:
            before = out[last]
            now.state, now.header = before.ends[before.state], before.header and not before.filled
            if now.state != tk.CLOSED:
                now.origin = last[1] if before.begins[before.state] else before.origin
        last = (r["path"], r["block"])
        out[last] = now
    return out


def _joined(spark: SparkSession, paths: dict[str, str], d: tk.Dialect, skip: int, header: bool, charset: str | None) -> DataFrame:
    """``(value, path, block)`` of every data record of files whose records may hold line feeds.

    A small row of each split tells the state in which the next one begins, so every split joins its
    own lines. Of a record that crosses splits each has a piece; the pieces are gathered by record.
    """
    lines = decoded(spark.read.text(list(paths)).select("value", _path_column(paths).alias("path"), F.col("_metadata.file_block_start").alias("block")), charset)
    if skip > 0 or d.comment:
        lines = drop_prefix(lines, d, skip, False)
    blanks = not (d.skip_empty_rows or d.comment)
    known = _split_states(lines, d, blanks, header)

    def records(pieces: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Whole records, or the pieces of those that cross splits with the split of each piece."""
            last, parts, state, origin, begun, head = None, [], tk.CLOSED, 0, True, False
            for batch in batches:
                out: list[tuple] = []
                for line, path, block in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    if (path, block) != last:
                        if parts and pieces and not (begun and head):
                            out.append(("\n".join(parts), last[0], origin, last[1]))
                        last, parts, now = (path, block), [], known[path, block]
                        state, origin, begun, head = now.state, now.origin, now.state == tk.CLOSED, now.header
                    if state == tk.CLOSED:
                        parts, origin, begun = [], block, True
                    end, state = tk.after_line(line, state, d)
                    parts.append(line[:end])
                    if state == tk.CLOSED:
                        if not begun:
                            if pieces:
                                out.append(("\n".join(parts), path, origin, block))
                        elif blanks or len(parts) > 1 or not is_blank(parts[0]):
                            if head:
                                head = False
                            elif not pieces:
                                out.append(("\n".join(parts), path, block, block))
                        parts = []
                yield _rows(out)
            if parts and pieces and not (begun and head):
                yield _rows([("\n".join(parts), last[0], origin, last[1])])

        return lines.mapInArrow(run, "value string, path string, block long, piece long")

    whole = records(False).drop("piece")
    if all(x.state == tk.CLOSED == x.ends[x.state] for x in known.values()):
        return whole
    # a header that crosses splits has no first piece
    crossing = records(True).groupBy("path", "block").agg(F.sort_array(F.collect_list(F.struct("piece", "value"))).alias("found")).where("found[0].piece = block")
    folder = f"{shared_folder(spark, 'records')}/{uuid.uuid4().hex}"
    crossing.select(F.array_join("found.value", "\n").alias("value"), "path", "block").write.parquet(folder)
    return whole.unionByName(spark.read.parquet(folder))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"value": pa.string(), "path": pa.string(), "block": pa.int64(), "piece": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def read_delim(
    spark: SparkSession, file, delim: str | None = None, col_names: bool | Sequence[str] = True, col_types=None, col_select=None,
    id: str | None = None, skip: int = 0, n_max: float = math.inf, na: Sequence[str] = ("", "NA"), quote: str = '"', comment: str = "",
    skip_empty_rows: bool = True, trim_ws: bool = True, escape_double: bool = True, escape_backslash: bool = False,
    locale: Locale | None = None, guess_max: int = 100, name_repair="unique", multiline: bool | None = None, guess_integer: bool = False, width: int | None = None,
) -> RectFrame:
    """Read delimited files.

    ``file`` is a path, literal :class:`I`, bytes, file object or URL, or a list of them; all must
    have the same columns. Without ``multiline`` one aggregate pass looks for records that hold
    line feeds. ``width`` is the number of columns where the first record can't tell it.
    Row order is that of the files only where ``n_max`` asks for it.
    """
    loc = locale or default_locale()
    spec = sp.as_col_spec(col_types)
    delim = delim if delim is not None else spec.delim
    if delim == "":
        raise ValueError("delim must not be empty")
    delim = "\x01" if delim == "\n" else delim
    if n_max < 0:
        n_max = math.inf
    inputs, charset = resolve(spark, file, loc.encoding)
    paths = {x.path: x.shown for x in inputs}
    d = tk.Dialect(delim or ",", quote, comment, trim_ws, escape_double, escape_backslash, skip_empty_rows)
    heads = {x.path: read_head(spark, x.first, d, skip, charset) for x in inputs}
    if delim is None:
        filled = next((h for h in heads.values() if h.lines), None)
        d = replace(d, delim=guess_delim(filled.lines, quote) if filled else ",")
    # names and width from the first record of each file
    given = None if isinstance(col_names, bool) else list(col_names)
    header, widths, raw_names = {}, {}, {}
    for p, h in heads.items():
        record, n = first_record(h.lines, d)
        header[p] = n if col_names is True and h.lines else 0
        fields = [tk.content_py(x, d) for x in tk.split_py(record, d)] if h.lines else []
        widths[p], raw_names[p] = len(fields), fields
    filled = [p for p in paths if widths[p]]
    fixed = width is not None
    if not fixed:
        width = widths[filled[0]] if filled else (len(given) if given else len(spec.cols))
    for p in [] if fixed else filled[1:]:
        if widths[p] != width:
            raise ValueError(f"files must all have {width} columns: '{paths[p]}' has {widths[p]}")
        if col_names is True and raw_names[p] != raw_names[filled[0]]:
            raise ValueError(f"files must have the same column names: '{paths[p]}' differs")
    if given is not None:
        kept = [c for c in sp.standardise(replace(spec, cols=spec.cols), sp.make_names(None, width)) if c.kind != "skip"] if all(isinstance(k, int) for k in spec.cols) else None
        names = sp.make_names(given, width)
        if kept is not None and len(given) == len(kept) < width:
            types = sp.standardise(spec, sp.make_names(None, width))
            rest = iter(given)
            names = [next(rest) if c.kind != "skip" else f"X{k + 1}" for k, c in enumerate(types)]
    elif col_names and filled:
        names = raw_names[filled[0]]
    else:
        names = sp.make_names(list(spec.cols) if spec.cols and not all(isinstance(k, int) for k in spec.cols) and not filled else None, width)
    names = sp.repair_names(names, name_repair)
    collectors = sp.standardise(spec, names)
    columns = names + ([id] if id else [])
    chosen = sel.resolve(col_select, columns)
    if id and id not in [old for old, _ in chosen]:
        chosen = [(id, id), *chosen]
    elif id and col_select is None:
        chosen = [(id, id)] + [x for x in chosen if x[0] != id]
    wanted = {old for old, _ in chosen}
    collectors = [c if n in wanted else sp.col_skip() for n, c in zip(names, collectors)]
    if not filled or n_max == 0:
        collectors = [sp.col_character() if c.kind == "guess" else c for c in collectors]
        schema = sp.to_struct(names, collectors)
        empty = spark.createDataFrame([], schema)
        empty = empty.withColumn(id, F.lit(None).cast("string")) if id else empty
        done = {n: c for n, c in zip(names, collectors) if c.kind != "skip"}
        return RectFrame(empty.select(*[F.col(f"`{old}`").alias(new) for old, new in chosen if old in empty.columns]), sp.ColSpec(done, spec.default, d.delim))
    live = {x.path: x.shown for x in inputs if widths[x.path]}
    if not fixed:
        _check_headers(spark, inputs, d, skip, charset, width, raw_names[filled[0]] if col_names is True else None)
    guessing = [k for k, c in enumerate(collectors) if c.kind == "guess"]
    most = guess_max if guessing else 0
    if multiline is None and any(header[p] > 1 for p in live):
        multiline = True
    how = (spark, live, d, skip, col_names is True, charset)
    rows = placed((_joined if multiline else _lines)(*how))
    found, told = splits(rows), None
    if multiline is None and quote:
        # one pass over the lines tells whether quotes hold line feeds, and where the rows to guess from are
        found = splits(rows, open=F.max(tk.is_open(F.col("value"), d)))
        told = survey(found, most)
        multiline = bool(told["open"])
        if multiline:
            rows = placed(_joined(*how))
            found, told = splits(rows), None
    if n_max < math.inf:
        rows = first_rows(rows, int(n_max))
        found, told = splits(rows), None
    fields = rows.select(*_AT, F.explode(F.array(F.struct(tk.tokens(F.col("value"), d, to_end=bool(multiline)).alias("raw"), tk.special(F.col("value"), d).alias("marked")))).alias("t"))
    # the explode keeps Catalyst from splitting a record once for each column that uses it; every
    # further step binds what the next one uses more than once
    fields = fields.select(*_AT, "t.marked", F.size("t.raw").alias("size"), tk.widened(F.col("t.raw"), d, width).alias("tok"))
    used = [k for k, c in enumerate(collectors) if c.kind != "skip"]
    texts = fields.select(*_AT, "size", *[tk.field(F.get("tok", F.lit(k)), d, F.col("marked"), na).alias(f"c{k}") for k in used])
    if guessing:
        picked = pick(texts, found, told or survey(found, most), most)
        kinds = guess_types(picked, [f"c{k}" for k in guessing], loc, guess_integer)
        for k, kind in zip(guessing, kinds):
            collectors[k] = sp.Collector(kind)
    parsed = {}
    for k in used:
        c = collectors[k]
        parsed[names[k]] = parse_column(F.col(f"c{k}"), c.kind, loc, c.format, c.levels)
    if id:
        parsed[id] = F.col("path")
    out = []
    for old, new in chosen:
        if old not in parsed:
            continue
        c = collectors[names.index(old)] if old in names else None
        if c is not None and c.kind == "factor":
            levels = [v for v in c.levels if v is not None] if c.levels else None
            out.append(parsed[old].alias(new, metadata={"levels": levels, "na_level": bool(c.levels and None in c.levels) or c.include_na, "ordered": c.ordered}))
        else:
            out.append(parsed[old].alias(new))
    df = texts.select(*out)
    done = {n: c for n, c in zip(names, collectors) if c.kind != "skip"}
    problems = partial(_problems, texts, collectors, loc, width, any(header.values()))
    return RectFrame(df, sp.ColSpec(done, spec.default, d.delim), problems, texts, out)


def _check_headers(spark: SparkSession, inputs: list[Input], d: tk.Dialect, skip: int, charset: str | None, width: int, names: list[str] | None) -> None:
    """All files of folders have as many columns as the first one, and the same names, by their first records."""
    files = [f for x in inputs if len(x.files) > 1 for f in x.files]

    def fields(file: str) -> list[str] | None:
        n = 1 << 14
        while True:
            raw = first_bytes(spark, file, n, plain=True)
            lines, prefix = raw.decode(charset or "utf-8-sig", "replace").splitlines(), Prefix(d, skip, False)
            lines = lines[: len(lines) - (len(raw) == n)]  # the last one may go on
            own = [line for line in lines if not prefix.before(line)]
            record, _ = first_record(own, d)
            if len(raw) < n or (own and closed(record, d)):
                return [tk.content_py(x, d) for x in tk.split_py(record, d)] if own else None
            n *= 8

    with ThreadPoolExecutor(16) as pool:
        for file, found in zip(files, pool.map(fields, files)):
            if found is not None and len(found) != width:
                raise ValueError(f"files must all have {width} columns: '{file}' has {len(found)}")
            if found is not None and names is not None and found != names:
                raise ValueError(f"files must have the same column names: '{file}' differs")


def _problems(texts: DataFrame, collectors, loc: Locale, width: int, has_header: bool) -> DataFrame:
    size = F.col("size")
    found = [
        F.when(size != width, F.struct(size.cast("int").alias("col"), F.lit(f"{width} columns").alias("expected"), F.concat(size.cast("string"), F.lit(" columns")).alias("actual")))
    ]
    for k, c in enumerate(collectors):
        if c.kind in ("skip", "guess"):
            continue
        x = F.col(f"c{k}")
        if c.kind == "character":
            bad = x.contains("\x00")
            told = (F.lit(""), F.lit("embedded null"))
        else:
            bad = x.isNotNull() & parse_column(x, c.kind, loc, c.format, c.levels).isNull()
            told = (F.lit(expected(c.kind, c.format)), x)
        found.append(F.when(bad, F.struct(F.lit(k + 1).alias("col"), told[0].alias("expected"), told[1].alias("actual"))))
    told = texts.select(*_AT, F.explode(F.filter(F.array(*found), lambda p: p.isNotNull())).alias("p"))
    listed = numbered(told, texts.select(*_AT))
    return listed.select((F.col("ordinal") + int(has_header)).alias("row"), "p.col", "p.expected", "p.actual", F.col("path").alias("file"))
