"""What the first lines of a file tell: prefix, delimiter, width and header."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rectio.functions.tokens import Dialect

#: Lines that the driver reads first; it reads on while they hold no record.
HEAD_LINES = 1000
# Names of the charset that the JVM decodes.
LATIN = ("ISO8859-1", "ISO-8859-1", "LATIN-1")
# Delimiters that a guess may settle on.
DELIMITERS = [",", "\t", " ", "|", ":", ";"]


@dataclass
class Head:
    """First lines of one file after its prefix; ``prefix`` counts the lines before."""

    prefix: int
    lines: list[str]


def is_blank(line: str) -> bool:
    return line.strip(" \t\r\x00") == ""


def decoded(rows: DataFrame, charset: str | None) -> DataFrame:
    """``rows(value, ...)`` whose values Spark took for UTF-8, read as the charset that they are in."""
    if charset is None:
        return rows
    raw = rows.withColumn("value", F.col("value").cast("binary"))
    if charset in LATIN:
        return raw.withColumn("value", F.decode("value", "ISO-8859-1"))
    names = rows.columns
    at = names.index("value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if x is None else x.decode(charset, "replace") for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], names=names)

    return raw.mapInArrow(run, rows.schema)


def head_lines(spark: SparkSession, path: str, n: int, charset: str | None = None) -> list[str]:
    """The first ``n`` lines of a file, decoded on the driver."""
    rows = spark.read.text(path).select(F.col("value").cast("binary")).take(n)
    return [bytes(r[0]).decode(charset or "utf-8", "replace") for r in rows]


@dataclass
class Prefix:
    """Tells the lines before a file's data: skipped ones, blanks and comments before the first record, and a header.

    A skipped line counts whatever it holds, and a quoted line feed in it takes its next lines along.
    """

    d: Dialect
    skip: int
    header: bool
    inside: bool = False
    done: bool = False
    names: list[str] = field(default_factory=list)

    def before(self, line: str) -> bool:
        """Whether the next line of the file comes before the data."""
        if self.done:
            return False
        if self.inside:
            self.inside = line.count(self.d.quote) % 2 == 0
            return True
        if self.names:
            self.names.append(line)
            self._close()
            return True
        idle = (self.d.skip_empty_rows and is_blank(line)) or (bool(self.d.comment) and line.startswith(self.d.comment))
        if idle or self.skip > 0:
            self.inside = bool(self.d.quote) and not idle and line.count(self.d.quote) % 2 == 1
            self.skip -= 1
            return True
        if self.header:
            self.names = [line]
            self._close()
            return True
        self.done = True
        return False

    def _close(self) -> None:
        if closed("\n".join(self.names), self.d):
            self.header, self.names = False, []
            self.done = True


def closed(record: str, d: Dialect) -> bool:
    """Whether a record ends here, as far as its quotes tell."""
    if not d.quote or record.count(d.quote) % 2 == 0:
        return True
    return not re.search(rf"(^|{re.escape(d.delim)}){re.escape(d.quote)}", record)


def read_head(spark: SparkSession, path: str, d: Dialect, skip: int, charset: str | None = None) -> Head:
    """Lines to skip count blank and comment lines too; more of these go before the first record."""
    n = HEAD_LINES + skip
    while True:
        lines, prefix = head_lines(spark, path, n, charset), Prefix(d, skip, False)
        k = next((k for k, line in enumerate(lines) if not prefix.before(line)), len(lines))
        if k < len(lines) or len(lines) < n:
            return Head(k, lines[k:])
        n *= 8


def first_record(lines: list[str], d: Dialect) -> tuple[str, int]:
    """First record, over several lines if a quoted field holds line feeds, and its number of lines."""
    record = ""
    for k, line in enumerate(lines):
        record = line if k == 0 else f"{record}\n{line}"
        if closed(record, d):
            return record, k + 1
    return (lines[0], 1) if lines else ("", 0)


def guess_delim(lines: list[str], quote: str = '"') -> str:
    """The delimiter whose smallest field count over one holds for most of the first lines."""
    best: tuple[int, int] = (0, 0)
    found = None
    for delim in DELIMITERS:
        counts: Counter[int] = Counter()
        for line in lines[:20]:
            bare = re.sub(f"{quote}[^{quote}]*{quote}", "", line) if quote else line
            parts = bare.split(delim)
            counts[len(parts) - (parts[-1] == "" and len(parts) > 1)] += 1
        if not counts:
            continue
        width = min(counts)
        if width < 2:
            continue
        score = (counts[width], width)
        if score > best:
            best, found = score, delim
    if found is None:
        raise ValueError("could not guess the delimiter; give one with delim")
    return found
