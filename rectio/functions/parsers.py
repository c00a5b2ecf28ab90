"""One expression per column type, from text to value; what does not parse is null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rectio.functions.datetimes import let, looks_like_date, looks_like_time, parse_date, parse_datetime, parse_time
from rectio.functions.locale import Locale

# Spellings of truth.
TRUE = ["T", "t", "True", "TRUE", "true"]
FALSE = ["F", "f", "False", "FALSE", "false"]


def parse_logical(x: Column) -> Column:
    return F.when(x.isin(*TRUE, "1"), True).when(x.isin(*FALSE, "0"), False)


def parse_integer(x: Column, kind: str = "int") -> Column:
    """Digits after at most a minus; the cast alone would also take a plus and blanks at the ends."""
    ends = (x >= "-") & (x < ":") & F.substring(x, -1, 1).between("0", "9")
    return F.when(ends, x.try_cast(kind))


def _mark(mark: str) -> str:
    return re.escape(mark)


def parse_double(x: Column, loc: Locale) -> Column:
    m = _mark(loc.decimal_mark[:1])
    guard = rf"^[+-]?(?:(?i:nan|inf)|(?:[0-9]+(?:{m}[0-9]*)?|{m}[0-9]+)(?:[EeSsFfDdLl][+-]?[0-9]+)?)$"

    def unusual(t: Column) -> Column:
        plain = F.regexp_replace(t, m, ".") if loc.decimal_mark != "." else t
        plain = F.regexp_replace(plain, "[EeSsFfDdLl](?=[+-]?[0-9]+$)", "e")
        special = F.lower(F.regexp_replace(t, "^[+-]", ""))
        infinite = F.when(t.startswith("-"), float("-inf")).otherwise(float("inf"))
        value = F.when(special == "nan", float("nan")).when(special == "inf", infinite).otherwise(plain.try_cast("double"))
        return F.when(t.rlike(guard), value)

    if loc.decimal_mark[:1] != ".":
        return F.when(x.rlike("^[+-]?[0-9]+$"), x.try_cast("double")).otherwise(let(x, unusual))
    # without letters the cast takes what the guard does, but for white space at the ends
    ends = (x >= "+") & F.substring(x, -1, 1).between(".", "9")
    return F.when(F.upper(x) == F.lower(x), F.when(ends, x.try_cast("double"))).otherwise(let(x, unusual))


def _number_pattern(loc: Locale) -> tuple[str, str, str]:
    mark, group = _mark(loc.decimal_mark), _mark(loc.grouping_mark) if loc.grouping_mark else "(?!)"
    digits = f"(?:[0-9]|{group})*"
    return mark, group, f"(-?(?:{digits}{mark}{digits}|{digits})(?:(?<=[0-9])[eE][+-]?[0-9]+)?)"


def parse_number(x: Column, loc: Locale) -> Column:
    """The first number in the text; grouping marks are skipped on both sides of the decimal mark."""
    mark, group, body = _number_pattern(loc)
    found = F.regexp_extract(x, f"(?s)^(?:(?!-|{mark}|[0-9]).)*{body}", 1)
    plain = F.regexp_replace(F.regexp_replace(found, group, ""), mark, ".")
    return plain.try_cast("double")


def parse_factor(x: Column, levels: list[str | None] | None) -> Column:
    return x if levels is None else F.when(x.isin(*[v for v in levels if v is not None]), x)


def parse_column(x: Column, kind: str, loc: Locale, fmt: str | None = None, levels: list | None = None) -> Column:
    """Value of a text that is present."""
    if kind == "logical":
        return parse_logical(x)
    if kind == "integer":
        return parse_integer(x)
    if kind == "big_integer":
        return parse_integer(x, "bigint")
    if kind == "double":
        return parse_double(x, loc)
    if kind == "number":
        return parse_number(x, loc)
    if kind == "factor":
        return parse_factor(x, levels)
    if kind == "date":
        return parse_date(x, fmt, loc)
    if kind == "time":
        return parse_time(x, fmt, loc)
    if kind == "datetime":
        return parse_datetime(x, fmt, loc)
    return F.substring_index(x, "\x00", 1)


SPARK_TYPES = {
    "logical": "boolean", "integer": "int", "big_integer": "bigint", "double": "double", "number": "double", "character": "string",
    "factor": "string", "date": "date", "datetime": "timestamp", "time": "interval day to second",
}

# What a problem tells was expected.
EXPECTED = {
    "logical": "1/0/T/F/TRUE/FALSE", "integer": "an integer", "big_integer": "a big integer", "double": "a double", "number": "a number",
    "factor": "value in level set", "character": "embedded null",
}


def expected(kind: str, fmt: str | None) -> str:
    if kind in EXPECTED:
        return EXPECTED[kind]
    name = "time" if kind == "time" else "date"
    return f"{name} like {fmt}" if fmt else f"{name} in ISO8601"


def can_parse(x: Column, kind: str, loc: Locale) -> Column:
    """Whether a guess may settle on a type; numbers don't begin with a zero that a digit follows."""
    mark = _mark(loc.decimal_mark[:1])
    leading = x.rlike("^[+-]?0[0-9]") if kind != "number" else x.rlike("^-?0[0-9]")
    if kind == "logical":
        return x.isin(*TRUE, *FALSE)
    if kind in ("integer", "double"):
        return parse_column(x, kind, loc).isNotNull() & ~leading
    if kind == "number":
        whole = x.rlike(f"^{_number_pattern(loc)[2]}$") & x.rlike(f"^-?[0-9{mark}]")
        return whole & parse_number(x, loc).isNotNull() & ~leading
    if kind == "date":
        return looks_like_date(x, None, loc)
    if kind == "time":
        return looks_like_time(x, loc)
    return parse_column(x, kind, loc).isNotNull()


GUESS_ORDER = ["logical", "integer", "double", "number", "time", "date", "datetime"]
