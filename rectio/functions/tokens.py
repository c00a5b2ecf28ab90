"""Fields of delimited records as Spark expressions.

A record is a regular language over fields, so one regular expression splits it: a field is quoted
only if the quote is its first character, text after a closing quote stays in the field, and a
delimiter or comment inside quotes is plain text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rectio.functions.datetimes import let

_BLANKS = " \t\r\x00"


@dataclass(frozen=True)
class Dialect:
    delim: str = ","
    quote: str = '"'
    comment: str = ""
    trim_ws: bool = True
    escape_double: bool = True
    escape_backslash: bool = False
    skip_empty_rows: bool = True


def _quote(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in text)


def _field(d: Dialect, stop: str = "", to_end: bool = False) -> str:
    """Pattern of one field that does not cross a delimiter, nor ``stop`` characters outside quotes.

    With ``to_end`` a quote that never closes takes the rest of the text.
    """
    delim, not_comment = _quote(d.delim), f"(?!{_quote(d.comment)})" if d.comment else ""
    escaped, back = (r"\\.|", r"\\") if d.escape_backslash else ("", "")
    any_ = f"[^{back}{stop}]" if back or stop else "."
    plain = f"(?:{escaped}{not_comment}(?!{delim}){any_})*+"
    if not d.quote:
        return plain
    q = _quote(d.quote)
    inside = f"(?:{escaped}[^{q}{back}])*+" if escaped else f"[^{q}]*+"
    between = f"(?:{escaped}{not_comment}(?!{delim})[^{q}{back}{stop}])*+"
    closed = f"{q}{between}"
    return f"(?:{q}{inside}(?:{q}{between}{q}{inside})*+{f'(?:{closed}|\\z)' if to_end else closed}|(?!{q}){plain})"


def special(record: Column, d: Dialect) -> Column:
    """Whether a record holds a quote, escape or comment; most don't."""
    marks = [mark for mark in (d.quote, "\\" if d.escape_backslash else "", d.comment) if mark]
    return reduce(lambda a, b: a | b, [record.contains(mark) for mark in marks]) if marks else F.lit(False)


def tokens(record: Column, d: Dialect, to_end: bool = False) -> Column:
    """Raw fields of a record, quotes and blanks kept; for a quote left open see :func:`is_open`."""
    plain = F.split(record, _quote(d.delim), -1)
    if not (d.quote or d.escape_backslash or d.comment):
        return plain
    found = F.regexp_extract_all(F.concat(F.lit(d.delim), record), F.lit(f"(?s){_quote(d.delim)}({_field(d, to_end=to_end)})"), F.lit(1))
    # splitting is several times as fast
    return F.when(special(record, d), found).otherwise(plain)


def is_open(record: Column, d: Dialect) -> Column:
    """Whether a quote is still open at the end of a record: then its fields lose some of its text."""
    if not d.quote:
        return F.lit(False)
    kept = F.aggregate(tokens(record, d), F.lit(0), lambda n, t: n + F.length(t) + len(d.delim))
    return kept != F.length(record) + len(d.delim)


def uncommented(record: Column, d: Dialect) -> Column:
    """A line up to its first comment outside quotes."""
    if not d.comment:
        return record
    field = _field(d)
    return F.regexp_extract(record, f"(?s)^({field}(?:{_quote(d.delim)}{field})*+)", 1)


def records(text: Column, d: Dialect) -> Column:
    """Records of a whole text: line feeds inside quotes belong to their record."""
    field = _field(d, "\n", to_end=True)
    comment = f"(?:{_quote(d.comment)}[^\n]*+)?" if d.comment else ""
    pattern = f"(?s)\n({field}(?:{_quote(d.delim)}{field})*+){comment}"
    return F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(pattern), F.lit(1))


def widened(raw: Column, d: Dialect, width: int) -> Column:
    """Fields cut to ``width``: what is too much stays glued to the last one."""
    rest = F.array_join(F.slice(raw, width, F.greatest(F.size(raw) - width + 1, F.lit(1))), d.delim)
    glued = F.concat(F.slice(raw, 1, width - 1), F.array(rest)) if width > 1 else F.array(rest)
    return F.when(F.size(raw) > width, glued).otherwise(raw)


def field(token: Column, d: Dialect, marked: Column, na: Sequence[str]) -> Column:
    """:func:`content` of a raw field, null if it is one of ``na``; ``marked`` tells whether its record holds anything :func:`special`.

    Few fields need more than two looks at their ends. What they need is bound by ``let``, which also
    keeps it out of the generated method, so that this stays small enough to be compiled.
    """
    known = (lambda x: F.when(~x.isin(*na), x)) if na else (lambda x: x)
    out = known(token)
    if d.trim_ws:
        blank = reduce(lambda a, b: a | b, [token.endswith(c) for c in _BLANKS], token < "!")
        out = F.when(blank, let(F.btrim(token, F.lit(_BLANKS)), known)).otherwise(out)
    if d.quote or d.escape_backslash:
        out = F.when(marked, let(token, lambda t: let(content(t, d), known))).otherwise(out)
    return out


def content(token: Column, d: Dialect) -> Column:
    """Value of a raw field: trimmed, unquoted, trimmed again, escapes resolved."""
    trim = (lambda x: F.btrim(x, F.lit(_BLANKS))) if d.trim_ws else (lambda x: x)
    x = trim(token)
    if d.quote:
        q = _quote(d.quote)
        inner = trim(F.regexp_replace(F.substring(x, F.lit(2), F.length(x)), f"{q}$", ""))
        if d.escape_double:
            inner = F.when(F.contains(inner, F.lit(d.quote)), F.regexp_replace(inner, f"(?s){q}(.?)", "$1")).otherwise(inner)
        x = F.when(x.startswith(d.quote), inner).otherwise(x)
    if d.escape_backslash:
        x = F.regexp_replace(x, r"(?s)\\(.)", "$1")
    return x


def split_py(record: str, d: Dialect) -> list[str]:
    """Fields of one record, for the first lines that the driver looks at."""
    out, start, i, state = [], 0, 0, "start"
    while i < len(record):
        if d.escape_backslash and record[i] == "\\":
            i, state = i + 2, "plain" if state == "start" else state
            continue
        c = record[i]
        if state != "quoted" and record.startswith(d.delim, i):
            out.append(record[start:i])
            i += len(d.delim)
            start, state = i, "start"
            continue
        if d.comment and state != "quoted" and record.startswith(d.comment, i):
            record = record[:i]
            break
        if d.quote and c == d.quote and state != "plain":
            state = "ended" if state == "quoted" else "quoted"
        elif state == "start":
            state = "plain"
        i += 1
    return [*out, record[start:]]


# Where a line leaves its record: closed, in quotes, or by an escaped line feed in a plain or a once quoted field.
CLOSED, QUOTED, PLAIN, ENDED = range(4)


@lru_cache(64)
def _marks(d: Dialect) -> tuple[re.Pattern, re.Pattern]:
    """What counts inside quotes and outside; a lone backslash escapes the line feed."""
    escaped, q = [r"\\.?"] if d.escape_backslash else [], [re.escape(d.quote)] if d.quote else []
    outside = [*escaped, re.escape(d.delim), *([re.escape(d.comment)] if d.comment else []), *q]
    return re.compile("|".join([*escaped, *q]), re.S), re.compile("|".join(outside), re.S)


def after_line(line: str, state: int, d: Dialect) -> tuple[int, int]:
    """Where the record's text in a line ends, at a comment or the line's end, and the state after the line."""
    if not ((d.quote and d.quote in line) or (d.escape_backslash and "\\" in line) or (d.comment and d.comment in line)):
        return len(line), QUOTED if state == QUOTED else CLOSED
    inside, outside = _marks(d)
    at = 0
    while m := (inside if state == QUOTED else outside).search(line, at):
        if state == CLOSED and m.start() > at:
            state = PLAIN
        mark, at = m.group(), m.end()
        if d.escape_backslash and mark[0] == "\\":
            state = PLAIN if state == CLOSED else state
            if mark == "\\":
                return len(line), state
        elif state == QUOTED:
            state = ENDED
        elif mark == d.delim:
            state = CLOSED  # a field begins as a record does
        elif mark == d.comment:
            return m.start(), CLOSED
        elif state in (CLOSED, ENDED):
            state = QUOTED
    return len(line), QUOTED if state == QUOTED else CLOSED


def content_py(token: str, d: Dialect) -> str:
    blanks = _BLANKS
    x = token.strip(blanks) if d.trim_ws else token
    if d.quote and x.startswith(d.quote):
        x = x[1:].removesuffix(d.quote)
        x = x.strip(blanks) if d.trim_ws else x
        if d.escape_double:
            x = re.sub(f"(?s){re.escape(d.quote)}(.?)", r"\1", x)
    return re.sub(r"(?s)\\(.)", r"\1", x) if d.escape_backslash else x
