"""Date and time formats, compiled to one anchored pattern and expressions over its groups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from rectio.functions.locale import Locale

_EXPANSIONS = {"D": "%m/%d/%y", "F": "%Y-%m-%d", "R": "%H:%M", "X": "%H:%M:%S", "T": "%H:%M:%S", "x": "%y/%m/%d"}


@dataclass
class Compiled:
    """A pattern, and for each field its groups; ``names`` are those of months or halves of a day."""

    pattern: str
    groups: dict[str, list[int]] = field(default_factory=dict)
    names: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _escape(c: str) -> str:
    return "\\" + c if ord(c) < 128 and not c.isalnum() else c


def _names(names: tuple[str, ...]) -> str:
    return "((?iu)" + "|".join("".join(map(_escape, n.rstrip("."))) + ("\\." if n.endswith(".") else "") for n in sorted(names, key=len, reverse=True)) + ")"


def compile_format(fmt: str, loc: Locale) -> Compiled:
    """Pattern of a format; a malformed format is an error at once, not a null later."""
    out = Compiled("^\\s*")
    count = 0

    def group(key: str, pattern: str, n: int = 1) -> str:
        nonlocal count
        out.groups[key] = list(range(count + 1, count + n + 1))
        count += n
        return pattern

    def read(text: str) -> str:
        made, i = "", 0
        while i < len(text):
            c = text[i]
            if c.isspace():
                made, i = made + "\\s*", i + 1
                continue
            if c != "%":
                made, i = made + _escape(c), i + 1
                continue
            if i + 1 >= len(text):
                raise ValueError("the format ends with %")
            kind, i = text[i + 1], i + 2
            if kind in "OA" and i < len(text):
                kind, i = kind + text[i], i + 1
            if kind in _EXPANSIONS:
                made += read(_EXPANSIONS[kind])
            elif kind == "Y":
                made += group("year", "(\\d{4})")
            elif kind == "y":
                made += group("year2", "(\\d{2})")
            elif kind in "mdHI" and len(kind) == 1:
                made += group({"m": "month", "d": "day", "H": "hour", "I": "hour12"}[kind], "(\\d{1,2})")
            elif kind == "e":
                made += group("day_e", "(?: (\\d)|(\\d{2}))", 2)
            elif kind in ("b", "B"):
                out.names["month"] = loc.date_names.mon_ab if kind == "b" else loc.date_names.mon
                made += group("month_name", _names(out.names["month"]))
            elif kind == "a":
                out.names["weekday"] = loc.date_names.day_ab
                made += group("weekday", _names(loc.date_names.day_ab))
            elif kind == "h":
                made += group("hours", "([+-]?\\d{1,10})")
            elif kind == "M":
                made += group("minute", "(\\d{2})")
            elif kind == "S":
                made += group("second", "(\\d{1,2})(?:\\.\\d*)?")
            elif kind == "OS":
                made += group("fraction", "(\\d{1,2}(?:\\.\\d*)?)")
            elif kind == "p":
                out.names["half"] = loc.date_names.am_pm
                made += group("half", _names(loc.date_names.am_pm))
            elif kind == "z":
                made += group("offset", "(Z|[+-]?\\d{2}(?::?\\d{2})?)")
            elif kind == "Z":
                made += group("zone", "(\\S+)")
            elif kind in (".", "+", "*"):
                made += {".": "\\D", "+": "\\D+", "*": "\\D*"}[kind]
            elif kind == "AD":
                made += read("%Y") + "[-/]" + group("month", "(\\d{2})") + "[-/]" + group("day", "(\\d{2})")
            elif kind == "AT":
                made += group("hour_at", "(\\d{1,2})") + ":" + group("minute", "(\\d{2})") + "(?::" + group("second", "(\\d{2})") + "(?:\\.\\d*)?)?\\s*(?:"
                out.names["half"] = loc.date_names.am_pm
                made += group("half", _names(loc.date_names.am_pm)) + ")?"
            else:
                raise ValueError(f"unsupported format %{kind}")
        return made

    out.pattern += read(fmt) + "\\s*$"
    return out


def compile_iso8601() -> Compiled:
    """The default of date-times: dashed or compact, with any precision from the hour on."""
    date = "(\\d{4})-(\\d{2})-(\\d{2})|(\\d{4})(\\d{2})(\\d{2})"
    clock = "(\\d{2})(\\d{2})(?:(\\d{2}(?:\\.\\d*)?))?|(\\d{2})(?::(\\d{2})(?::(\\d{2}(?:\\.\\d*)?))?)?"
    out = Compiled(f"^\\s*(?:{date})(?:[T ](?:{clock})(Z|[+-]?\\d{{2}}(?::?\\d{{2}})?)?)?\\s*$")
    out.groups = {"year": [1, 4], "month": [2, 5], "day": [3, 6], "hour": [7, 10], "minute": [8, 11], "fraction": [9, 12], "offset": [13]}
    return out


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


_SPLIT = "\x01"


class Fields:
    """Expressions over the groups of a compiled format."""

    def __init__(self, parts: Column, c: Compiled):
        self.parts, self.c = parts, c

    @staticmethod
    def of(x: Column, c: Compiled, build) -> Column:
        """``build(fields)`` where the format fits, with all groups from one match; else null."""
        count = max((k for own in c.groups.values() for k in own), default=0)
        line = "".join(f"${k}{_SPLIT}" for k in range(1, count + 1))
        parts = F.split(F.regexp_replace(x, c.pattern, line), _SPLIT, -1)
        return F.when(x.rlike(c.pattern), let(parts, lambda p: build(Fields(p, c))))

    def text(self, key: str) -> Column | None:
        if key not in self.c.groups:
            return None
        return F.coalesce(*[F.nullif(self.parts[k - 1], F.lit("")) for k in self.c.groups[key]])

    def number(self, key: str, kind: str = "int") -> Column | None:
        found = self.text(key)
        return None if found is None else found.try_cast(kind)

    def first(self, *options: Column | None, default: int = 0) -> Column:
        known = [o for o in options if o is not None]
        return F.coalesce(*known, F.lit(default)) if known else F.lit(default)

    def month(self) -> Column:
        named = self.text("month_name")
        if named is not None:
            named = F.array_position(F.array(*[F.lit(n.lower()) for n in self.c.names["month"]]), F.lower(named)).cast("int")
        return self.first(self.number("month"), named, default=1)

    def year(self) -> Column:
        two = self.number("year2")
        if two is not None:
            two = F.when(two < 69, two + 2000).otherwise(two + 1900)
        return self.first(self.number("year"), two)

    def day(self) -> Column:
        named = self.text("weekday")
        if named is not None:  # a weekday lands in the day, as the format language has it
            named = F.array_position(F.array(*[F.lit(n.lower()) for n in self.c.names["weekday"]]), F.lower(named)).cast("int")
        return self.first(self.number("day"), self.number("day_e"), named, default=1)

    def hour(self) -> tuple[Column, Column]:
        """Hour, and whether it is in range."""
        half, twelve = self.text("half"), self.number("hour12")
        plain = self.first(self.number("hours", "long"), self.number("hour"), self.number("hour_at"))
        ok = F.lit(True)
        if "hour" in self.c.groups:
            ok = plain.between(0, 23)
        if twelve is not None:
            ok, plain = twelve.between(1, 12), twelve % 12
        if half is not None:
            pm = F.lower(half) == self.c.names["half"][1].lower()
            plain = F.when(half.isNull(), plain).otherwise(plain % 12 + F.when(pm, 12).otherwise(0))
        return plain, ok

    def seconds(self) -> Column:
        return self.first(self.number("fraction", "decimal(9,6)"), self.number("second"))


def _date(f: Fields) -> Column:
    parts = [F.lpad(f.year().cast("string"), 4, "0"), F.lpad(f.month().cast("string"), 2, "0"), F.lpad(f.day().cast("string"), 2, "0")]
    return F.concat_ws("-", *parts).try_cast("date")


def parse_date(x: Column, fmt: str | None, loc: Locale) -> Column:
    fmt = fmt or loc.date_format
    if fmt == "%AD":  # the usual spelling needs no pattern
        plain = F.regexp_replace(F.trim(x), "^([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2})$", "$1-$2-$3")
        usual = (F.length(x) == 10) & _at(x, 5, "-") & _at(x, 8, "-")
        return F.coalesce(F.when(usual, x.try_cast("date")), F.when(~usual & looks_like_date(x, fmt, loc), plain.try_cast("date")))
    return Fields.of(x, compile_format(fmt, loc), _date)


def _at(x: Column, place: int, mark: str) -> Column:
    return F.substring(x, place, len(mark)) == mark


def looks_like_date(x: Column, fmt: str | None, loc: Locale) -> Column:
    return x.rlike(compile_format(fmt or loc.date_format, loc).pattern)


def looks_like_time(x: Column, loc: Locale) -> Column:
    return x.rlike(compile_format(loc.time_format, loc).pattern)


def parse_time(x: Column, fmt: str | None, loc: Locale) -> Column:
    """Signed durations; minutes and seconds stay below 60, hours are free with ``%h``."""
    negative = F.regexp_extract(x, r"^\s*(-)", 1) == "-"

    def build(f: Fields) -> Column:
        hour, ok = f.hour()
        minute, second = f.first(f.number("minute")), f.seconds()
        rest = minute.cast("long") * 60_000_000 + (second.cast("decimal(9,6)") * 1_000_000).cast("long")
        total = hour.cast("long") * 3_600_000_000 + F.when(negative, -rest).otherwise(rest)
        return F.when(ok & (minute <= 59) & (second < 60), total * F.expr("INTERVAL '0.000001' SECOND"))

    return Fields.of(x, compile_format(fmt or loc.time_format, loc), build)


def _offset(text: Column) -> Column:
    """Minutes of an offset such as Z, 04, -0330 or +04:30."""
    digits = F.rpad(F.regexp_replace(text, "[^0-9]", ""), 4, "0")
    size = F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")
    return F.when(text == "Z", 0).when(text.startswith("-"), -size).otherwise(size)


def _instant(utc: Column) -> Column:
    """A local timestamp taken as UTC, whatever the session's zone."""
    return F.concat(utc.cast("string"), F.lit("Z")).try_cast("timestamp")


def parse_datetime(x: Column, fmt: str | None, loc: Locale) -> Column:
    """Instants. A local time that occurs twice is the first one, one that the clocks skip is null."""
    if fmt == "%s":
        seconds = F.when(x.rlike(r"^\s*-?\d+(\.\d*)?\s*$"), F.trim(x).try_cast("decimal(20,6)"))
        return F.timestamp_micros((seconds * 1_000_000).cast("long"))
    at_utc = loc.tz in ("UTC", "Etc/UTC", "GMT")

    def build(f: Fields) -> Column:
        hour, ok = f.hour()
        minute, second = f.first(f.number("minute")), f.seconds()
        micros = (hour.cast("long") * 3600 + minute * 60) * 1_000_000 + (second.cast("decimal(9,6)") * 1_000_000).cast("long")
        local = _date(f).cast("timestamp_ntz") + micros * F.expr("INTERVAL '0.000001' SECOND")
        return F.when(ok & (minute <= 59) & (second < 61), let(local, lambda t: placed(f, t)))

    def placed(f: Fields, local: Column) -> Column:
        offset, zone = f.text("offset"), f.text("zone")
        if zone is None and at_utc:
            there = _instant(local)
        else:
            tz = F.lit(loc.tz) if zone is None else F.coalesce(zone, F.lit(loc.tz))
            as_utc = F.convert_timezone(tz, F.lit("UTC"), local)
            there = F.when(F.convert_timezone(F.lit("UTC"), tz, as_utc) == local, _instant(as_utc))
        if offset is None:
            return there
        moved = _instant(local - F.coalesce(_offset(offset), F.lit(0)) * F.expr("INTERVAL '1' MINUTE"))
        return F.when(offset.isNotNull(), moved).otherwise(there)

    out = Fields.of(x, compile_iso8601() if fmt is None else compile_format(fmt, loc), build)
    if fmt is None and at_utc:  # the canonical spelling needs no pattern
        marks = _at(x, 5, "-") & _at(x, 8, "-") & _at(x, 11, "T") & _at(x, 14, ":") & _at(x, 17, ":") & _at(x, 20, "Z")
        out = F.coalesce(F.when((F.length(x) == 20) & marks, x.try_cast("timestamp")), out)
    return out
