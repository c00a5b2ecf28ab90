"""Regional settings: marks, time zone, encoding and the names of months and days."""

from __future__ import annotations

import codecs
import warnings
from dataclasses import dataclass, field


@dataclass(frozen=True)
class DateNames:
    """Twelve months, seven days from Sunday on, and the two halves of a day."""

    mon: tuple[str, ...]
    mon_ab: tuple[str, ...]
    day: tuple[str, ...]
    day_ab: tuple[str, ...]
    am_pm: tuple[str, str] = ("AM", "PM")

    def __post_init__(self):
        for names, n in ((self.mon, 12), (self.mon_ab, 12), (self.day, 7), (self.day_ab, 7), (self.am_pm, 2)):
            if len(names) != n:
                raise ValueError(f"{n} names are needed, not {len(names)}")


_EN = DateNames(
    tuple("January February March April May June July August September October November December".split()),
    tuple("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()),
    tuple("Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()),
    tuple("Sun Mon Tue Wed Thu Fri Sat".split()),
)


def date_names_lang(language: str, spark=None) -> DateNames:
    """Names of a language, from the Java runtime's own tables."""
    if language == "en":
        return _EN
    from pyspark.sql import SparkSession

    jvm = (spark or SparkSession.getActiveSession())._jvm
    symbols = jvm.java.text.DateFormatSymbols.getInstance(jvm.java.util.Locale.forLanguageTag(language))
    take = lambda names, first, n: tuple(list(names)[first : first + n])
    return DateNames(
        take(symbols.getMonths(), 0, 12), take(symbols.getShortMonths(), 0, 12),
        take(symbols.getWeekdays(), 1, 7), take(symbols.getShortWeekdays(), 1, 7), take(symbols.getAmPmStrings(), 0, 2),
    )


def date_names_langs(spark=None) -> list[str]:
    """Languages that :func:`date_names_lang` knows."""
    from pyspark.sql import SparkSession

    jvm = (spark or SparkSession.getActiveSession())._jvm
    return sorted({x.getLanguage() for x in jvm.java.text.DateFormatSymbols.getAvailableLocales()} - {""})


@dataclass(frozen=True)
class Locale:
    """``locale()`` builds one with checks; marks must differ."""

    date_names: DateNames = field(default=_EN)
    date_format: str = "%AD"
    time_format: str = "%AT"
    decimal_mark: str = "."
    grouping_mark: str = ","
    tz: str = "UTC"
    encoding: str = "UTF-8"


def locale(
    date_names: str | DateNames = "en", date_format: str = "%AD", time_format: str = "%AT", decimal_mark: str | None = None,
    grouping_mark: str | None = None, tz: str = "UTC", encoding: str = "UTF-8",
) -> Locale:
    """A locale; one mark alone implies the other, and an empty zone is the system's."""
    if decimal_mark is None and grouping_mark is None:
        decimal_mark, grouping_mark = ".", ","
    elif decimal_mark is None:
        decimal_mark = "," if grouping_mark == "." else "."
    elif grouping_mark is None:
        grouping_mark = "." if decimal_mark == "," else ","
    if decimal_mark == grouping_mark:
        raise ValueError("decimal_mark and grouping_mark must be different")
    if not tz:
        import time

        tz = time.tzname[0] if time.tzname[0] else "UTC"
    try:
        codecs.lookup(encoding)
    except LookupError:
        warnings.warn(f"unknown encoding {encoding}", stacklevel=2)
    names = date_names if isinstance(date_names, DateNames) else date_names_lang(date_names)
    return Locale(names, date_format, time_format, decimal_mark, grouping_mark, tz, encoding)


def default_locale() -> Locale:
    return Locale()
