"""Column specifications: one collector per column, a default, and a delimiter."""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class Collector:
    kind: str
    format: str | None = None
    levels: tuple | None = None
    ordered: bool = False
    include_na: bool = False


def col_logical() -> Collector:
    return Collector("logical")


def col_integer() -> Collector:
    return Collector("integer")


def col_big_integer() -> Collector:
    return Collector("big_integer")


def col_double() -> Collector:
    return Collector("double")


def col_character() -> Collector:
    return Collector("character")


def col_skip() -> Collector:
    return Collector("skip")


def col_number() -> Collector:
    return Collector("number")


def col_guess() -> Collector:
    return Collector("guess")


def col_factor(levels: Sequence[str | None] | None = None, ordered: bool = False, include_na: bool = False) -> Collector:
    return Collector("factor", None, None if levels is None else tuple(levels), ordered, include_na)


def col_datetime(format: str | None = None) -> Collector:
    return Collector("datetime", format)


def col_date(format: str | None = None) -> Collector:
    return Collector("date", format)


def col_time(format: str | None = None) -> Collector:
    return Collector("time", format)


# Letters and names of the types.
_NAMES = {
    "l": "logical", "i": "integer", "I": "big_integer", "d": "double", "n": "number", "c": "character", "f": "factor",
    "D": "date", "T": "datetime", "t": "time", "_": "skip", "-": "skip", "?": "guess", "NA": "guess", "NULL": "skip",
    "logical": "logical", "integer": "integer", "big_integer": "big_integer", "double": "double", "numeric": "double",
    "number": "number", "character": "character", "factor": "factor", "date": "date", "Date": "date",
    "datetime": "datetime", "POSIXct": "datetime", "time": "time", "skip": "skip",
}
LETTERS = {"logical": "l", "integer": "i", "big_integer": "I", "double": "d", "number": "n", "character": "c", "factor": "f", "date": "D", "datetime": "T", "time": "t", "skip": "_", "guess": "?"}


def as_collector(x: str | Collector | None) -> Collector:
    if x is None:
        return col_skip()
    if isinstance(x, Collector):
        return x
    if x not in _NAMES:
        raise ValueError(f"unknown column type specification: {x}")
    return Collector(_NAMES[x])


@dataclass(frozen=True)
class ColSpec:
    """``cols`` has names for a named specification, and numbers from 0 for one by place."""

    cols: dict = field(default_factory=dict)
    default: Collector = Collector("guess")
    delim: str | None = None

    def __str__(self) -> str:
        parts = [f"  {k} = col_{c.kind}({f'format={c.format!r}' if c.format else ''})" for k, c in self.cols.items()]
        default = [] if self.default.kind == "guess" else [f"  .default = col_{self.default.kind}()"]
        delim = [f"  .delim = {self.delim!r}"] if self.delim else []
        return "cols(\n" + ",\n".join(default + parts + delim) + "\n)"

    def summary(self) -> dict[str, list[str]]:
        """Column names by type."""
        out: dict[str, list[str]] = {}
        for name, c in self.cols.items():
            if c.kind != "skip":
                out.setdefault(c.kind, []).append(str(name))
        return out


def cols(_default: str | Collector = "?", _delim: str | None = None, **named: str | Collector | None) -> ColSpec:
    return ColSpec({k: as_collector(v) for k, v in named.items()}, as_collector(_default), _delim)


def cols_only(_delim: str | None = None, **named: str | Collector | None) -> ColSpec:
    """Columns that are not named are skipped."""
    return ColSpec({k: as_collector(v) for k, v in named.items()}, col_skip(), _delim)


def as_col_spec(x) -> ColSpec:
    """From nothing, a compact string such as ``"dc_"``, a list, a mapping, or a specification."""
    if x is None:
        return ColSpec()
    if isinstance(x, ColSpec):
        return x
    if isinstance(x, str):
        return ColSpec({k: as_collector(c) for k, c in enumerate(x)})
    if isinstance(x, dict):
        named = dict(x)
        default = as_collector(named.pop(".default", "?"))
        return ColSpec({k: as_collector(v) for k, v in named.items()}, default, named.pop(".delim", None))
    return ColSpec({k: as_collector(c) for k, c in enumerate(x)})


def cols_condense(spec: ColSpec) -> ColSpec:
    """The most frequent collector becomes the default."""
    if not spec.cols:
        return spec
    most = Counter(spec.cols.values()).most_common(1)[0][0]
    return replace(spec, cols={k: c for k, c in spec.cols.items() if c != most}, default=most)


class MismatchedColumnName(UserWarning):
    """The specification names columns that the input does not have."""


def make_names(names: Sequence[str] | None, n: int) -> list[str]:
    """The first n names, padded with X and the place."""
    names = list(names or [])[:n]
    return names + [f"X{k + 1}" for k in range(len(names), n)]


def repair_names(names: Sequence[str], how: str | Callable = "unique") -> list[str]:
    """Empty names and repeated ones get their place after three dots, unless ``how`` says otherwise."""
    names = ["" if x is None else x for x in names]
    if callable(how):
        return list(how(names))
    if how == "minimal":
        return names
    if how == "check_unique":
        if len(set(names)) < len(names) or "" in names:
            raise ValueError("names must be unique and not empty")
        return names
    if how.removesuffix("_quiet") not in ("unique", "universal"):
        raise ValueError(f"unknown name repair: {how}")
    base = [re.sub(r"(\.\.\.\d*)+$", "", x) if re.search(r"\.\.\.\d+$", x) else x for x in names]
    if how.startswith("universal"):
        base = [re.sub(r"\W", ".", x) for x in base]
        base = [f"...{x}" if re.match(r"^(\d|_)", x) else x for x in base]
    seen = Counter(base)
    return [f"{x}...{k + 1}" if seen[x] > 1 or x == "" else x for k, x in enumerate(base)]


def standardise(spec: ColSpec, names: list[str]) -> list[Collector]:
    """One collector per column of the input, in its order."""
    by_place = all(isinstance(k, int) for k in spec.cols)
    if by_place:
        own = [spec.cols[k] for k in sorted(spec.cols)][: len(names)]
        return own + [spec.default] * (len(names) - len(own))
    unknown = [k for k in spec.cols if k not in names]
    if unknown:
        warnings.warn(f"columns not found: {', '.join(map(str, unknown))}", MismatchedColumnName, stacklevel=3)
    return [spec.cols.get(n, spec.default) for n in names]


def to_struct(names: list[str], collectors: list[Collector]) -> T.StructType:
    from rectio.functions.parsers import SPARK_TYPES

    return T._parse_datatype_string(", ".join(f"`{n}` {SPARK_TYPES[c.kind if c.kind != 'guess' else 'character']}" for n, c in zip(names, collectors) if c.kind != "skip"))
