"""Column selection with renaming, ranges, negation and name helpers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Selection:
    """Names an ordered choice; ``~`` leaves the chosen out."""

    pick: Callable[[list[str]], list[tuple[str, str]]]
    negative: bool = False

    def __invert__(self) -> Selection:
        return Selection(self.pick, not self.negative)


def _named(test: Callable[[str], bool]) -> Selection:
    return Selection(lambda names: [(n, n) for n in names if test(n)])


def starts_with(*prefixes: str) -> Selection:
    return _named(lambda n: n.lower().startswith(tuple(p.lower() for p in prefixes)))


def ends_with(*suffixes: str) -> Selection:
    return _named(lambda n: n.lower().endswith(tuple(s.lower() for s in suffixes)))


def contains(*parts: str) -> Selection:
    return _named(lambda n: any(p.lower() in n.lower() for p in parts))


def matches(pattern: str) -> Selection:
    return _named(lambda n: re.search(pattern, n, re.I) is not None)


def everything() -> Selection:
    return _named(lambda n: True)


def last_col(offset: int = 0) -> Selection:
    return Selection(lambda names: [(names[-1 - offset],) * 2])


def num_range(prefix: str, numbers: Sequence[int], width: int = 0) -> Selection:
    wanted = [f"{prefix}{k:0{width}d}" if width else f"{prefix}{k}" for k in numbers]
    return Selection(lambda names: [(n, n) for n in wanted if n in names])


def one_of(*names: str) -> Selection:
    return Selection(lambda known: [(n, n) for n in names if n in known])


def span(first: str, last: str) -> Selection:
    """Columns from one to another."""

    def pick(names: list[str]) -> list[tuple[str, str]]:
        a, b = names.index(first), names.index(last)
        own = names[a : b + 1] if a <= b else names[b : a + 1][::-1]
        return [(n, n) for n in own]

    return Selection(pick)


def resolve(select, names: list[str]) -> list[tuple[str, str]]:
    """(column, new name) pairs. ``select`` is a name, place, helper, mapping of new to old, or list of them."""
    if select is None:
        return [(n, n) for n in names]
    items = select if isinstance(select, (list, tuple)) else [select]
    out: list[tuple[str, str]] = []
    for k, item in enumerate(items):
        negative = False
        if isinstance(item, Selection):
            found, negative = item.pick(names), item.negative
        elif isinstance(item, dict):
            found = [(names[old] if isinstance(old, int) else old, new) for new, old in item.items()]
        elif isinstance(item, int):
            found, negative = [(names[abs(item) - 1],) * 2], item < 0
        else:
            text = str(item)
            negative = text.startswith("-") and text not in names
            found = [(text[1:] if negative else text,) * 2]
        unknown = [old for old, _ in found if old not in names]
        if unknown:
            raise ValueError(f"columns not found: {', '.join(unknown)}")
        if negative:
            if k == 0:
                out = [(n, n) for n in names]
            gone = {old for old, _ in found}
            out = [x for x in out if x[0] not in gone]
        else:
            out += [x for x in found if x[0] not in {old for old, _ in out}]
    return out
