"""Seeded random tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rectio.plans.spec import Collector, as_col_spec

KINDS = ["character", "double", "integer", "factor", "date", "datetime", "time", "logical"]
# Words that names are made of.
ADJECTIVES = "amber brisk calm dusty eager faint gentle hollow icy jolly keen lively mellow noble odd plain quiet rapid sturdy tidy".split()
ANIMALS = "badger crane dingo egret ferret gecko heron ibex jackal koala lemur marmot newt otter puffin quail raven stoat toad wombat".split()
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _pick(values: Sequence, seed: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.rand(seed) * len(values)) + 1).cast("int"))


def gen_character(seed: int = 1, min: int = 5, max: int = 25, values: str = _LETTERS) -> Column:
    """Lengths and characters are uniform."""
    size = (F.floor(F.rand(seed) * (max - min + 1)) + min).cast("int")
    if values == _LETTERS:
        return F.substring(F.randstr(max, seed + 1), F.lit(1), size)
    base = F.xxhash64(F.rand(seed + 1))
    char = lambda i: F.substring(F.lit(values), (F.pmod(F.xxhash64(base, i), F.lit(len(values))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), char), "")


def gen_double(seed: int = 1, f=None) -> Column:
    return f(seed) if f else F.randn(seed)


gen_number = gen_double


def gen_integer(seed: int = 1, min: int = 1, max: int = 2**31 - 1, prob: Sequence[float] | None = None) -> Column:
    if prob is None:
        return (F.floor(F.rand(seed) * (max - min + 1)) + min).cast("int")
    bounds, at = np.cumsum(np.asarray(prob) / np.sum(prob)).tolist(), F.rand(seed)
    return F.least(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= at)) + min, F.lit(max))


def gen_factor(seed: int = 1, levels: Sequence[str] | None = None, num_levels: int | None = None) -> Column:
    if levels is None:
        rng = np.random.default_rng(seed)
        count = num_levels or int(rng.integers(1, 26))
        levels = [f"{a}_{b}" for a, b in zip(rng.choice(ADJECTIVES, count), rng.choice(ANIMALS, count))]
    return _pick(list(dict.fromkeys(levels)), seed)


def gen_date(seed: int = 1, min: str = "2001-01-01", max: str = "2021-01-01") -> Column:
    days = F.datediff(F.lit(max), F.lit(min))
    return F.date_add(F.lit(min).cast("date"), F.floor(F.rand(seed) * days).cast("int"))


def gen_datetime(seed: int = 1, min: str = "2001-01-01T00:00:00Z", max: str = "2021-01-01T00:00:00Z") -> Column:
    low, high = F.unix_micros(F.lit(min).cast("timestamp")), F.unix_micros(F.lit(max).cast("timestamp"))
    return F.timestamp_micros((low + F.floor(F.rand(seed) * (high - low) / 1_000_000) * 1_000_000).cast("long"))


def gen_time(seed: int = 1, min: int = 0, max: int = 24, fractional: bool = False) -> Column:
    seconds = F.rand(seed) * (max - min) * 3600 + min * 3600
    return (F.floor((seconds if fractional else F.floor(seconds)) * 1_000_000)).cast("long") * F.expr("INTERVAL '0.000001' SECOND")


def gen_logical(seed: int = 1) -> Column:
    return F.rand(seed) < 0.5


def gen_name(n: int, seed: int = 1) -> list[str]:
    rng = np.random.default_rng(seed)
    return [f"{a}_{b}" for a, b in zip(rng.choice(ADJECTIVES, n), rng.choice(ANIMALS, n))]


_MAKERS = {
    "character": gen_character, "double": gen_double, "number": gen_number, "integer": gen_integer, "factor": gen_factor, "date": gen_date,
    "datetime": gen_datetime, "time": gen_time, "logical": gen_logical, "big_integer": lambda seed: gen_integer(seed).cast("bigint"),
}


def gen_tbl(spark: SparkSession, rows: int, cols: int | None = None, col_types=None, missing: float = 0.0, seed: int = 1) -> DataFrame:
    """A table of random columns; types that are to be guessed are drawn, and so are the cells that miss."""
    spec = as_col_spec(col_types)
    known = list(spec.cols.items())
    count = cols if cols is not None else len(known)
    rng = np.random.default_rng(seed)
    out = []
    for k in range(count):
        name, c = known[k] if k < len(known) else (k, Collector("guess"))
        kind = KINDS[int(rng.integers(len(KINDS)))] if c.kind == "guess" else c.kind
        if kind == "skip":
            continue
        x = _MAKERS[kind](seed * 1000 + 7 * k) if c.levels is None else gen_factor(seed * 1000 + 7 * k, c.levels)
        x = F.when(F.rand(seed * 1000 + 7 * k + 3) >= missing, x) if missing > 0 else x
        out.append(x.alias(name if isinstance(name, str) else f"X{k + 1}"))
    return spark.range(rows).select(*out)
