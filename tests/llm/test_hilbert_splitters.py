import random

from pyspark.sql import functions as F

from rectio.llm import hilbert


def test_text_bounds_are_taken_from_all_distinct_values(spark):
    rng = random.Random(2)
    values = sorted({f"{rng.choice('aàz日😀')}{rng.randint(0, 99999):x}" for _ in range(9000)}, key=lambda t: t.encode())
    assert len(values) > 8000
    rows = spark.createDataFrame([(v,) for v in [*values, *values[:2000], None]], "lang string").repartition(7)
    for bits in (2, 4):
        parts = 1 << bits
        assert hilbert.splitters(rows, "lang", bits) == [values[k * len(values) // parts] for k in range(1, parts)]
        sizes = rows.where("lang is not null").distinct().groupBy(hilbert.quantised(F.col("lang"), hilbert.splitters(rows, "lang", bits))).count().collect()
        assert len(sizes) == parts and max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 1
    two = spark.createDataFrame([("b",), ("a",), ("b",)], "lang string")
    assert hilbert.splitters(two, "lang", 4) == ["a", "b"]
    assert hilbert.splitters(rows.limit(0), "lang", 4) == []
