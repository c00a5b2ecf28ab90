import random

import pytest
from pyspark.sql import functions as F

import rectio as rx
from rectio.functions import tokens as tk
from rectio.sources import delimited

DIALECTS = [tk.Dialect(), tk.Dialect(delim="||", skip_empty_rows=False), tk.Dialect(comment="#"), tk.Dialect(escape_double=False, escape_backslash=True)]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("512", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("d", DIALECTS)
def test_records_of_splits_are_those_of_whole_texts(spark, tmp_path, small_splits, d):
    rng = random.Random(5)
    alphabet = ["a", "b", " ", d.delim, d.delim, '"', '"', "\n", "\n", "\\" if d.escape_backslash else "é", "#"]
    paths = {}
    for k in range(6):
        text = "".join(rng.choice(alphabet) for _ in range(3000)) + "z\n"
        (tmp_path / f"{k}.csv").write_text(text)
        paths[f"file://{tmp_path}/{k}.csv"] = str(k)
    (tmp_path / "6.csv").write_text('"one' + "\n" * 2000 + '",2\n\n' + '3,"4\n5"\n')
    paths[f"file://{tmp_path}/6.csv"] = "6"
    whole = spark.read.text(list(paths), wholetext=True).select(F.regexp_replace("value", "\n$", "").alias("value"), F.regexp_extract(F.input_file_name(), r"(\d)\.csv", 1).alias("path"))
    want = {}
    for r in whole.select("path", tk.records(F.col("value"), d).alias("found")).collect():
        want[r.path] = [x for x in r.found if not (d.skip_empty_rows or d.comment) or x.strip(" \t\r\0")]
    for header in (False, True):
        rows = delimited.placed(delimited._joined(spark, paths, d, 0, header, None))
        got = {}
        for r in rows.orderBy("path", "block", "at").collect():
            got.setdefault(r.path, []).append(r.value.removesuffix("\\"))
        assert got == {p: [x.removesuffix("\\") for x in v[header:]] for p, v in want.items() if v[header:]}


def test_quoted_line_feeds_over_many_splits(spark, tmp_path, small_splits):
    lines = {k: "\n".join(f'line {j} of "{k}"' for j in range(k % 40)) for k in range(80)}
    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    (tmp_path / "x.csv").write_text('"k\nk",text\n' + "".join(f"{k},{quoted(t)}\n" for k, t in lines.items()))
    frame = rx.read_delim(spark, str(tmp_path / "x.csv"), delim=",", col_types="ic")
    assert frame.df.columns == ["k\nk", "text"]
    assert frame._texts.select("block").distinct().count() > 20
    assert {r[0]: r[1] for r in frame.df.collect()} == {k: t or None for k, t in lines.items()}
    picked = frame.rows([80, 42, 7]).orderBy("row").collect()
    assert [r[1] for r in picked] == [79, 41, 6]
    assert frame.problems().count() == 0
