import random

import pytest
from pyspark.sql import functions as F

from rectio.functions import tokens as tk

DIALECTS = [tk.Dialect(","), tk.Dialect("||"), tk.Dialect(",", comment="#"), tk.Dialect(",", ""), tk.Dialect(",", escape_backslash=True, escape_double=False)]


def open_quote(record, d):
    """Whether an automaton over the record ends inside quotes."""
    i, state = 0, "start"
    while i < len(record):
        if d.escape_backslash and record[i] == "\\":
            i, state = i + 2, "plain" if state == "start" else state
            continue
        if state != "quoted" and record.startswith(d.delim, i):
            i, state = i + len(d.delim), "start"
            continue
        if d.quote and record[i] == d.quote and state != "plain":
            state = "ended" if state == "quoted" else "quoted"
        elif state == "start":
            state = "plain"
        i += 1
    return state == "quoted"


@pytest.mark.parametrize("d", DIALECTS)
def test_pattern_agrees_with_an_automaton(spark, d):
    rng = random.Random(7)
    alphabet = ["a", " ", d.delim, d.delim, '"', "\\" if d.escape_backslash else "b", "#"]
    records = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(3000)})
    records = [r for r in records if not (d.escape_backslash and (r.endswith("\\") or r.count("\\") % 2))]
    df = spark.createDataFrame([(r,) for r in records], "r string")
    value = tk.uncommented(F.col("r"), d)
    got = df.select("r", tk.tokens(value, d).alias("t"), tk.is_open(F.col("r"), d).alias("o")).collect()
    for row in got:
        if open_quote(row.r, d):
            assert d.comment or row.o
            continue
        assert not row.o or d.comment
        assert row.t == tk.split_py(row.r, d), row.r


def test_content(spark):
    d = tk.Dialect(",")
    cases = {' " a b " ': "a b", '"""fo""o"': '"fo"o', '"q"z': "qz", "x": "x", '""': "", "\tx\r": "x", '"b""""ar"': 'b""ar'}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r.t: r.v for r in df.select("t", tk.content(F.col("t"), d).alias("v")).collect()}
    assert got == cases and {c: tk.content_py(c, d) for c in cases} == cases


def test_records_of_whole_texts(spark):
    d = tk.Dialect(",", comment="#")
    cases = {
        'a,"x\ny",b\nc,d,e': ['a,"x\ny",b', "c,d,e"], "a#b\n#c\nd": ["a", "", "d"], 'a,"#"\nb': ['a,"#"', "b"],
        'a\nb,"c\nd,e': ["a", 'b,"c\nd,e'], "": [""],
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: r.v for r in df.select("t", tk.records(F.col("t"), d).alias("v")).collect()} == cases


def test_widened(spark):
    d = tk.Dialect(",")
    df = spark.createDataFrame([("1,2,3,4",), ("1",), ("1,2",)], "t string")
    got = [r.v for r in df.select(tk.widened(tk.tokens(F.col("t"), d), d, 2).alias("v")).collect()]
    assert got == [["1", "2,3,4"], ["1"], ["1", "2"]]
