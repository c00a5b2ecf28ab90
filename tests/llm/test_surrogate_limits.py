import string
import time

import pytest
from pyspark.sql import functions as F

from rectio.llm import pii


def replaced(spark, texts, **kwargs):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace_pii(df, "k", **kwargs).orderBy("doc_id").collect()]


def test_addresses_and_number_tables_of_any_length(spark):
    address = "a@" + "b." * 30_000 + "com"
    table = " ".join(str(1000 + k % 9000) for k in range(6_000))
    years = "2024 " * 3_000
    short = " ".join("7" for _ in range(50_000))
    new = replaced(spark, [f"to {address} now", table, years, short, "a@b..com, c.d@e.org."])
    assert new[0] != f"to {address} now" and len(new[0]) == len(address) + 7 and new[0].endswith(".com now")
    assert len(new[1]) == len(table) and new[2].replace(" ", "").isdigit() and new[3][:-40] == short[:-40]
    assert new[4].startswith("a@b..com, ") and new[4].endswith(".org.") and "c.d@e" not in new[4]


def test_long_secrets_take_linear_time(spark):
    secret = "aB3é" * 50_000
    replaced(spark, ["token=warm-up1"])
    began = time.time()
    [new] = replaced(spark, [f"token={secret}"])
    alone = time.time() - began
    assert len(new) == len(secret) + 6 and new.startswith("token=") and sum(a != b for a, b in zip(new[6:], secret)) > 150_000
    assert alone < 20  # entities, the check of collisions and the text: three surrogates with their jobs
    began = time.time()
    drawn = pii.surrogate(F.col("text"), F.lit("secret"), F.lit(0), "k")
    spark.createDataFrame([(secret,)], "text string").select(F.length(drawn)).collect()
    assert time.time() - began < 4


def test_marks_and_other_scripts(spark):
    new = replaced(spark, ["password=**** x", "pwd: 密码密码很长", "token = ひらがなabc", "password=****"])
    assert new[0] == "password=**** x" and new[3] == "password=****"
    assert len(new[1]) == 11 and "密码" not in new[1] and all(0x4E00 <= ord(c) <= 0x9FFF for c in new[1][5:])
    assert len(new[2]) == 15 and "ひらがな" not in new[2]


@pytest.mark.parametrize("few", [0, 500, 5000])
def test_a_full_format_trades_places(spark, monkeypatch, few):
    monkeypatch.setattr(pii, "FEW", few)
    monkeypatch.setattr(pii, "MAX_ATTEMPTS", 2)
    names = [a + b for a in string.ascii_uppercase for b in string.ascii_lowercase]
    texts = [f"Mr. {n} came, {'John' if k % 2 else 'Xaver'} {n} and Mr. {n} went" for k, n in enumerate(names)] + ["plain", None, ""]
    new = replaced(spark, texts)
    words = [t.split() for t in new[: len(names)]]
    last = [w[1] for w in words]
    assert len(set(last)) == len(names) and all(a != b for a, b in zip(last, names))
    assert all(len(n) == 2 and n[0].isupper() and n[1].islower() for n in last)
    assert all(w[1] == w[4] == w[7] if "Xaver" not in t else True for w, t in zip(words, texts))
    assert all(w[3] in pii.GIVEN["m", "latin"] and w[3] != "John" for w, t in zip(words, texts) if t and "John" in t)
    assert new[-3:] == ["plain", None, ""]


def test_swapped_rows_are_distinct_and_never_alike(spark):
    rows = [("secret", f"{a}{b}--", 12, True) for a in "01" for b in "0123456789"] + [("secret", "x--", 12, True), ("secret", "y--", 1, False), ("secret", "----", 12, True)]
    rows += [("card", "4799134681044206", 12, True), ("card", "5105105105105100", 12, True)]
    got = {r.canon: r.fixed for r in pii._swapped(spark.createDataFrame(rows, "kind string, canon string, attempt int, left boolean")).collect()}
    assert len(got) == len(rows) and got["y--"] is None and got["x--"] == "y--" and got["----"] == "----"
    twenty = {k: v for k, v in got.items() if len(k) == 4 and k != "----"}
    assert set(twenty) == set(twenty.values()) and all(k != v for k, v in twenty.items())


def test_surrogates_beside_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "mail a@b.org", "x", 7, "y", "z")], "doc_id long, text string, found string, n long, tried string, joined string")
    out = pii.replace_pii(df, "k", count_col="n")
    row = out.first()
    assert out.columns == ["doc_id", "text", "found", "tried", "joined", "n"]
    assert (row.found, row.tried, row.joined, row.n) == ("x", "y", "z", 1) and row.text.endswith(".org") and row.text != "mail a@b.org"
