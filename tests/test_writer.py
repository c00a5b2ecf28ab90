import gzip
import io

import pytest

import rectio as rx


def test_specials_and_quotes(spark):
    df = spark.createDataFrame([(1.0, 'a"b', None, True), (1e15, "x\ty", float("nan"), False), (0.00123, "NA", float("-inf"), None)], "a double, b string, c double, d boolean")
    assert rx.format_delim(df) == 'a\tb\tc\td\n1\t"a""b"\tNA\tTRUE\n1e15\t"x\ty"\tNA\tFALSE\n0.00123\tNA\t-Inf\tNA\n'


@pytest.mark.parametrize(
    "value, text",
    {1e13: "10000000000000", 1e14: "100000000000000", 1e15: "1e15", 1e16: "1e16", 1.2e-7: "1.2e-7", 123456.789: "123456.789", -0.5: "-0.5", 0.0: "0", 0.001: "0.001", 1e-4: "1e-4", 12345678.25: "12345678.25", 1e7: "10000000"}.items(),
)
def test_doubles(spark, value, text):
    assert rx.format_delim(spark.createDataFrame([(value,)], "x double"), col_names=False) == text + "\n"


def test_escapes(spark):
    df = spark.createDataFrame([("a",), ('"',), (",",), ("x\ny",)], "t string")
    show = lambda **o: rx.format_delim(df, **o)
    assert show() == 't\na\n""""\n,\n"x\ny"\n'
    assert show(escape="backslash") == 't\na\n"\\""\n,\n"x\ny"\n'
    assert show(escape="none") == 't\na\n"""\n,\n"x\ny"\n'
    assert show(quote="none") == 't\na\n""\n,\nx\ny\n'
    assert show(quote="all", delim=",") == '"t"\n"a"\n""""\n","\n"x\ny"\n'


def test_files_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "a int, b string")
    path = str(tmp_path / "x.tsv.gz")
    rx.write_delim(df, path, bom=True)
    rx.write_delim(df, path, append=True)
    rx.write_delim(df.limit(0), path, append=True)
    assert gzip.open(path).read() == b"\xef\xbb\xbf" + "a\tb\n1\té\n1\té\n".encode()
    out = io.BytesIO()
    rx.write_delim(df, out, ",", eol="\r\n", bom=True)
    assert out.getvalue() == "a,b\r\n1,é\r\n".encode()
    rx.write_delim(df.select(), str(tmp_path / "none"))
    assert (tmp_path / "none").read_bytes() == b""
    rx.write_delim(df.limit(0), str(tmp_path / "head"))
    assert (tmp_path / "head").read_text() == "a\tb\n"
    rx.write_lines(df.select("b"), str(tmp_path / "lines"))
    assert (tmp_path / "lines").read_text() == "é\n"


def test_types(spark):
    df = spark.sql("SELECT DATE '2020-01-02' d, TIMESTAMP '2020-01-02 03:04:05Z' t, TIMESTAMP_NTZ '2020-01-02 03:04:05.25' n, INTERVAL '30:01:02' HOUR TO SECOND h, INTERVAL '-00:01:02' HOUR TO SECOND m")
    assert rx.format_delim(df, ",", col_names=False) == "2020-01-02,2020-01-02T03:04:05Z,2020-01-02T03:04:05.25Z,30:01:02,-00:01:02\n"


def test_folder_round_trip(spark, tmp_path):
    rows = [(k, f'x"{k}\n,', k / 7) for k in range(50)]
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(3)
    rx.write_delim_dir(df, str(tmp_path / "out"), ",")
    back = rx.read_delim(spark, str(tmp_path / "out"), delim=",", col_types="icd").df
    assert sorted(map(tuple, back.collect())) == rows
    files = [p.read_text() for p in (tmp_path / "out").glob("part-*")]
    assert len(files) == 3 and all(text.startswith("a,b,c\n") and "\x00" not in text for text in files)
    rx.write_delim_dir(df.limit(0), str(tmp_path / "none"), ",", eol="\r\n")
    assert "".join(p.read_bytes().decode() for p in (tmp_path / "none").glob("part-*")) == "a,b,c\r\n"


def test_generated_tables(spark):
    df = rx.gen_tbl(spark, 400, col_types="difcDtTln", missing=0.25, seed=3)
    rows = df.collect()
    assert len(rows) == 400 and len(df.columns) == 9
    share = sum(v is None for r in rows for v in r) / (400 * 9)
    assert 0.2 < share < 0.3
    assert rows == rx.gen_tbl(spark, 400, col_types="difcDtTln", missing=0.25, seed=3).collect()
