import gzip
import lzma
import warnings
import zipfile

import pytest

import rectio as rx


def folder(tmp_path, files, name="in"):
    out = tmp_path / name
    out.mkdir()
    for k, data in files.items():
        (out / k).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(out)


def rows(frame):
    return sorted(map(tuple, frame.df.collect()), key=repr)


def test_control_characters_stay_in_their_values(spark, tmp_path):
    text = "a,b\n1,x\x01y\n2,\x01\n\x013,z\x01\x01\n"
    for names in (True, ["p", "q"]):
        frame = rx.read_delim(spark, rx.I(text), delim=",", col_types="cc", col_names=names)
        assert {("1", "x\x01y"), ("2", "\x01"), ("\x013", "z\x01\x01")} <= set(rows(frame))
    assert rows(rx.read_delim(spark, rx.I("a\x01b\n1\x012\n"), delim="\x01", col_types="ii")) == [(1, 2)]
    df = spark.createDataFrame([(1, "x\x01y"), (2, "u\x00v")], "a int, b string")
    rx.write_delim_dir(df.where("a = 1"), str(tmp_path / "out"), ",")
    assert rows(rx.read_delim(spark, str(tmp_path / "out"), delim=",", col_types="ic")) == [(1, "x\x01y")]


def test_prefixes_of_every_file_in_a_folder(spark, tmp_path):
    path = folder(tmp_path, {f"{k}.csv": f"junk {k}\n\n## note\na,b\n{k},x\n## note\n{k + 10},y ## tail\n" for k in range(5)})
    for source in (path, path + "/*.csv", [path]):
        frame = rx.read_delim(spark, source, delim=",", col_types="ic", skip=1, comment="##")
        assert rows(frame) == sorted([(k, "x") for k in range(5)] + [(k + 10, "y") for k in range(5)], key=repr)
    path = folder(tmp_path, {f"{k}.csv": "\n" * k + f"a,b\n{k},x\n" for k in range(3)}, "blank")
    assert rows(rx.read_delim(spark, path, delim=",", col_types="ic")) == [(0, "x"), (1, "x"), (2, "x")]
    assert rows(rx.read_delim(spark, path, delim=",", col_types="ic", id="path", col_select=["b", "a"]))[0][1:] == ("x", 0)
    with pytest.raises(FileNotFoundError):
        rx.read_delim(spark, path + "/*.tsv", delim=",")


def test_many_lines_before_the_first_record(spark, tmp_path):
    text = "\n" * 1500 + "# c\n" * 9000 + "a,b\n1,2\n"
    assert rows(rx.read_delim(spark, rx.I(text), delim=",", comment="#", col_types="ii")) == [(1, 2)]


def test_quoted_prefix_and_line_feeds_in_a_folder(spark, tmp_path):
    path = folder(tmp_path, {f"{k}.csv": f'"skipped\nrecord",{k}\na,b\n{k},"two\nlines"\n' for k in range(3)})
    frame = rx.read_delim(spark, path, delim=",", col_types="ic", skip=1)
    assert rows(frame) == [(k, "two\nlines") for k in range(3)]


@pytest.mark.parametrize("charset", ["latin-1", "cp1252", "shift_jis"])
def test_charsets_of_folders(spark, tmp_path, charset):
    word = {"latin-1": "é", "cp1252": "€é", "shift_jis": "表示"}[charset]
    path = folder(tmp_path, {f"{k}.csv": f"a,{word}\n{k},x{word}\n".encode(charset) for k in range(3)})
    for skip in (0, 1):
        frame = rx.read_delim(spark, path, delim=",", col_types="ic", locale=rx.locale(encoding=charset), skip=skip, col_names=not skip or ["a", word])
        assert frame.df.columns == ["a", word] and rows(frame) == [(k, f"x{word}") for k in range(3)]
    lines = rx.read_lines(spark, path, locale=rx.locale(encoding=charset)).where(f"V1 LIKE '%x{word}'")
    assert lines.count() == 3
    whole = folder(tmp_path, {"a.csv": f'a,b\n1,"{word}\n{word}"\n'.encode(charset)}, "whole")
    assert rows(rx.read_delim(spark, whole, delim=",", col_types="ic", locale=rx.locale(encoding=charset))) == [(1, f"{word}\n{word}")]


def test_compressed_files_in_a_folder(spark, tmp_path):
    text = "a,b\n{k},x\n"
    packed = tmp_path / "p.zip"
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("first.csv", text.format(k=4))
        z.writestr("second.csv", text.format(k=9))
    files = {"0.csv": text.format(k=0), "1.csv.gz": gzip.compress(text.format(k=1).encode()), "2.bin": gzip.compress(text.format(k=2).encode()),
             "3.csv.xz": lzma.compress(text.format(k=3).encode()), "4.zip": packed.read_bytes(), "_hidden": "q", ".also": "q"}
    with pytest.warns(UserWarning, match="several files"):
        frame = rx.read_delim(spark, folder(tmp_path, files), delim=",", col_types="ic", id="path")
    assert sorted((r.path.rsplit("/", 1)[-1], r.a) for r in frame.df.collect()) == [("0.csv", 0), ("1.csv.gz", 1), ("2.bin", 2), ("3.csv.xz", 3), ("4.zip", 4)]
    wide = {f"{k}.csv": text.format(k=k).encode("utf-16") for k in range(2)}
    with pytest.raises(ValueError, match="one by one"):
        rx.read_delim(spark, folder(tmp_path, wide, "wide"), delim=",")
    one = folder(tmp_path, {"0.csv": wide["0.csv"]}, "one")
    assert rows(rx.read_delim(spark, one, delim=",", col_types="ic")) == [(0, "x")]
    with pytest.raises(ValueError, match="one by one"):
        rx.read_delim(spark, [f"{one}/0.csv", f"{one}/0.csv"], delim=",", locale=rx.locale(encoding="utf-16"))


def test_headers_inside_a_folder(spark, tmp_path):
    with pytest.raises(ValueError, match="2 columns"):
        rx.read_delim(spark, folder(tmp_path, {"0.csv": "a,b\n1,2\n", "1.csv": "a,b,c\n1,2,3\n"}, "w"), delim=",")
    with pytest.raises(ValueError, match="names"):
        rx.read_delim(spark, folder(tmp_path, {"0.csv.gz": gzip.compress(b"a,b\n1,2\n"), "1.csv.gz": gzip.compress(b"a,x\n1,2\n")}, "n"), delim=",")
    path = folder(tmp_path, {"0.csv": "a,b\n", "1.csv": "", "2.csv": "a,b\n1,2\n"}, "e")
    assert rows(rx.read_delim(spark, path, delim=",", col_types="ii")) == [(1, 2)]


def test_factor_levels(spark, tmp_path):
    text = "f\nplum\nNA\nfig\nplum\nkiwi\n"
    read = lambda c, **o: rx.read_delim(spark, rx.I(text), delim=",", col_types={"f": c}, **o)
    levels = lambda frame: [tuple(r) for r in frame.levels("f").orderBy("code").collect()]
    assert levels(read(rx.col_factor())) == [("plum", 1), ("fig", 2), ("kiwi", 3)]
    assert levels(read(rx.col_factor(include_na=True))) == [("plum", 1), (None, 2), ("fig", 3), ("kiwi", 4)]
    known = read(rx.col_factor(["fig", "plum", "kiwi", None]))
    assert levels(known) == [("fig", 1), ("plum", 2), ("kiwi", 3), (None, 4)]
    assert [r.f for r in known.df.collect()].count(None) == 1 and known.problems().count() == 0
    assert known.df.schema["f"].metadata["na_level"] is True
    path = folder(tmp_path, {"1.csv": "f\nb\nc\n", "0.csv": "f\nc\na\n"})
    assert levels(rx.read_delim(spark, path, delim=",", col_types="f")) == [("c", 1), ("a", 2), ("b", 3)]


def test_rows_by_number_and_guesses_over_files(spark, tmp_path):
    path = folder(tmp_path, {f"{k}.csv": "a,b\n" + "".join(f"{10 * k + j},{'x' if k == 2 and j == 9 else j}\n" for j in range(10)) for k in range(3)})
    frame = rx.read_delim(spark, path, delim=",")
    assert [c.kind for c in frame.spec.cols.values()] == ["double", "character"]  # the last row tells
    assert [c.kind for c in rx.read_delim(spark, path, delim=",", guess_max=20_000).spec.cols.values()] == ["double", "character"]
    got = frame.rows([1, 30, None, 11, 11, 99]).orderBy("row").collect()
    assert [(r.row, r.a, r.b) for r in got] == [(1, 0.0, "0"), (2, 29.0, "x"), (3, None, None), (4, 10.0, "0"), (5, 10.0, "0"), (6, None, None)]
    first = rx.read_delim(spark, path, delim=",", n_max=2, col_types="ic").df
    assert sorted(r.a for r in first.collect()) == [0, 1, 10, 11, 20, 21]


def test_warnings_and_summaries(spark, capsys):
    bad = rx.read_delim(spark, rx.I("a,b\n1,x\nz,y\n"), delim=",", col_types="ic")
    with pytest.warns(rx.ParseIssue):
        assert bad.warn()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert not rx.read_delim(spark, rx.I("a\n1\n"), delim=",", col_types="i").warn()
    assert "integer (1): a" in bad.show_col_types() and "','" in capsys.readouterr().out


def test_zip_and_fractions_of_times(spark, tmp_path):
    df = spark.sql("SELECT INTERVAL '00:00:01.5' HOUR TO SECOND a, INTERVAL '-26:00:00.000001' HOUR TO SECOND b, INTERVAL '5' SECOND c, CAST('-0.0' AS DOUBLE) d, CAST('-1.5E-9' AS DOUBLE) e")
    rx.write_delim(df, str(tmp_path / "x.csv.zip"), ",")
    with zipfile.ZipFile(tmp_path / "x.csv.zip") as z:
        assert z.namelist() == ["x.csv"] and z.read("x.csv").decode() == "a,b,c,d,e\n00:00:01.5,-26:00:00.000001,00:00:05,0,-1.5e-9\n"
    frame = rx.read_delim(spark, str(tmp_path / "x.csv.zip"), delim=",", col_types="tttdd", col_select=["c", "e"])
    assert frame.df.first().e == -1.5e-9
