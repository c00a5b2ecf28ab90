import gzip
import math

import pytest

import rectio as rx

# text, options, columns, rows (None: not compared), problems (row, col, expected, actual)
CASES = {
    "na_set": ("u,v,w\nmissing,8,9\n2.5,11,12\n", {"na": ["missing"], "col_types": "ddd"}, ["u", "v", "w"], [(None, 8.0, 9.0), (2.5, 11.0, 12.0)], []),
    "trim_inside_quotes": ('u,v,w\n" left","right \t","\tboth "\n', {}, ["u", "v", "w"], [("left", "right", "both")], []),
    "doubled_quotes": ('"say ""hi""","""""","end"""\n', {"col_names": False}, ["X1", "X2", "X3"], [('say "hi"', '""', 'end"')], []),
    "backslash": ('one\\,two,\\"three\\",\\\\\n', {"col_names": False, "escape_backslash": True, "escape_double": False}, ["X1", "X2", "X3"], [("one,two", '"three"', "\\")], []),
    "leading_blanks": ("  \n\t\n\nu,v\n4,5\n", {"col_types": "ii"}, ["u", "v"], [(4, 5)], []),
    "skip_and_comment": ("title\n%u,v\n\nu,v\n%x\n4,5\n", {"skip": 1, "comment": "%", "col_types": "ii"}, ["u", "v"], [(4, 5)], []),
    "short_row": ("p,q,r\n7\n8,9,10\n", {"col_types": "iii"}, ["p", "q", "r"], [(7, None, None), (8, 9, 10)], [(2, 1, "3 columns", "1 columns")]),
    "long_row": ("p,q\n1,2,3,4\n5,6\n", {"col_types": "ic"}, ["p", "q"], [(1, "2,3,4"), (5, "6")], [(2, 4, "2 columns", "4 columns")]),
    "newline_in_header": ('"first\nsecond",n\nx,1\n', {"col_types": "ci"}, ["first\nsecond", "n"], [("x", 1)], []),
    "quote_inside_field": ('inch\n12" pipe\nplain\n', {"col_types": "c"}, ["inch"], [('12" pipe',), ("plain",)], []),
    "comment_at_end": ("n,t % names\n4, % no text\n5,x%\n% nothing\n6\n", {"comment": "%", "col_types": "ic"}, ["n", "t"], [(4, None), (5, "x"), (6, None)], None),
    "quoted_comment": ('t\n"10%"\n', {"comment": "%", "col_types": "c"}, ["t"], [("10%",)], []),
    "cr_only": ("u,v\r7,8\r9,10\r", {"col_types": "ii"}, ["u", "v"], [(7, 8), (9, 10)], []),
    "unclosed_quote": ('P,Q\n1,"open\n2,x', {"col_types": "ic"}, ["P", "Q"], [(1, "open\n2,x")], []),
    "names_repaired_first": ("k,\n5,6\n7,8", {"col_types": {"...2": "d", "k": "i"}}, ["k", "...2"], [(5, 6.0), (7, 8.0)], []),
    "value_problem": ("k,m\n3,4\n5,six\n", {"col_types": "dd"}, ["k", "m"], [(3.0, 4.0), (5.0, None)], [(3, 2, "a double", "six")]),
    "multibyte_delim": ('id||name\n1||"b||c"\n2||NA\n', {"delim": "||", "col_types": "ic"}, ["id", "name"], [(1, "b||c"), (2, None)], []),
    "n_max": ("a\n1\n2\n3\n", {"n_max": 2, "col_types": "i"}, ["a"], [(1,), (2,)], []),
    "n_max_zero": ("a,b\n1,2\n", {"n_max": 0, "col_types": "ii"}, ["a", "b"], [], []),
    "blank_rows_kept": ("a,b\n1,2\n\n3,4\n", {"skip_empty_rows": False, "col_types": "ii"}, ["a", "b"], [(1, 2), (None, None), (3, 4)], None),
    "cols_only": ("a,b\n1,2\n", {"col_types": rx.cols_only(b="i")}, ["b"], [(2,)], []),
    "factor": ("a\nx\ny\nz\n", {"col_types": {"a": rx.col_factor(["x", "y"])}}, ["a"], [("x",), ("y",), (None,)], [(4, 1, "value in level set", "z")]),
    "empty_with_types": ("", {"col_types": "ii"}, ["X1", "X2"], [], []),
    "names_longer": ("1,2\n", {"col_names": ["a"], "col_types": "ii"}, ["a", "X2"], [(1, 2)], []),
    "no_trim": ("a\n x \n", {"trim_ws": False, "col_types": "c"}, ["a"], [(" x ",)], []),
    "no_quote": ('a\n"x"\n', {"quote": "", "col_types": "c"}, ["a"], [('"x"',)], []),
}


@pytest.mark.parametrize("name", CASES)
def test_delimited(spark, name):
    text, options, columns, rows, problems = CASES[name]
    frame = rx.read_delim(spark, rx.I(text), **{"delim": ",", **options})
    assert frame.df.columns == columns
    assert sorted(map(tuple, frame.df.collect()), key=repr) == sorted(rows, key=repr)
    if problems is not None:
        assert [tuple(r)[:4] for r in frame.problems().collect()] == problems


def test_guesses(spark):
    frame = rx.read_delim(spark, rx.I("a;b;c;d;e;f;g\n1;2020-01-02;2020-01-02T03:04:05Z;12:34:56;TRUE;1,234.5;x\n2;NA;NA;NA;NA;NA;NA\n"))
    assert [c.kind for c in frame.spec.cols.values()] == ["double", "date", "datetime", "time", "logical", "number", "character"]
    assert frame.spec.delim == ";"
    # the last row is always looked at
    text = "x\n" + "NA\n" * 10 + "5\n"
    assert rx.read_delim(spark, rx.I(text), delim=",", guess_max=5).spec.cols["x"].kind == "double"
    assert rx.guess_type(spark, []) == "character" and rx.guess_type(spark, ["NA"]) == "logical" and rx.guess_type(spark, ["1"], guess_integer=True) == "integer"
    with pytest.raises(ValueError):
        rx.read_delim(spark, rx.I("abc\ndef\n"))


def test_files_of_many_kinds(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("A,B\n1,2\n")
    (tmp_path / "c.csv").write_text("A,B\n3,4\n")
    frame = rx.read_delim(spark, [str(tmp_path / "a b.csv"), str(tmp_path / "c.csv")], delim=",", col_types="ii", id="path")
    assert sorted((r.path.rsplit("/", 1)[-1], r.A) for r in frame.df.collect()) == [("a b.csv", 1), ("c.csv", 3)]
    (tmp_path / "d.csv").write_text("A,B,C\n1,2,3\n")
    with pytest.raises(ValueError, match="columns"):
        rx.read_delim(spark, [str(tmp_path / "c.csv"), str(tmp_path / "d.csv")], delim=",", col_types="ii")
    (tmp_path / "e.csv").write_text("A,X\n1,2\n")
    with pytest.raises(ValueError, match="names"):
        rx.read_delim(spark, [str(tmp_path / "c.csv"), str(tmp_path / "e.csv")], delim=",", col_types="ii")
    with pytest.raises(FileNotFoundError):
        rx.read_delim(spark, str(tmp_path / "missing.csv"))
    (tmp_path / "f.bin").write_bytes(gzip.compress(b"A,B\n5,6\n"))
    assert rx.read_delim(spark, str(tmp_path / "f.bin"), delim=",", col_types="ii").df.first().A == 5
    wide = "A,B\n7,é\n".encode("utf-16")
    assert rx.read_delim(spark, wide, delim=",", col_types="ic").df.first().B == "é"


def test_fixed_width(spark):
    frame = rx.read_fwf(spark, rx.I("10200x\n30405yyyyyy\n60708z"), rx.fwf_widths([2, 3, None]), col_types="iic")
    assert sorted(map(tuple, frame.df.collect())) == [(10, 200, "x"), (30, 405, "yyyyyy"), (60, 708, "z")]
    frame = rx.read_fwf(spark, rx.I("123456\n"), rx.fwf_positions([1, 3, 5], [4, 4, 5], ["a", "b", "c"]), col_types="ccc", col_select=["c", "a"])
    assert list(map(tuple, frame.df.collect())) == [("5", "1234")]
    assert rx.fwf_empty(spark, rx.I("ab  12\ncd   3\n")) == rx.fwf_widths([4, None]).__class__((0, 4), (2, None), ("X1", "X2"))
    assert rx.fwf_cols(a=2, b=3).end == (2, 5) and rx.fwf_cols(a=(1, 2)).begin == (0,)
    with pytest.raises(ValueError):
        rx.fwf_positions([3], [1])
    frame = rx.read_fwf(spark, rx.I("éa1\nbcx\n"), rx.fwf_widths([3, 1]), col_types="cc")
    assert sorted(map(tuple, frame.df.collect())) == [("bcx", None), ("éa", "1")]
    bad = rx.read_fwf(spark, rx.I("1x\n22\n"), rx.fwf_widths([1, 1]), col_types="ii").problems().collect()
    assert [tuple(r)[:4] for r in bad] == [(1, 2, "an integer", "x")]


def test_lines(spark):
    read = lambda text, **o: [r.V1 for r in rx.read_lines(spark, rx.I(text), **o).collect()]
    assert read("ash\n\r\nbirch\r\n\ncedar\n") == ["ash", "", "birch", "", "cedar"]
    assert read("ash\n\nbirch\n", skip_empty_rows=True) == ["ash", "birch"]
    assert read("a\nb\nc\n", skip=1, n_max=1) == ["b"] and read("a\nNA\n", na=["NA"]) == ["a", None]
    assert read("a\nb\n", n_max=math.inf) == ["a", "b"]


def test_pruned_columns_are_not_parsed(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c\n" + "1,2,3\n" * 10)
    df = rx.read_delim(spark, str(tmp_path / "x.csv"), delim=",", col_types="ddd", multiline=False).df
    plan = df.select("b")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_cast") + plan.count("tryeval") + plan.lower().count("as double") <= 4
