import rectio as rx


def test_later_lines_settle_where_columns_end(spark):
    # left-aligned keys grow to the right, right-aligned sizes to the left, beyond the first 101 lines
    lines = [f"{k:<8d}name{k % 7}{k * k:>14d}  t{k}" for k in range(1500)]
    frame = rx.read_fwf(spark, rx.I(lines), col_types="icic")
    assert sorted(map(tuple, frame.df.collect())) == [(k, f"name{k % 7}", k * k, f"t{k}") for k in range(1500)]
    first = [f"{'':5}{k}  x" for k in range(10)] * 12
    frame = rx.read_fwf(spark, rx.I([*first, "123456  y"]), col_types="ic")
    assert (123456, "y") in [tuple(r) for r in frame.df.collect()]
    # where all lines share no blank the first lines' places stay, and comments play no part
    lines = [f"{k}    {k}" for k in range(10)] * 12 + ["a whole line of text", "# a whole line of text"]
    for some in (lines, lines[:-2] + lines[-1:]):
        frame = rx.read_fwf(spark, rx.I(some), comment="#", col_types="cc")
        assert [tuple(r) for r in frame.df.collect()][:10] == [(str(k), str(k)) for k in range(10)]
    assert rx.read_fwf(spark, rx.I(["one", "two"]), col_types="c").df.count() == 2
