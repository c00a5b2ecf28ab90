import pytest

from rectio.plans import select as sel
from rectio.plans import spec as sp


def test_specifications():
    assert [c.kind for c in sp.as_col_spec("dc_?").cols.values()] == ["double", "character", "skip", "guess"]
    assert sp.cols(a="i", b=sp.col_date("%Y")).cols["b"].format == "%Y"
    assert sp.cols_only(a="i").default.kind == "skip"
    assert sp.as_col_spec({"a": "d", ".default": "c"}).default.kind == "character"
    with pytest.raises(ValueError):
        sp.as_col_spec({"a": "whatever"})
    spec = sp.cols_condense(sp.cols(a="d", b="d", c="c"))
    assert spec.default.kind == "double" and list(spec.cols) == ["c"]
    assert "a = col_double()" in str(sp.cols(a="d"))
    assert sp.cols(a="d", b="d", c="_").summary() == {"double": ["a", "b"]}


def test_standardise():
    assert [c.kind for c in sp.standardise(sp.as_col_spec("dd"), ["a", "b", "c"])] == ["double", "double", "guess"]
    with pytest.warns(sp.MismatchedColumnName):
        assert [c.kind for c in sp.standardise(sp.cols(z="d", b="i"), ["a", "b"])] == ["guess", "integer"]


def test_names():
    assert sp.make_names(["a"], 3) == ["a", "X2", "X3"] and sp.make_names(["a", "b"], 1) == ["a"]
    assert sp.repair_names(["x", "", "x"]) == ["x...1", "...2", "x...3"]
    assert sp.repair_names(["a b", "1"], "universal") == ["a.b", "...1"]
    assert sp.repair_names(["a"], lambda n: [x.upper() for x in n]) == ["A"]
    with pytest.raises(ValueError):
        sp.repair_names(["a", "a"], "check_unique")


def test_selection():
    names = ["a", "b1", "b2", "c"]
    pick = lambda s: [old for old, _ in sel.resolve(s, names)]
    assert pick(None) == names and pick("c") == ["c"] and pick([2, "a"]) == ["b1", "a"]
    assert pick([sel.starts_with("B")]) == ["b1", "b2"] and pick([sel.ends_with("2")]) == ["b2"]
    assert pick(["-a"]) == ["b1", "b2", "c"] and pick([~sel.contains("b")]) == ["a", "c"] and pick([-1]) == names[1:]
    assert pick([sel.span("b1", "c"), "a"]) == ["b1", "b2", "c", "a"] and pick([sel.last_col(), sel.everything()]) == ["c", "a", "b1", "b2"]
    assert pick([sel.num_range("b", [2, 1])]) == ["b2", "b1"] and pick([sel.one_of("c", "zz")]) == ["c"] and pick([sel.matches("^b")]) == ["b1", "b2"]
    assert sel.resolve({"new": "a"}, names) == [("a", "new")]
    with pytest.raises(ValueError):
        sel.resolve("zz", names)
