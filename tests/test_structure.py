from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafloom.errors import LimitError, TableError
from leafloom.kernel import structure as S
from leafloom.kernel.flat import parse_html
from leafloom.kernel.tables import cells, convert, grid, table, unique
from leafloom.kernel.urls import resolve

# The examples of RFC 3986, section 5.4.
RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
    "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/",
    "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/",
    "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g", "a b": None, " g ": "http://a/b/c/g",
}


def test_references_in_python_and_in_spark(spark):
    from pyspark.sql import functions as F

    from leafloom.functions.columns import resolve as column

    base = "http://a/b/c/d;p?q"
    assert {r: resolve(r, base) for r in RFC} == RFC
    more = [("x", None), ("x", "rel/"), ("x", "http://h"), ("//h/a/../b", "s://q"), ("//h//a//../b", "s://q"), ("http://h/%7E", None), (None, base), ("1x:y", base)]
    rows = [(r, base) for r in RFC] + more
    got = spark.createDataFrame(rows, "r string, b string").select("r", "b", column(F.col("r"), F.col("b")).alias("u")).collect()
    assert {(r, b): u for r, b, u in got} == {(r, b): resolve(r, b) for r, b in rows}


def one(html):
    t = parse_html(html)
    return t, t.name.index("table")


def test_tables():
    names, rows = table(*one("<table><thead><tr><th>a<th colspan=2>b<tr><th>a<th>c<th></thead><tr><td>1<td rowspan=2>2<td>3<tr><td>4<td>5</table>"))
    assert names == ["a", "b / c", "b"] and rows == [["1", "2", "3"], ["4", "2", "5"]]
    names, rows = table(*one("<table><tr><td>x<tr><td>y<td>z</table>"))
    assert names == ["V1", "V2"] and rows == [["x", None], ["y", "z"]]
    assert table(*one("<table><tr><th>h<tr><th>i</table>"))[1] == []
    assert table(*one("<table><tr><td>h<tr><td>1</table>"), header=True) == (["h"], [["1"]])
    with pytest.raises(TableError) as e:
        grid(*one("<table><tr><td>k<td>l<td rowspan=3>m<tr><td>n<tr><td>o<td colspan=4>p</table>"))
    assert (e.value.row, e.value.cell) == (3, 2)
    with pytest.raises(LimitError):
        grid(*one("<table><tr>" + "<td>x" * 20 + "</table>"), 10)
    g = grid(*one("<table><tfoot><tr><td>f</tfoot><tr><td rowspan=0>a<td colspan=x>b<tr><td>c</table>"))
    assert [s for _, s in g.rows] == ["tbody", "tbody", "tfoot"] and g.cells[0].rowspan == 2


def test_cells_have_links():
    got = cells(*one("<table><tr><th>a<td rowspan=2 colspan=3><a href=u>x</a><table><tr><td><a href=v>y</a></table></table>"))
    assert got[0]["header"] and got[1]["links"] == ["u"] and (got[1]["rowspan"], got[1]["colspan"], got[1]["text"]) == (1, 3, "x")


@given(st.lists(st.sampled_from(["total", "total.1", "total.2", "year", "year.1", ""]), max_size=9))
def test_names_are_made_unique(names):
    """Every name once; first uses keep theirs, and later ones get the least free number behind."""
    got = unique(names)
    assert len(set(got)) == len(names)
    for i, (n, g) in enumerate(zip(names, got, strict=True)):
        if n not in names[:i]:
            assert g == n
        else:
            stem, _, number = g.rpartition(".")
            assert stem == n and all(f"{n}.{k}" in {*names, *got[:i]} for k in range(1, int(number)))


def decimal_kind(texts):
    """What a column of numbers becomes, by exact arithmetic: whole and of 32 bits; of at most 15 significant digits and as large as a normal
    float; or text, as are numbers with zeros in front."""
    seen = [Decimal(t) for t in texts]
    for t, d in zip(texts, seen, strict=True):
        whole = t.lstrip("+-").lower().split("e")[0].split(".")[0]
        if len(whole) > 1 and whole[0] == "0":
            return "character"
        digits = "".join(map(str, d.as_tuple().digits)).strip("0")
        if len(digits) > 15 or (d and not Decimal("2.2250738585072014e-308") <= abs(d) < Decimal("1.7976931348623158e308")):
            return "character"
    return "integer" if all(t.lstrip("+-").isdigit() and abs(d) < 2**31 for t, d in zip(texts, seen, strict=True)) else "double"


number = st.builds(
    lambda sign, whole, part, power: f"{sign}{whole}{part}{power}", st.sampled_from(["", "-", "+"]), st.one_of(st.integers(0, 10**4).map(str), st.integers(10**13, 10**17).map(str), st.just("00"), st.integers(2**31 - 2, 2**31 + 1).map(str)),
    st.one_of(st.just(""), st.integers(0, 10**15).map(lambda n: f".{n}"), st.just(".")), st.one_of(st.just(""), st.integers(-330, 310).map(lambda n: f"e{n}")),
)


@settings(max_examples=400)
@given(st.lists(number, min_size=1, max_size=3))
def test_numbers_convert_as_by_exact_arithmetic(texts):
    kind, values = convert([*texts, None])
    assert kind == decimal_kind(texts) and values[-1] is None
    if kind != "character":
        assert [float(v) for v in values[:-1]] == [float(t) for t in texts]
    else:
        assert values[:-1] == texts


@given(st.lists(st.sampled_from(["TRUE", "T", "False", "f", "yes", "0", " T"]), min_size=1, max_size=4))
def test_truth_values_convert_all_or_none(texts):
    words = {"TRUE": True, "T": True, "False": False}
    kind, values = convert(texts)
    if all(t in words for t in texts):
        assert (kind, values) == ("logical", [words[t] for t in texts])
    else:
        assert kind == ("integer" if set(texts) == {"0"} else "character")
    assert convert([None, None]) == ("character", [None, None])


def test_conversion_of_grouped_numbers():
    assert convert(["1,234", "5"], thousands=",") == ("integer", [1234, 5])
    assert convert(["1.234,5"], decimal=",", thousands=".") == ("double", [1234.5])
    assert convert(["12,34"], thousands=",")[0] == "character"
    assert convert(["1 234"], thousands="\xa0") == ("integer", [1234])
    for bad in ({"decimal": ""}, {"decimal": "1"}, {"thousands": "."}, {"thousands": "e"}):
        with pytest.raises(ValueError):
            convert(["1"], **bad)


def test_lists():
    t = parse_html("<ol><li>a<ul><li>b<li>c</ul>tail<li>d</ol>")
    i = t.name.index("ol")
    assert S.items(t, i) == ["a\ntail", "d"]
    assert [(r["path"], r["type"], r["text"]) for r in S.list_rows(t, i)] == [("1", "ol", "a\ntail"), ("1.1", "ul", "b"), ("1.2", "ul", "c"), ("2", "ol", "d")]


def test_forms():
    html = """<form id=f action=go method=POST><input name=a value=1><input type=checkbox name=c><input type=radio name=r checked><textarea name=t>
x</textarea><button name=b>B</button><select name=s><option>1<option value=v selected> 2 3</select><select name=m multiple><option selected>p<option selected>q</select>
<fieldset disabled><legend><input name=l></legend><input name=d></fieldset><input name=o form=""></form><input name=late form=f>"""
    f = S.forms(parse_html(html, base_url="https://h/x/"), [0])
    assert len(f) == 1 and f[0]["action"] == "https://h/x/go" and f[0]["method"] == "post" and f[0]["enctype"] == "application/x-www-form-urlencoded"
    by = {x["name"]: x for x in f[0]["fields"]}
    assert list(by) == ["a", "c", "r", "t", "b", "s", "m", "l", "d", "late"]
    assert by["c"]["value"] == "on" and by["c"]["checked"] is False and by["r"]["checked"] and by["a"]["checked"] is None
    assert by["t"]["value"] == "x" and by["b"]["type"] == "submit" and by["s"]["value"] == "v" and by["s"]["options"][1]["label"] == "2 3"
    assert by["m"]["type"] == "select-multiple" and by["m"]["value"] == "p" and not by["l"]["disabled"] and by["d"]["disabled"]
    first = S.forms(parse_html("<form><select name=s><option disabled>1<option>2</select><select name=z size=3><option>1</select></form>"), [0])[0]["fields"]
    assert [x["value"] for x in first] == ["2", ""]


def test_a_form_in_a_table_owns_what_follows_there():
    f = S.forms(parse_html("<table><form id=a><tr><td><input name=x></form></table><input name=y>"), [0])
    assert [x["name"] for x in f[0]["fields"]] == ["x"]


def test_metadata():
    t = parse_html("<svg><title>no</title></svg><title> a \n b</title><script type='application/ld+json'><!-- {\"a\": 1} --></script><script type='application/ld+json'>[</script>")
    assert S.title(t) == "a b" and [S.parsed_json(x) for x in S.json_ld(t, [0])] == [{"a": 1}, None]
    assert S.unwrap_json("/*<![CDATA[*/ {} /*]]>*/") == "{}"


def test_microdata():
    html = """<div itemscope itemtype="T U" itemref=r><b itemprop="n m"> x
 </b><p itemprop=c itemscope><a itemprop=u href=v>w</a><time itemprop=t datetime=d>e</time></p></div>
<i id=r itemprop=n>y</i><div itemscope id=k><p itemprop=self itemscope itemref=k></p></div>"""
    rows = S.microdata(parse_html(html, base_url="https://h/"), [0])
    got = [(r["item"], r["property"], r["ord"], r["value"], r["child"]) for r in rows if r["item"].startswith("1")]
    assert got == [("1", "n", 1, "x", None), ("1", "m", 1, "x", None), ("1", "c", 1, None, "1/c.1"), ("1", "n", 2, "y", None), ("1/c.1", "u", 1, "https://h/v", None), ("1/c.1", "t", 1, "d", None)]
    assert rows[0]["type"] == ["T", "U"]


def test_microdata_ids_types_and_urls():
    """An id counts only beside a type, a type counts once, and a reference that does not resolve is empty."""
    html = "<p itemscope itemid=i><a itemprop=u href=r>x</a></p><p itemscope itemtype='T  T U' itemid=i><img itemprop=v src=s></p>"
    first, second = S.microdata(parse_html(html), [0])
    assert (first["id"], first["type"], first["value"]) == (None, [], "") and (second["id"], second["type"], second["value"]) == (None, ["T", "U"], "")
    first, second = S.microdata(parse_html(html, base_url="https://h/a"), [0])
    assert (first["id"], first["value"], second["id"], second["value"]) == (None, "https://h/r", "https://h/i", "https://h/s")


def test_a_relative_base_is_resolved_once():
    t = parse_html("<base href='../b/'><form action=go></form><p itemscope><a itemprop=u href=x>y</a></p>", base_url="https://h/a/a/p")
    assert S.forms(t, [0])[0]["action"] == "https://h/a/b/go" and S.microdata(t, [0])[0]["value"] == "https://h/a/b/x"
