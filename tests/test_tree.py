"""Trees, written as nested markup of the parsed page: the standard's repairs, each in a small case of our own."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafloom.errors import LimitError
from leafloom.kernel.flat import parse_html
from leafloom.kernel.serialize import serialize
from leafloom.kernel.tree import parse_tree
from leafloom.limits import Limits


def body(html, **options):
    s = serialize(parse_html(html, **options), 0)
    return s.removeprefix("<html><head></head><body>").removesuffix("</body></html>")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<b>1<p>2</b>3", "<b>1</b><p><b>2</b>3</p>"),
        ("<a>1<a>2", "<a>1</a><a>2</a>"),
        ("<table>x<tr><td>y", "x<table><tbody><tr><td>y</td></tr></tbody></table>"),
        ("<table><b>x</b></table>", "<b>x</b><table></table>"),
        ("<ul><li>a<li>b</ul>c", "<ul><li>a</li><li>b</li></ul>c"),
        ("<h1>a<h2>b", "<h1>a</h1><h2>b</h2>"),
        ("</p>", "<p></p>"),
        ("a</br>b", "a<br>b"),
        ("<pre>\n\nx</pre>", "<pre>\nx</pre>"),
        ("<svg><p>x", "<svg></svg><p>x</p>"),
        ("<svg viewbox=1 xlink:href=u><lineargradient/></svg>", '<svg viewBox="1" xlink:href="u"><linearGradient></linearGradient></svg>'),
        ("<math><mi><b>x</b></mi></math>", "<math><mi><b>x</b></mi></math>"),
        ("<svg><![CDATA[a<b]]></svg><![CDATA[c]]>", "<svg>a&lt;b</svg><!--[CDATA[c]]-->"),
        ("<select><option>1<option>2</select>", "<select><option>1</option><option>2</option></select>"),
        ("<select><input>", "<select></select><input>"),
        ("<select><button><selectedcontent></button><option>1<option selected>2", '<select><button><selectedcontent>2</selectedcontent></button><option>1</option><option selected="">2</option></select>'),
        ("<template><td>x</template>", "<template><td>x</td></template>"),
        ("<ruby>a<rt>b<rp>c", "<ruby>a<rt>b</rt><rp>c</rp></ruby>"),
        ("x<?pi  data?>y", "x<?pi data?>y"),
        ("x<?xml v?>", "x<!--?xml v?-->"),
        ("&amp &lt; &notit; &#x80; &#0; &bogus;", "&amp; &lt; ¬it; € � &amp;bogus;"),
        ("<a href='?a=1&copy=2&amp;b'>", '<a href="?a=1&amp;copy=2&amp;b"></a>'),
        ("<script>a<!--<script></script>b--></script>c", "<script>a<!--<script></script>b--></script>c"),
        ("<title>a<b></title><textarea>\nx</textarea>", "<textarea>x</textarea>"),
        ("<!--a--!>b<!-->c", "<!--a-->b<!---->c"),
        ("<p a=1 a=2 B=3>", '<p a="1" b="3"></p>'),
        ("<search><p>x</search>", "<search><p>x</p></search>"),
        ("<form><div></form>x", "<form><div>x</div></form>"),
        ("<nobr>a<nobr>b", "<nobr>a</nobr><nobr>b</nobr>"),
        ("<i><i><i><i>x</p>y", "<i><i><i><i>x<p></p>y</i></i></i></i>"),
    ],
)
def test_repairs(html, want):
    got = body("<body>" + html) if not html.startswith("<title>") else body("<body>" + html).replace("<title>a&lt;b&gt;</title>", "")
    assert got == want


@pytest.mark.parametrize(("doctype", "mode"), [("<!DOCTYPE html>", "no-quirks"), ("", "quirks"), ('<!DOCTYPE HTML PUBLIC "-//W3C//DTD HTML 4.01 Transitional//EN">', "quirks"), ('<!DOCTYPE HTML PUBLIC "-//W3C//DTD XHTML 1.0 Frameset//EN" "u">', "limited-quirks"), ("<!DOCTYPE>", "quirks")])
def test_quirks(doctype, mode):
    assert parse_tree(doctype + "<p>").quirks == mode


def test_fragments():
    assert serialize(parse_html("<td>x", context="tr"), 0) == "<td>x</td>"
    assert serialize(parse_html("<td>x", context="div"), 0) == "x"
    assert serialize(parse_html("</script>a", context="script"), 0, raw=True) == "</script>a"
    assert serialize(parse_html("<circle/>", context="svg svg"), 0) == "<circle></circle>"


def test_comments_may_be_left_out_without_joining_text():
    t = parse_html("<p>a<!--c-->b", comments=False)
    assert [t.value[i] for i in range(len(t.type)) if t.type[i] == "text"] == ["a", "b"]


def test_limits():
    with pytest.raises(LimitError) as e:
        parse_html("<div>" * 20, Limits(max_depth=10))
    assert (e.value.limit, e.value.maximum, e.value.observed) == ("max_depth", 10, 11)
    parse_html("<div>" * 8, Limits(max_depth=10))
    with pytest.raises(LimitError):
        parse_html("<b></b>" * 20, Limits(max_nodes=10))
    for bad in ({"max_depth": 0}, {"max_input": 1.5}, {"max_errors": True}):
        with pytest.raises(ValueError):
            Limits(**bad)


def test_deep_and_misnested_pages_end_soon():
    import time

    t = time.perf_counter()
    with pytest.raises(LimitError):
        parse_html("<div>" * 100_000)
    parse_html("<a><b>" * 200)
    assert time.perf_counter() - t < 5


tags = st.sampled_from("a b p div span table tr td ul li h1 pre select option svg math template form i".split())
pieces = st.one_of(tags.map("<{}>".format), tags.map("</{}>".format), st.sampled_from(["x", " ", "&amp;", "<!--c-->", "<br>", "y\n"]))


@settings(max_examples=200, deadline=None)
@given(st.lists(pieces, max_size=25))
def test_intervals_nest_and_rows_agree(parts):
    t = parse_html("".join(parts))
    for i in range(1, len(t.type)):
        p = t.parent[i]
        assert p < i <= t.end[i] <= t.end[p]
    rows = t.rows()
    for r in rows:
        if r["next_elem"] is not None:
            assert rows[r["next_elem"]]["parent"] == r["parent"] and rows[r["next_elem"]]["elem_pos"] == (r["elem_pos"] or sum(1 for k in t.kids[r["parent"]] if k < r["id"] and t.type[k] == "element")) + 1


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/!-?abp =\"'&;#\n", max_size=60))
def test_any_input_parses_and_its_markup_settles(text):
    once = serialize(parse_html(text), 0)
    twice = serialize(parse_html(once), 0)
    assert serialize(parse_html(twice), 0) == serialize(parse_html(serialize(parse_html(twice), 0)), 0)
