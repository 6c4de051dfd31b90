import random

import pytest

from leafloom.errors import LimitError
from leafloom.kernel import shapes as H
from leafloom.limits import Limits
from leafloom.sources.pages import nodes_of, tree

COLUMNS = ("type", "ns", "name", "value", "parent", "end", "attrs", "kids", "is_fragment", "doctype")
#: Markup in which # is a place for text and ? one for a value.
PAGES = [
    "<table><tr><td id=?>#<td>#</table>", "<table>#<tr>#<td></table>", "<table><input type=? name='?'>#</table>", "<p>#<b class=?><b class=?><b class=?><b class=?>#</p>#", "<textarea>#</textarea><pre>#</pre><title>#<i x=?></title>",
    "<script>#<b x=?>#</script>", "<math><annotation-xml encoding=?><p>#</p></math>", "<frameset>#<frame src=?></frameset>#", "<select><button><selectedcontent></button><option value='?'>#<option selected>#</select>", "<!DOCTYPE html>#<head>#<base href=?>#</head>#<!-- c -->#",
    "<a href=?>#<a href=?>#<table><a href=?>#</a></table>", "<svg viewbox=? xlink:href='?'><title>#</title></svg>", "<body id=?><html id=? lang=?>#", "<template><td>#</template><div x=? x=?>#", "#<col span=?>#<colgroup>#",
]
TEXTS = ["x", "y z", "", " ", "\n", "\nq ", " -- ", "'\"", "=", "é\x80", "a &amp; b", "a < b", ">", "", "/", "\r\nx", "\x0b"]
VALUES = ["v", "w", "hidden", "text/html", "a/", "&lt;", "é"]


def shown(t):
    return tuple(getattr(t, c) for c in COLUMNS) + (t.columns(), t.base, t.templates(), t.root)


@pytest.mark.parametrize("context", [None, "div", "table", "template", "colgroup"])
@pytest.mark.parametrize("page", PAGES)
def test_trees_by_way_of_shapes_are_those_of_the_builder(page, context):
    r = random.Random(page)
    for _ in range(150):
        html = "".join(r.choice(TEXTS) if c == "#" else r.choice(VALUES) if c == "?" else c for c in page)
        assert shown(nodes_of(html, context=context, base_url="http://a.test/")) == shown(tree(html, context=context, base_url="http://a.test/")[0]), html


def test_pages_of_one_shape_are_built_twice_at_most(monkeypatch):
    built, real = [], H.parse_tree
    monkeypatch.setattr(H, "parse_tree", lambda *a: built.append(a) or real(*a))
    monkeypatch.setattr(H, "_kept", {})
    got = [nodes_of(f"<form><input name=a value='{i} x'><p>{i}</form>").value[-1] for i in range(50)]
    assert got == [str(i) for i in range(50)] and len(built) == 2


def test_limits_and_room(monkeypatch):
    monkeypatch.setattr(H, "ROOM", 100)
    for i in range(200):
        html = f"<{'b' * (i // 4 + 1)}>{i}"
        assert shown(nodes_of(html)) == shown(tree(html)[0])
    assert sum(len("".join(map(str, k))) for k in H.shapes(Limits()).known) < 200
    for _ in range(3):
        with pytest.raises(LimitError):
            nodes_of("<i></i>" * 20, limits=Limits(max_nodes=10))
