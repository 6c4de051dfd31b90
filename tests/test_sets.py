"""Lazy sets of nodes: what they give on rows, against the joins over a table of nodes and against the kernel."""

import pytest

from leafloom.errors import InputError
from leafloom.operators import extract as E
from leafloom.operators import nodes as N
from leafloom.operators.sets import find
from leafloom.sources.pages import Pages
from test_selectors import CSS, PAGE


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, PAGE, "https://h/x"), (2, "<p>x<p>y<ul><li><ul><li>q", None), (3, "", None), (4, None, None)]
    return Pages(spark.createDataFrame(rows, "page_id long, html string, url string"), base_url="url")


def ids(nodes):
    return sorted((r["page_id"], r["n"], r["id"]) for r in nodes.rows("id").collect())


def flat(nodes, page=1):
    return [i for k, _, i in ids(nodes) if k == page]


def test_searches_agree_with_joins(spark, pages):
    table = N.nodes(pages.parsed()).cache()
    for css in ("main p", "li:nth-child(odd)", "h2 ~ p, em", "section > :not(p)", "p:nth-of-type(2)"):
        assert sorted((k, i) for k, _, i in ids(find(pages, css))) == sorted((r[0], r[1]) for r in N.elements(table, css).select("page_id", "id").collect()), css
    li, ul = find(pages, "li"), find(pages, "ul")
    as_rows = N.elements(table, "li").select("page_id", "id")
    assert sorted((k, i) for k, _, i in ids(li.closest("main, ul"))) == sorted((r["page_id"], r["match_id"]) for r in N.closest(table, "main, ul", as_rows).collect())
    assert sorted((k, i) for k, _, i in ids(ul.ancestors())) == sorted((r["page_id"], r["id"]) for r in N.ancestors(table, N.elements(table, "ul")).collect())
    assert len(CSS) > 30
    table.unpersist()


def test_aligned_steps_keep_places(pages):
    li = find(pages, "li")
    rows = [r for r in li.rows("id", "name", up=li.parent(), next=li.sibling(), first=li.element("li"), matches={"second": ":nth-child(2)"}).orderBy("page_id", "n").collect() if r["page_id"] == 1]
    assert [r["n"] for r in rows] == [1, 2, 3, 4] and {r["up"]["name"] for r in rows} == {"ul"}
    assert [r["next"] and r["next"]["id"] for r in rows] == [rows[1]["id"], rows[2]["id"], rows[3]["id"], None]
    assert [r["second"] for r in rows] == [False, True, False, False] and all(r["first"] is None for r in rows)
    with pytest.raises(InputError):
        li.rows("id", up=find(pages, "ul"))
    with pytest.raises(InputError):
        li.rows("no_such_column")


def test_places_lengths_and_sets(pages):
    li, p = find(pages, "li"), find(pages, "main > p")
    a, b, c, d = flat(li)
    assert flat(li.at(2, 9, 1)) == [b, None, a] and flat(li.at(-1)) == [b, c, d] and flat(li.length(2)) == [a, b] and flat(li.length(6))[4:] == [None, None]
    assert flat(li.rev()) == [d, c, b, a] and flat(li.rep(2)) == [a, b, c, d] * 2 and flat(li.rep(2).unique()) == [a, b, c, d]
    assert flat(li.put(2, p)) == [a, flat(p)[0], c, d] and flat(li.put(6, None)) == [a, b, c, d, None, None]
    assert flat(li.concat(p).sort()) == sorted(flat(li) + flat(p)) and flat(li.union(li)) == [a, b, c, d]
    assert flat(li.intersect(li.at(3))) == [c] and flat(li.difference(li.at(3))) == [a, b, d]
    assert flat(find(pages, "ul").concat(li).outermost()) == flat(find(pages, "ul"))
    for bad in ((0,), (1, -1), (True,)):
        with pytest.raises(InputError):
            li.at(*bad)
    with pytest.raises(InputError):
        li.union(find(Pages(pages.df), "p"))
    with pytest.raises(InputError):
        li.put(0, None)


def test_templates_roots_and_missing_nodes(pages):
    t = find(pages, "template")
    assert flat(t.children()) == [] and len(flat(t.template_content())) == 1 and flat(t.elements("p")) == []
    assert flat(t.template_content().elements(":scope")) == flat(t.template_content())
    assert [k for k, _, i in ids(find(pages).root()) if i is not None] == [1, 2, 3]
    assert flat(find(pages).document()) == [0] and flat(find(pages).closest("*")) == [None] and flat(find(pages).parent()) == [None]
    gone = find(pages, "li").at(9)
    assert flat(gone.parent()) == [None] and flat(gone.elements("*")) == [] and E.text(gone).where("page_id = 1").first()["text"] is None


def test_extraction_starts_from_nodes(spark):
    html = "<base href='/d/'><nav><a href=1>one</a></nav><article><a href=2>two</a><table id=t><tr><td>c<table><tr><td>in</table></table><ul><li>x</ul><form name=f><input name=i></form><meta name=m content=v></article><input name=o form=no>"
    docs = Pages(spark.createDataFrame([(1, html, "https://h/p")], "page_id long, html string, url string"), base_url="url")
    article, parsed = find(docs, "article"), docs.parsed()
    table = N.nodes(parsed)
    at = N.elements(table, "article").select("page_id", "id")
    for f in (lambda s, **o: E.links(s, **o), lambda s, **o: E.tables(s, **o), lambda s, **o: E.lists(s, **o), lambda s, **o: E.form_fields(s, **o), lambda s, **o: E.meta(s, **o), lambda s, **o: E.markdown(s, **o), lambda s, **o: E.table_cells(s, **o)):
        assert sorted(map(str, f(article).collect())) == sorted(map(str, f(parsed, at=at).collect())) != []
    assert [tuple(r)[2:] for r in E.links(article).collect()] == [("two", "2", "https://h/d/2")]
    assert E.links(find(docs, "a").at(1)).first()["href"] == "1"
    assert [r["value"] for r in E.tables(find(docs, "#t")).collect()] == [r["value"] for r in E.tables(docs).collect()]
    assert E.tables(find(docs, "nav")).count() == 0 and E.forms(find(docs, "form")).first()["name"] == "f"
    assert E.title(docs).first()["title"] is None and E.urls(find(docs, "a")).first()["url"] == "https://h/d/1"


def test_a_page_that_fails(spark):
    df = spark.createDataFrame([(1, bytearray(b"<p>a")), (2, bytearray(b"\xe9"))], "page_id long, html binary")
    assert [r["page_id"] for r in find(Pages(df), "p").rows("id").collect()] == [1]
    with pytest.raises(Exception, match="encoding"):
        find(Pages(df, mode="FAILFAST"), "p").rows("id").collect()
