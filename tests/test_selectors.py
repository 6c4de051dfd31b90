import random

import pytest

from leafloom.errors import LimitError, SelectorError
from leafloom.kernel.flat import parse_html
from leafloom.kernel.selectors import Matcher, parse_selector
from leafloom.operators import nodes as N
from leafloom.sources.pages import parse

PAGE = """<!DOCTYPE html><main id=top class='x y'><h2 class=x>A</h2><p lang=EN data-k='u v'>1</p><p class=z title=''>2</p><em></em><i> </i>
<ul><li>1<li>2<li>3<li>4</ul><section><p>in</p><template><p class=z>hidden</p></template><svg viewBox='0'><foreignObject><p>f</p></foreignObject><a xlink:href=u></a></svg></section></main>"""
CSS = """* | p | P | #top | .x | main.x.y | [title] | [title=''] | [data-k~=v] | [data-k~=''] | [lang|=en] | [lang=en s] | [data-k^=u] | [data-k$=v] | [data-k*=' '] | [data-k*=''] | [DATA-K='U V' i]
| main p | main > p | h2 + p | h2 ~ p | p ~ em, p + em | main section p | body main > section > p | :root | :scope | :empty | main :empty | :first-child | p:last-child | :only-child | li:nth-child(odd) | li:nth-child(-n+2)
| li:nth-child(3n - 1) | p:nth-of-type(2) | :not(p):not(li) | li:not(:nth-child(2n)) | li ~ li ~ li | svg * | [viewBox] | [viewbox] | foreignObject | foreignobject | [xlink\\:href] | section > :not(p) | ul li, .x, li | em ~ ul > li + li""".split("|")


def test_the_compiled_plan_and_the_matcher_agree(spark):
    docs = parse(spark.createDataFrame([(1, PAGE), (2, "<p>x<p>y<ul><li><ul><li>q"), (3, "")], "page_id long, html string")).cache()
    all_nodes = N.nodes(docs).cache()
    trees = {1: parse_html(PAGE), 2: parse_html("<p>x<p>y<ul><li><ul><li>q"), 3: parse_html("")}
    for css in (c.strip() for c in "|".join(CSS).replace("lang|=", "lang\x00=").split("|")):
        css = css.replace("\x00", "|")
        want = sorted((k, i) for k, t in trees.items() for i in Matcher(t).select(parse_selector(css)))
        assert sorted((r[0], r[1]) for r in N.elements(all_nodes, css).select("page_id", "id").collect()) == want, css
    docs.unpersist()


def test_random_chains_agree(spark):
    r = random.Random(4)
    html = "".join(r.choice(["<div class=a>", "<p class=b>", "</div>", "</p>", "<i class=a></i>", "t"]) for _ in range(120))
    t = parse_html(html)
    all_nodes = N.nodes(parse(spark.createDataFrame([(1, html)], "page_id long, html string"))).cache()
    for _ in range(15):
        css = "".join(r.choice(["div", "p", "i", ".a", ".b", "*"]) + r.choice([" ", " > ", " + ", " ~ "]) for _ in range(r.randint(1, 3))) + r.choice(["div", ".a", "i:not(.b)"])
        assert sorted(x["id"] for x in N.elements(all_nodes, css).collect()) == sorted(Matcher(t).select(parse_selector(css))), css


def test_contexts(spark):
    docs = parse(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))
    a = N.nodes(docs).cache()
    main, ul = N.elements(a, "main"), N.elements(a, "ul")
    count = lambda df: df.count()
    assert count(N.elements(a, "main", main)) == 0 and count(N.elements(a, ":scope", main)) == 1
    assert count(N.elements(a, ":scope > p", main)) == 2 and count(N.elements(a, "body li", ul)) == 4
    assert count(N.elements(a, "li", main.unionByName(ul))) == 4
    t = N.elements(a, "template")
    assert count(N.elements(a, "p", t)) == 0
    inside = N.template_content(a, t)
    assert count(inside) == 1 and count(N.elements(a, ":scope", inside)) == 1
    ctx = main.select("page_id", "id").union(spark.createDataFrame([(1, None)], "page_id long, id int"))
    got = {r["id"]: r["match_id"] for r in N.element(a, "p", ctx).collect()}
    assert got[None] is None and len(got) == 2
    m = {r["id"]: r["matches"] for r in N.matches(a, ":scope.x", ctx).collect()}
    assert m[None] is None and m[main.first()["id"]] is True
    li = N.elements(a, "li")
    assert count(N.where(a, ":nth-child(2)", li)) == 1
    assert {r["match_id"] for r in N.closest(a, "main, ul", li).collect()} == {ul.first()["id"]}
    assert {r["match_id"] == r["id"] for r in N.closest(a, ":scope", li).collect()} == {True}


def test_navigation_and_sets(spark):
    a = N.nodes(parse(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))).cache()
    li, ul = N.elements(a, "li"), N.elements(a, "ul")
    assert N.children(a, ul).count() == 4 and {r["id"] for r in N.parent(li).collect()} == {ul.first()["id"]}
    assert [r["id"] for r in N.sibling(li).orderBy("id").collect()].count(None) == 1
    assert [r["name"] for r in N.ancestors(a, ul).orderBy("id").collect()] == ["html", "body", "main"]
    assert N.outermost(li.unionByName(ul)).count() == 1
    assert N.combine(li, ul).count() == 5 and N.combine(li, li, "intersect").count() == 4 and N.combine(li, li, "difference").count() == 0
    with pytest.raises(ValueError):
        N.combine(li, li, "xor")
    texts = {r["name"]: r["text"] for r in N.text(a, N.elements(a, "h2, template, ul")).collect()}
    assert texts == {"h2": "A", "template": "", "ul": "1234"}
    assert N.describe(ul, 10).first()["described"] == "<ul>"


@pytest.mark.parametrize("css", ["a:hover", "a::before", "ns|a", "a:has(b)", "a:not(b, c)", "a:not(b c)", "li:nth-child(2 of a)", "a /* c */ b", "a:nth-last-child(1)"])
def test_unsupported(css):
    with pytest.raises(SelectorError) as e:
        parse_selector(css)
    assert e.value.unsupported and 1 <= e.value.position <= len(css) and "^" in str(e.value)


@pytest.mark.parametrize(("css", "position"), [("", 1), ("a,", 3), ("a >", 4), ("a..b", 3), ("#", 2), ("[a=]", 4), ("[a", 3), ("é é!", 4), ("a:nth-child(q)", 13)])
def test_malformed(css, position):
    with pytest.raises(SelectorError) as e:
        parse_selector(css)
    assert not e.value.unsupported and e.value.position == position


def test_bounds():
    parse_selector(" ".join(["a"] * 128))
    with pytest.raises(SelectorError):
        parse_selector(" ".join(["a"] * 129))
    with pytest.raises(LimitError):
        parse_selector("a" * 50, 40)
    with pytest.raises(ValueError):
        parse_selector(["a"])


def test_deep_pages_and_long_selectors_in_one_pass():
    """61 compounds over 500 nested elements: each node is tested once for each compound."""
    t = parse_html("<div>" * 500)
    m = Matcher(t)
    assert len(m.select(parse_selector(" ".join(["div"] * 61)))) == 500 - 60
    assert m.tests <= 61 * 502
    wide = Matcher(parse_html("<ul>" + "<li>" * 3000))
    assert len(wide.select(parse_selector("li ~ li + li ~ li"))) == 2997 and wide.tests <= 4 * 3003


def test_the_limit_of_tests(spark):
    from leafloom.limits import Limits
    from leafloom.operators.sets import find
    from leafloom.sources.pages import Pages

    t = parse_html("<p>" * 100, Limits(max_selector_tests=150))
    with pytest.raises(LimitError) as e:
        Matcher(t).select(parse_selector("p p ~ p"))
    assert (e.value.limit, e.value.maximum, e.value.observed) == ("max_selector_tests", 150, 151)
    df = spark.createDataFrame([(1, "<p>" * 100), (2, "<p><p>")], "page_id long, html string")
    assert {r["page_id"] for r in find(Pages(df, limits=Limits(max_selector_tests=150)), "p ~ p").rows("id").collect()} == {2}
    with pytest.raises(Exception, match="max_selector_tests"):
        find(Pages(df, limits=Limits(max_selector_tests=150), mode="FAILFAST"), "p ~ p").rows("id").collect()


def test_a_node_is_the_scope_of_its_own_test(spark):
    a = N.nodes(parse(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))).cache()
    t, some = parse_html(PAGE), a.where("type = 'element'").select("page_id", "id")
    tests = {f"m{n}": css for n, css in enumerate([":scope", "main > :scope", ":scope p", "p:not(:scope)", ":scope ~ p, p:scope", "li:not(:not(:scope))", ":not(:scope) > li", "section, h2 + p:scope"])}
    for r in N.matches_all(a, tests, some).collect():
        for n, css in tests.items():
            assert r[n] == Matcher(t).matches(parse_selector(css), r["id"], r["id"]), css
    plan = N.matches_all(a, tests, some)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1  # no node meets the tested ones of its page
    a.unpersist()
