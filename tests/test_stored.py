"""Nodes stored by page: what plans over them exchange and scan, and that they say the same."""

import pytest

from leafloom.kernel.flat import parse_html
from leafloom.kernel.selectors import Matcher, parse_selector
from leafloom.operators import nodes as N
from leafloom.plans import selectors as S
from leafloom.sources.pages import Cleaned, Pages, Wanted
from leafloom.sources.stored import open_stored, store, store_nodes

PAGES = ["<article><p>a<ul><li>b<li>c</ul><ul></ul></article><ul></ul>", "<div><article><section><p>x</p><i></i><ul class=k><li><p>y<ul></ul></ul></section></article></div>", "", "<p>z<ul>"]


@pytest.fixture(scope="module")
def kept(spark):
    k = store_nodes(Pages(spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")))
    yield k
    k.drop()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ids(df):
    return sorted((r["page_id"], r["id"]) for r in df.collect())


def test_a_chain_exchanges_nothing(kept):
    plan = plan_of(kept.elements("article p ~ ul").select("page_id", "id"))
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1 and "Bucketed: true" in plan
    assert "attrs" not in plan.split("ReadSchema")[1] and "value" not in plan.split("ReadSchema")[1]  # only the columns that are looked at
    want = [(k, i) for k, h in enumerate(PAGES) for i in Matcher(parse_html(h)).select(parse_selector("article p ~ ul"))]
    assert ids(kept.elements("article p ~ ul")) == want and len(want) == 4


def test_fifty_selectors_take_one_scan(kept):
    names = ["article", "p", "ul", "li", "section", ".k"]
    css = {f"s{n}": f"{a} {'> + ~'.split()[n % 3] if n % 4 else ''} {b}" for n, (a, b) in enumerate((a, b) for a in names for b in names)}
    css |= {f"t{n}": f"{a} {b} ~ {a}, {b}:first-child" for n, (a, b) in enumerate(zip(names, names[1:] + names[:1], strict=True))} | {f"u{n}": f"div article {a} > {names[n - 1]}" for n, a in enumerate(names)} | {"v0": "*", "v1": ":root > body"}
    assert len(css) == 50
    found = kept.select_many(css)
    plan = plan_of(found.select("page_id", "id", *css))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan and len([line for line in plan.split("\n") if "Window [" in line]) <= 4 + 1
    got = {n: [] for n in css}
    for r in found.collect():
        for n in css:
            if r[n]:
                got[n].append((r["page_id"], r["id"]))
    for n, c in css.items():
        assert sorted(got[n]) == [(k, i) for k, h in enumerate(PAGES) for i in Matcher(parse_html(h)).select(parse_selector(c))], c


def test_tables_by_name_and_rows_of_pages_with_errors(spark, kept, tmp_path):
    assert open_stored(spark, kept.table, kept.path).df.count() == kept.df.count() == sum(len(parse_html(h).type) for h in PAGES)
    bad = spark.createDataFrame([(1, b"<p>\xff"), (2, b"<p>ok")], "page_id long, html binary")
    assert {r["page_id"] for r in Pages(bad).node_rows("id").collect()} == {2}
    named = store(spark.range(9).selectExpr("id AS page_id", "id * 2 AS v"), table="leafloom_test_rows", path=str(tmp_path / "rows"), buckets=3)
    assert "Exchange" not in plan_of(named.df.groupBy("page_id").count()) and named.df.count() == 9
    named.drop()
    assert not (tmp_path / "rows").exists()


def test_only_wanted_nodes_leave_the_parser(spark):
    html = "<p id=a>x<b>y</b></p><div title=t>z</div><textarea>q</textarea><template><p>w</template>"
    pages = Pages(spark.createDataFrame([(1, html)], "page_id long, html string"))
    rows = pages.node_rows("id", "name", "value", "in_template_of", wanted=Wanted(frozenset({"p"}), frozenset({"title"}), frozenset({"textarea"})), texts=Cleaned(names=frozenset({"p"}), attrs=frozenset({"title"}))).orderBy("id").collect()
    assert [(r["name"], r["value"], r["text"]) for r in rows] == [("p", None, "xy"), ("div", None, "z"), (None, "q", None), ("p", None, "w")] and rows[3]["in_template_of"] is not None
    with pytest.raises(ValueError):
        pages.node_rows("no_such_column")


def test_searches_agree_whether_stored_or_not(spark, kept):
    held = N.nodes(Pages(spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")).parsed()).cache()
    for css in ("article p", "article > *", "p ~ ul, li + li", "section li p ul"):
        assert ids(S.select(held, css)) == ids(kept.elements(css))
    held.unpersist()


def test_no_side_of_a_join_is_broadcast_unasked(kept):
    p = N.elements(kept.df, "p", stored=True)
    found = N.fetch(kept.df, N.parent(p)).join(N.fetch(kept.df, N.sibling(p)).select("page_id", "id"), "page_id")
    found.collect()
    assert "SortMergeJoin" in plan_of(found) and "Broadcast" not in plan_of(found)


def test_rows_of_pages_that_share_a_shape(spark):
    html = [f"<base href=b{k % 2}/><p id=p{k} class='a {k}'>x{k}<!--c--><b title=t{k}>y</b><template><i lang=l{k}>z</i></template>" if k % 5 else f"<ul><li>{k}&amp;" for k in range(60)] + ["", "<p>"]
    pages = Pages(spark.createDataFrame([(k, h, f"https://h/{k}/") for k, h in enumerate(html)], "page_id long, html string, url string").coalesce(1), base_url="url")
    plain = N.nodes(pages.parsed())
    got = pages.node_rows().select(*plain.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() > 500
    some = pages.node_rows("id", "attrs", wanted=Wanted(frozenset({"b"}), frozenset({"lang"})), texts=Cleaned(names=frozenset({"b"})))
    want = [(k, v, t) for k in range(60) if k % 5 for v, t in ((f"t{k}", "y"), (f"l{k}", None))]
    assert [(r["page_id"], r["attrs"][0]["value"], r["text"]) for r in some.orderBy("page_id", "id").collect()] == want


def test_pages_that_lie_by_their_key_are_stored_as_they_lie(spark):
    docs = spark.range(50).selectExpr("id AS page_id", "'<p>x' AS html").repartition(3, "page_id")
    kept = store_nodes(Pages(docs, dealt=3), "id", "name")
    assert kept.df.count() == 50 * 6 and len(kept.df.inputFiles()) == 3 and "Exchange" not in plan_of(kept.df.groupBy("page_id").count())
    kept.drop()
