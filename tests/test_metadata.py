"""Titles, meta elements, scripts and microdata as native plans, against the walk over each page's tree."""

import random

import pytest

from leafloom.kernel import structure
from leafloom.kernel.flat import parse_html
from leafloom.operators import metadata as M
from leafloom.sources.pages import Pages

PAGES = [
    "<svg><title>no</title></svg><title> a \n b</title><title>2</title><meta name=n content=c><META property=p http-equiv=h><script type='application/ld+json'><!-- {\"a\": 1} --></script><script type='Application/LD+JSON; x'>[</script><script>x</script>",
    "<template><title>t</title><meta name=m></template><p>x", "", "<svg><meta name=inner></svg><title></title><script type=application/ld+json>/*<![CDATA[*/ {} /*]]>*/</script>",
    """<div itemscope itemtype="T U T" itemref="r gone r"><b itemprop="n m n"> x
 </b><p itemprop=c itemscope><a itemprop=u href=v>w</a><time itemprop=t datetime=d>e</time></p></div>
<i id=r itemprop=n>y</i><div itemscope id=k><p itemprop=self itemscope itemref=k></p></div>""",
    "<div itemscope><p itemprop=a itemscope id=k itemref=j></p></div><p id=j itemprop=b itemscope itemref=k></p>",
    "<p itemscope itemid=i><a itemprop=u href=r>x</a></p><p itemscope itemtype='T' itemid=i><img itemprop=v src=s><meta itemprop=w content=q><data itemprop=x value=1>2</data><time itemprop=y>now</time></p>",
    "<section id=s><div itemscope itemref=s itemtype=A><span itemprop=in>1</span></div><div itemprop=far itemscope itemref=s><b itemprop=deep>2</b></div><template><u itemprop=hid>3</u></template></section><div itemscope></div><div itemscope itemprop=''><i itemprop=z>4</i></div>",
]


def random_page(seed):
    r = random.Random(seed)
    tags = ["<div itemscope id=a%d>", "<div itemscope itemref='a1 a2 a%d'>", "<p itemprop=p%d itemscope itemref=a3>", "<b itemprop='q%d q1'>t", "<a itemprop=l href=h%d>", "<span id=a%d>", "</div>", "</div>", "</p>", "</b>", "</span>", "<template>", "</template>", "</template>", "x<br>"]
    return "".join(t % r.randrange(4) if "%d" in (t := r.choice(tags)) else t for _ in range(30))


@pytest.fixture(scope="module")
def pages():
    return PAGES + [random_page(i) for i in range(12)]


@pytest.fixture(scope="module")
def source(spark, pages):
    return Pages(spark.createDataFrame([(k, h, "https://h/x/") for k, h in enumerate(pages)], "page_id long, html string, url string"), base_url="url")


def test_what_one_look_finds(pages, source):
    docs = source.parsed().cache()
    trees = {k: parse_html(h, base_url="https://h/x/") for k, h in enumerate(pages)}
    assert {r["page_id"]: r["title"] for r in M.title(docs).collect()} == {k: structure.title(t) for k, t in trees.items()}
    want = sorted((k, i, *(t.attr(i, n) for n in ("name", "property", "http-equiv", "charset", "content"))) for k, t in trees.items() for i in t.visible(0) if t.type[i] == "element" and t.name[i] == "meta")
    assert sorted(map(tuple, M.meta(docs).collect()), key=lambda r: r[:2]) == want and len(want) == 4
    got = sorted((r["page_id"], r["n"], r["text"], r["json"] is not None) for r in M.json_ld(docs).collect())
    assert got == sorted((k, n, s, structure.parsed_json(s) is not None) for k, t in trees.items() for n, s in enumerate(structure.json_ld(t, [0]), 1)) and len(got) == 3
    plan = M.page_metadata(source.parsed())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    docs.unpersist()


def test_items_by_frontiers(pages, source):
    names = ("item", "type", "id", "property", "ord", "value", "child")
    got = [(r["page_id"], *(tuple(r[n]) if n == "type" else r[n] for n in names)) for r in M.microdata(M.item_nodes(source).df).collect()]
    want = [(k, *(tuple(r[n]) if n == "type" else r[n] for n in names)) for k, h in enumerate(pages) for r in structure.microdata(parse_html(h, base_url="https://h/x/"), [0])]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 60
    assert any(r[7] is None and r[6] is None and r[4] == "a" for r in want)  # a circle ends in null
