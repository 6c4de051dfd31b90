"""Forms by joins, against the walk over each page's tree."""

import random

import pytest

from leafloom.kernel import structure
from leafloom.kernel.flat import parse_html
from leafloom.operators.forms import form_fields, form_nodes, forms
from leafloom.operators.nodes import nodes
from leafloom.sources.pages import Pages

PAGES = [
    "<form id=f action=go method=POST><input name=a value=1><input type=CHECKBOX name=c><input type=radio name=r checked><input type=odd name=q><textarea name=t>\nx<b></textarea><button name=b>B</button><button type=Reset name=b2 value=v>B</button>"
    "<select name=s><option>1<option value=v selected> 2 3</select><select name=m multiple><option selected>p<option selected>q</select><fieldset disabled><legend><input name=l></legend><input name=d><legend><input name=l2></legend></fieldset>"
    "<input name=o form=''></form><input name=late form=f><input name=none><p id=f></p>",
    "<table><form id=a><tr><td><input name=x><table><tr><td><input name=deep></table><input name=x2></form></table><input name=y>",
    "<table><tr><form action=1><td><input name=p></tr></table><table><tr><td><input name=q></table><table><form><tr><td><input name=r></table>",
    "<form><select name=a><option disabled>1<option>2</select><select name=b size=3><option>1</select><select name=c size=-1><optgroup disabled><option>u</optgroup><option label=''>v w<option selected>x<option selected disabled>y</select>"
    "<select name=d size='+1'><option label=l><b>t</b>u</select><select name=e><option disabled>1</select><select name=g></select></form>",
    "<form id=one></form><div id=two></div><form id=two></form><input form=one name=i><input form=two name=j><template><form id=three><input></form><p id=one></template><input form=three name=k>",
    "<fieldset disabled><fieldset><legend><form><input name=a></legend><input name=b></fieldset></fieldset><form><fieldset disabled><p><legend><input name=c></legend></p><input name=d></fieldset><button name=e type=image></form>",
    "", "<form></form><svg><form><input name=s></form><fieldset disabled><input></fieldset></svg>",
]


def random_page(seed):
    r = random.Random(seed)
    tags = ["<form id=f%d>", "<form id=f%d>", "<form id=f%d>", "</form>", "<table>", "<tr><td>", "</table>", "<fieldset%s>", "</fieldset>", "<legend>", "</legend>", "<input name=n%d>", "<input name=n%d form=f1 disabled>", "<select name=n%d><option>a<option selected>b<optgroup disabled><option>c</select>", "<textarea name=n%d>x</textarea>", "<div>", "</div>", "<template>", "</template>", "</template>", "<p>t"]
    out = []
    for i in range(60):
        t = r.choice(tags)
        out.append(t % i if "%d" in t else t % r.choice(["", " disabled"]) if "%s" in t else t)
    return "".join(out).replace("id=f5", "id=f1")


def plain(x):
    """Rows and dicts as nested tuples."""
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def pages():
    return PAGES + [random_page(i) for i in range(25)]


def test_all_forms_as_by_walking(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("*", "'https://h/x/' AS url")
    source = Pages(df, base_url="url")
    kept = form_nodes(source)
    want = sorted(((k, plain(f)) for k, html in enumerate(pages) for f in structure.forms(parse_html(html, base_url="https://h/x/"), [0])), key=str)
    assert sum(len(dict(f)["fields"]) for _, f in want) > 80
    for rows in (kept.df, nodes(source.parsed()).cache()):
        got = forms(rows)
        assert sorted(((r["page_id"], plain({c: r[c] for c in got.columns if c != "page_id"})) for r in got.collect()), key=str) == want
    one = [(r["form"], r["field"], r["name"]) for r in form_fields(kept.df).where("page_id = 0").collect()]
    assert sorted(one)[0] == (1, 1, "a") and [n for _, _, n in sorted(one)][-1] == "late"
    kept.drop()
    assert not spark.catalog.tableExists(kept.table)


def test_one_parse_and_no_exchange_once_stored(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    kept = form_nodes(Pages(df))
    kept.df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = form_fields(kept.df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "InArrow" not in plan and "Bucketed: true" in plan
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"  # only the table's session is another
    kept.drop()


NESTED = [
    "<form><select name=a><option>1<object><select name=b><optgroup disabled><option>2<object><select name=c><option selected>3</select></object><option>4</select></object><option disabled>5</select></form>",
    "<form id=a><div></form><form id=b><table><tr><td><form id=c></form><input name=x></td></tr></table><input name=y></div></form><input name=z form=b>",
    "<table><form id=a><tr><td><table><form id=b><tr><td><input name=i></table><input name=j><tr><td><table></table><input name=k></table><input name=l>",
    "<form><select name=s><optgroup disabled><div><optgroup><option>1</optgroup></div><option>2</select><fieldset disabled><legend><fieldset disabled><legend></legend><input name=p></fieldset><input name=q></legend></fieldset></form>",
]


def test_what_nests_is_told_as_by_walking(spark):
    kept = form_nodes(Pages(spark.createDataFrame(list(enumerate(NESTED)), "page_id long, html string")))
    want = sorted(((k, plain(f)) for k, html in enumerate(NESTED) for f in structure.forms(parse_html(html), [0])), key=str)
    got = forms(kept.df)
    assert sorted(((r["page_id"], plain({c: r[c] for c in got.columns if c != "page_id"})) for r in got.collect()), key=str) == want
    kept.drop()


def test_fields_take_few_scans_and_joins(spark, pages):
    kept = form_nodes(Pages(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")))
    plan = form_fields(kept.df)._jdf.queryExecution().executedPlan().toString()
    counts = [plan.count(x) for x in ("FileScan", "SortMergeJoin", "Generate explode")]
    assert counts[0] <= 8 and counts[1] <= 5 and counts[2] <= 4, counts
    kept.drop()
