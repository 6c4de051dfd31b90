"""Grids, names and types as relations, against the walk over each table."""

import random

import pytest
from pyspark.sql import functions as F

from leafloom.errors import InputError
from leafloom.kernel.tables import cells, convert, outermost, table, unique
from leafloom.kernel.flat import parse_html
from leafloom.operators import grids as G
from leafloom.sources.pages import Pages

TABLES = [
    "<table><thead><tr><th>a<th colspan=2>b<tr><th>a<th>c<th></thead><tr><td>1<td rowspan=2>2<td>3<tr><td>4<td>5</table>",
    "<table><tr><td>x<tr><td>y<td>z</table><p><table><tr><th>h<tr><th>i</table>", "<table><tfoot><tr><td>f</tfoot><tr><td rowspan=0>a<td colspan=x>b<tr><td>c<tr></table>",
    "<table><tr><td>k<td>l<td rowspan=3>m<tr><td>n<tr><td>o<td colspan=4>p</table>", "<table><tr><th><a href=u>x</a><td rowspan=2 colspan=3><a href=v>y</a><table><tr><td><a href=w>z</a></table></table>",
    "<table><thead><tr></thead><tr><td>only</table>", "<table><tr><th>n<th>n<th>n.1<th>n<tr><th rowspan=2>r<th>s<th>t<th>u<tr><th>q<td>1<td>2</table>", "<table><tr></table>", "",
    "<table><tr><td rowspan=99999999999>1<td colspan='+02'>2<td colspan=0>3<tr><td>4<td rowspan=2>5<tr><td colspan=2>6<td>7<td>8</table>",
]


def random_table(seed):
    r = random.Random(seed)
    cell = lambda: f"<{r.choice(['td', 'td', 'th'])} rowspan={r.choice([1, 1, 1, 2, 3, 0])} colspan={r.choice([1, 1, 2])}>{r.choice('abc')}"
    return "<table>" + "".join(r.choice(["<tr>", "<tr>", "<tr>", "<tbody>", "<thead><tr>", "<tfoot>"]) + "".join(cell() for _ in range(r.randrange(4))) for _ in range(6)) + "</table>"


@pytest.fixture(scope="module")
def pages():
    return TABLES + [random_table(i) for i in range(30)]


@pytest.fixture(scope="module")
def kept(spark, pages):
    return G.cell_nodes(Pages(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")))


def of(html):
    t = parse_html(html)
    return [(t, i) for i in outermost(t, [i for i in range(len(t.type)) if t.is_html(i, "table")])]


def test_cells_as_by_walking(pages, kept):
    names = ("row", "column", "rowspan", "colspan", "section", "header", "text")
    want, broken = [], 0
    for k, html in enumerate(pages):
        for no, (t, i) in enumerate(of(html), 1):
            try:
                want += [(k, no, *(c[n] for n in names), tuple(c["links"]), None) for c in cells(t, i)]
            except ValueError as e:
                want.append((k, no, *[None] * 8, str(e)))
                broken += 1
    got = [(r["page_id"], r["table_no"], *(r[n] for n in names), None if r["links"] is None else tuple(r["links"]), r["error"]) for r in G.table_cells(kept.df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and broken >= 2


@pytest.mark.parametrize("header", ["auto", True, False, (2,)])
def test_tables_as_by_walking(pages, kept, header):
    want = []
    for k, html in enumerate(pages):
        for no, (t, i) in enumerate(of(html), 1):
            try:
                names, body = table(t, i, header)
            except ValueError as e:
                want.append((k, no, None, None, None, None, str(e)))
                continue
            want += [(k, no, r, c, names[c - 1], v, None) for r, row in enumerate(body, 1) for c, v in enumerate(row, 1)]
    got = [(r["page_id"], r["table_no"], r["row_no"], r["col_no"], r["name"], r["value"], r["error"]) for r in G.tables(kept.df, header=header).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_limit_of_cells(kept):
    from leafloom.limits import Limits

    errors = {r["page_id"]: r["error"] for r in G.tables(kept.df.where("page_id IN (0, 1)"), limits=Limits(max_table_cells=5)).where("error IS NOT NULL").collect()}
    assert errors == {0: "max_table_cells is 5, and 12 was reached"}


def test_unique_names(spark):
    r = random.Random(2)
    some = [[r.choice(["a", "a.1", "a.2", "b", ""]) for _ in range(r.randrange(8))] for _ in range(60)]
    got = spark.createDataFrame([(s,) for s in some], "n array<string>").select("n", G.unique_names(F.col("n")).alias("u")).collect()
    assert all(x["u"] == unique(x["n"]) for x in got) and len(got) == 60


def test_types_as_by_walking(spark):
    r = random.Random(3)
    pool = ["1", "+6", "-0", "2.75", ".5", "6e2", "042", "n/a", "T", "False", None, " 7 ", "1,234", "1,23", "9,999.5", "5000000000", "2147483648", "-2147483647", "8765432109876543", "4e400", "4e-400", "0e-400", "1.", "0.1234567890123456", "100000000000000000000", "", "-.0"]
    columns = [[r.choice(pool[:7]) for _ in range(3)] for _ in range(40)] + [[x] for x in pool] + [[r.choice(pool) for _ in range(2)] for _ in range(120)] + [["T", None], [None, None]]
    rows = [(c, 1, 1, n + 1, 1, "x", v) for c, column in enumerate(columns) for n, v in enumerate(column)]
    long = spark.createDataFrame(rows, "page_id long, table_no int, id int, row_no int, col_no int, name string, value string")
    for decimal, thousands in ((".", None), (".", ","), (",", ".")):
        got = {}
        for x in G.converted(long, decimal, thousands).collect():
            got.setdefault(x["page_id"], []).append((x["row_no"], x["col_type"], x["number"], x["flag"]))
        for c, column in enumerate(columns):
            kind, values = convert(column, decimal, thousands)
            want = [(n + 1, kind, None if v is None or kind not in ("integer", "double") else float(v), v if kind == "logical" else None) for n, v in enumerate(values)]
            assert sorted(got[c], key=lambda t: t[0]) == want, (column, decimal, thousands)
    with pytest.raises(InputError):
        G.converted(long, ".", ".")


def test_a_filter_on_the_name_goes_below_typing(kept):
    kept.df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = G.converted(G.tables(kept.df)).where("name = 'a'")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    kept.df.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    typing, name = (next(i for i, line in enumerate(plan) if what in line) for what in ("min(", "= a)"))
    assert name > typing


def test_named_columns_alone_leave_the_parser(spark, pages):
    from leafloom.operators import extract as E

    source = Pages(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))
    every = E.tables(source, convert_types=True)
    some = E.tables(source, convert_types=True, columns=("a", "n.1"))
    assert sorted(map(str, some.collect())) == sorted(map(str, every.where("name IN ('a', 'n.1') OR error IS NOT NULL").collect()))


def test_a_grid_takes_one_scan_and_no_join(kept):
    for css in ("table", "table:first-child"):
        plan = G.tables(kept.df, css)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan


def test_tables_by_selectors_with_combinators(pages, kept):
    found = sorted({(r["page_id"], r["table_no"]) for r in G.tables(kept.df, "td > table").collect()})
    assert found == [(k, 1) for k, html in enumerate(pages) if "<td><table" in html or "</a><table" in html]
