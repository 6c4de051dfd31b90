"""Tables as relations over nodes: the grid of cells with spans, header rows, names and types of columns. Nothing here runs in Python.

Outermost tables, their sections and rows lie behind each other, so that running maxima over document order tell each cell its own: one scan, and
no join. Where no cell of a group of rows spans rows, columns are running sums; elsewhere a fold over the group's cells carries, for each column,
the last row that holds it, and finds cells that overlap. (The fold copies what it has placed so far, so that it is meant for groups of
thousands of cells, not of millions.) Names are told from a table's cells in one row of arrays, which `Limits.max_table_cells` bounds; names that
occur again get the least numbers that are free. A column's type is all or nothing, told by tests of each value and a window over the
column; the window is by name too, so that a filter on the name goes below it.

`nodes` are rows of nodes with `text` (the cleaned text of cells), as `cell_nodes` parses and stores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.errors import InputError
from leafloom.functions.columns import raw_attr, resolve, trim
from leafloom.kernel.selectors import parse_selector
from leafloom.kernel.tables import MAX_COLSPAN, MAX_ROWSPAN
from leafloom.limits import Limits
from leafloom.operators.nodes import KEY
from leafloom.plans import selectors as S
from leafloom.plans.intervals import nearest
from leafloom.sources.pages import Cleaned, Pages, Wanted
from leafloom.sources.stored import Stored, store_nodes

COLUMNS = ("id", "parent", "subtree_end", "elem_pos", "elem_count", "n_elem_children", "n_text_children", "type", "ns", "name", "attrs", "in_template_of")
SECTIONS = ("thead", "tbody", "tfoot")


def cell_nodes(pages: Pages, trim_text: bool = True) -> Stored:
    """The nodes that tables are made of, with the text of cells (without that of tables in them) and links, parsed and stored."""
    wanted = Wanted(frozenset({"table", *SECTIONS, "tr", "td", "th", "a", "area"}))
    return store_nodes(pages, *COLUMNS, wanted=wanted, texts=Cleaned(names=frozenset({"td", "th"}), trim=trim_text, skip_tables=True))


def _html(nodes: DataFrame, *names: str) -> DataFrame:
    return nodes.where((F.col("type") == "element") & (F.col("ns") == "html") & F.col("name").isin(*names))


def _whole(name: str, most: int) -> Column:
    """The non-negative number at the start of an attribute, cut at `most`; null where there is none."""
    digits = F.regexp_extract(raw_attr(name), r"^[ \t\n\r\f]*\+?0*([0-9]+)", 1)
    return F.when(digits != "", F.when(F.length(digits) > 6, most).otherwise(F.least(digits.cast("int"), F.lit(most))))


def _hit(nodes: DataFrame, css: str, key: str) -> DataFrame:
    """Parts of tables and cells, with a column `hit`: which are tables that match."""
    selector = parse_selector(css)
    parts = ("table", *SECTIONS, "tr", "td", "th")
    if all(len(c.compounds) == 1 for c in selector):  # told by each row alone
        rows, hit = _html(S.prepared(nodes, key, selector), *parts), F.lit(False)
        for c in selector:
            hit = hit | S.compound(c.compounds[0])
    else:
        found = S.select(nodes, css, key).select(F.col(key).alias("h_key"), F.col("id").alias("h_id"))
        rows, hit = _html(nodes, *parts).join(found, (F.col(key) == F.col("h_key")) & (F.col("id") == F.col("h_id")), "left"), F.col("h_id").isNotNull()
    return rows.withColumn("hit", F.coalesce((F.col("name") == "table") & F.col("in_template_of").isNull() & hit, F.lit(False)))


def _groups(nodes: DataFrame, css: str, key: str) -> DataFrame:
    """The groups of rows of outermost tables, as they follow each other: table_no, rank and place (their order), table (its node), section, n_rows and n_head (rows
    of the table and of its head), bad (where cells overlap first) and the cells: row and number (in it) from 1, col from 0, id, subtree_end, rowspan, colspan,
    header, text."""
    so_far = Window.partitionBy(key).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    name, parent, node = F.col("name"), F.col("parent"), F.col("id")
    # of what opens before a node, the outermost one that may be around it ends last (and opens first)
    outermost = lambda which, *more: F.max(F.when(which, F.struct("subtree_end", (-node).alias("neg"), *more))).over(so_far)
    rows = _hit(nodes, css, key).withColumn("t", outermost(F.col("hit"))).where(F.col("t.subtree_end") >= node).withColumn("table", -F.col("t.neg"))
    # a table's own sections lie behind each other, and its own rows are the outermost ones in it
    rows = rows.withColumns({
        "s": F.max(F.when(name.isin(*SECTIONS) & (parent == F.col("table")), F.struct("id", "name"))).over(so_far), "r": outermost(name == "tr", "parent"),
        "table_no": F.count(F.when(F.col("table") == node, True)).over(so_far).cast("int"),
    })
    direct, tr = F.col("r.parent") == F.col("table"), -F.col("r.neg")
    is_cell = name.isin("td", "th") & (parent == tr)
    own = (F.col("r.subtree_end") >= node) & (direct | F.coalesce(F.col("r.parent") == F.col("s.id"), F.lit(False)))
    section = F.when(direct, "tbody").otherwise(F.col("s.name"))
    place = F.when(F.col("s.id") > F.col("table"), F.col("s.id") * 2).otherwise(0) + direct.cast("int")
    down, colspan = F.coalesce(_whole("rowspan", MAX_ROWSPAN), F.lit(1)), F.coalesce(_whole("colspan", MAX_COLSPAN), F.lit(1))
    rows = rows.where(own & (is_cell | (node == tr))).select(
        key, "table_no", "table", section.alias("section"), place.alias("place"), tr.alias("tr"), "id", "subtree_end", is_cell.alias("is_cell"), F.when(is_cell, down).alias("down"), F.when(is_cell, F.when(colspan == 0, 1).otherwise(colspan)).alias("colspan"),
        (name == "th").alias("header"), "text",
    )
    row = Window.partitionBy(key, "tr").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"number": F.count(F.when(F.col("is_cell"), True)).over(row).cast("int") + 1, "col": F.coalesce(F.sum("colspan").over(row), F.lit(0)).cast("int")})
    cell = F.when(F.col("is_cell"), F.struct("number", "col", "id", "subtree_end", "down", "colspan", "header", "text"))
    rows = rows.groupBy(key, "tr").agg(*(F.first(c).alias(c) for c in ("table_no", "table", "section", "place")), F.array_sort(F.collect_list(cell)).alias("cells"))
    rows = rows.withColumn("rank", F.when(F.col("section") == "thead", 1).when(F.col("section") == "tbody", 2).otherwise(3))
    table = Window.partitionBy(key, "table_no").orderBy("rank", "place", "tr")
    whole = table.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"row": F.row_number().over(table), "n_rows": F.count("*").over(whole).cast("int"), "n_head": F.count(F.when(F.col("rank") == 1, True)).over(whole).cast("int")})
    rows = rows.groupBy(key, "table_no", "rank", "place").agg(*(F.first(c).alias(c) for c in ("table", "section", "n_rows", "n_head")), F.max("row").alias("last"), F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"))

    def laid(c: Column, row: Column) -> Column:
        left = F.col("last") - row + 1
        rowspan = F.when(c["down"] == 0, left).otherwise(F.least(c["down"], left))
        return F.struct(row.alias("row"), c["number"].alias("number"), c["col"].alias("col"), *(c[n].alias(n) for n in ("id", "subtree_end")), rowspan.alias("rowspan"), *(c[n].alias(n) for n in ("colspan", "header", "text")))

    groups = rows.withColumn("cells", F.flatten(F.transform("rows", lambda r: F.transform(r["cells"], lambda c: laid(c, r["row"]))))).drop("rows", "last")
    folded = groups.withColumn("f", F.when(F.exists("cells", lambda c: c["rowspan"] > 1), _folded()))
    moved = F.zip_with("cells", "f.cols", lambda c, at: c.withField("col", at))
    return folded.withColumn("bad", F.col("f.bad")).withColumn("cells", F.when(F.col("f").isNotNull(), moved).otherwise(F.col("cells"))).drop("f")


def _folded() -> Column:
    """Of a group's `cells`: their columns from 0, and where cells overlap first."""

    def step(state: Column, c: Column) -> Column:
        row = c["row"]
        held, at = state["held"], F.when(state["row"] == row, state["at"]).otherwise(0)
        free = F.array_position(F.transform(F.slice(held, at + 1, F.size(held)), lambda h: h < row), True).cast("int")
        col = F.when(free > 0, at + free - 1).otherwise(F.greatest(F.size(held), at))
        clash = F.exists(F.slice(held, col + 1, c["colspan"]), lambda h: h >= row)
        after = F.concat(F.slice(held, 1, col), F.array_repeat(row + c["rowspan"] - 1, c["colspan"]), F.slice(held, col + c["colspan"] + 1, F.size(held)))
        bad = F.coalesce(state["bad"], F.when(clash, F.struct(row.alias("row"), c["number"].alias("number"))))
        return F.struct(row.alias("row"), (col + c["colspan"]).alias("at"), after.alias("held"), F.concat(state["cols"], F.array(col)).alias("cols"), bad.alias("bad"))

    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("row"), F.lit(0).alias("at"), none.alias("held"), none.alias("cols"), F.lit(None).cast("struct<row: int, number: int>").alias("bad"))
    return F.aggregate("cells", start, step)


def _overlap(bad: Column) -> Column:
    return F.when(bad.isNotNull(), F.format_string("cells overlap in row %d, at cell %d", bad["row"], bad["number"]))


def placed(nodes: DataFrame, css: str = "table", key: str = KEY) -> DataFrame:
    """Cells in their grids: table_no, table, section, row and col (from 1), number (in its row), id, subtree_end, rowspan, colspan, header, text, n_rows
    and n_head (rows of its head) of the table, and `error` in the cells of a table where some overlap."""
    bad = F.min("bad").over(Window.partitionBy(key, "table_no"))
    out = _groups(nodes, css, key).withColumn("error", _overlap(bad)).select(key, "table_no", "table", "section", "n_rows", "n_head", "error", F.inline("cells"))
    return out.select(key, "table_no", "table", "section", "row", (F.col("col") + 1).alias("col"), "number", "id", "subtree_end", "rowspan", "colspan", "header", "text", "n_rows", "n_head", "error")


def table_cells(nodes: DataFrame, css: str = "table", absolute: bool = False, key: str = KEY) -> DataFrame:
    """A row for each cell of the outermost tables, with spans, section, header, text and links (those of tables in it left out); of a table whose
    cells overlap one row with `error`."""
    cells = placed(nodes, css, key)
    good = cells.where("error IS NULL")
    a = nodes.where((F.col("type") == "element") & F.col("name").isin("a", "area") & raw_attr("href").isNotNull()).select(key, "id", "in_template_of", (resolve(raw_attr("href"), F.col("base")) if absolute else raw_attr("href")).alias("href"))
    a = nearest(_html(nodes, "table").select(key, "id", "subtree_end"), nearest(_html(nodes, "td", "th").select(key, "id", "subtree_end"), a, [key], "cell"), [key], "in_table")
    mine = a.where(F.col("cell").isNotNull() & (F.col("in_template_of").isNull() | (F.col("in_template_of") < F.col("cell"))))
    links = mine.groupBy(F.col(key).alias("a_key"), "cell", "in_table").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "href"))), lambda x: x["href"]).alias("links"))
    out = good.join(links, (F.col(key) == F.col("a_key")) & (F.col("id") == F.col("cell")) & (F.col("table") == F.col("in_table")), "left")
    names = ("row", "column", "rowspan", "colspan", "section", "header", "text", "links", "error")
    told = out.select(key, "table_no", "row", F.col("col").alias("column"), "rowspan", "colspan", "section", "header", "text", F.coalesce("links", F.array().cast("array<string>")).alias("links"), "error")
    failed = cells.where("error IS NOT NULL").groupBy(key, "table_no").agg(F.first("error").alias("error"))
    return told.unionByName(failed.select(key, "table_no", *(F.lit(None).cast(told.schema[n].dataType).alias(n) for n in names[:-1]), "error"))


# -- header rows, names and values ---------------------------------------------------------------------------------------


def tables(nodes: DataFrame, css: str = "table", header="auto", na: tuple[str, ...] = (), limits: Limits | None = None, key: str = KEY) -> DataFrame:
    """Outermost tables in long form: table_no, id, row_no, col_no, name, value, and `error` in the one row of a table whose cells overlap or are too many.

    header: "auto" (rows of the head, else the first rows of header cells alone), True (the first row), False, or row numbers."""
    most = (limits or Limits()).max_table_cells
    cells = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "place", "cells"))), lambda g: g["cells"]))
    whole = _groups(nodes, css, key).sortWithinPartitions(key, "table_no").groupBy(key, "table_no").agg(F.first("table").alias("id"), F.first("n_rows").alias("n_rows"), F.first("n_head").alias("n_head"), F.min("bad").alias("bad"), cells.alias("cells"))
    # step by step: what a later one looks at often is a column of its own
    whole = whole.where(F.size("cells") > 0).withColumn("width", F.array_max(F.transform("cells", lambda c: c["col"] + c["colspan"])))
    size = F.col("width").cast("long") * F.col("n_rows")
    whole = whole.withColumn("error", F.coalesce(_overlap(F.col("bad")), F.when(size > most, F.format_string(f"max_table_cells is {most}, and %d was reached", size))))
    whole = whole.select(key, "table_no", "id", "n_rows", "n_head", "width", "error", F.when(F.col("error").isNull(), _slots(F.col("cells"))).alias("slots"))
    if header == "auto":
        whole = whole.withColumn("heads", F.when(F.col("n_head") > 0, F.col("n_head")).otherwise(_heads(F.col("slots"))))
        is_head, heads_before = (lambda s: s["row"] <= F.col("heads")), lambda s: F.col("heads")
    else:
        numbers = F.array(*map(F.lit, ([1] if header else []) if isinstance(header, bool) else sorted(set(header)))).cast("array<int>")
        is_head, heads_before = (lambda s: F.array_contains(numbers, s["row"])), lambda s: F.size(F.filter(numbers, lambda h: h < s["row"]))
    whole = whole.withColumn("given", _names(F.filter("slots", is_head), F.col("width"))).withColumn("names", unique_names(F.col("given")))
    value = lambda s: F.when(~s["text"].isin(*na), s["text"]) if na else s["text"]
    row = lambda *v: F.struct(*(c.cast(k).alias(n) for c, (n, k) in zip(v, LONG, strict=True)))
    name = lambda s: F.when(s["col"] < F.size("names"), F.get("names", s["col"]))
    every = F.when(F.size("slots") < size, F.concat("slots", _missing(F.col("slots"), F.col("width"), size))).otherwise(F.col("slots"))
    long = F.transform(F.filter(every, lambda s: ~is_head(s)), lambda s: row(s["row"] - heads_before(s), s["col"] + 1, name(s), value(s), F.lit(None)))
    failed = F.array(row(*[F.lit(None)] * 4, F.col("error")))
    return whole.select(key, "table_no", "id", F.inline(F.when(F.col("error").isNull(), long).otherwise(failed)))


#: What a row of a table in long form has, beside the table.
LONG = (("row_no", "int"), ("col_no", "int"), ("name", "string"), ("value", "string"), ("error", "string"))


def _let(value: Column, use) -> Column:
    """use(value), which may look at the value often: it is evaluated once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _slots(cells: Column) -> Column:
    """Cells as they are, those with spans once for each row and column that they stand in."""
    across = lambda c, r: F.transform(F.sequence(c["col"], c["col"] + c["colspan"] - 1), lambda k: c.withField("row", r).withField("col", k))
    spread = F.flatten(F.transform(cells, lambda c: F.flatten(F.transform(F.sequence(c["row"], c["row"] + c["rowspan"] - 1), lambda r: across(c, r)))))
    return F.when(F.exists(cells, lambda c: (c["rowspan"] > 1) | (c["colspan"] > 1)), spread).otherwise(cells)


def _heads(slots: Column) -> Column:
    """How many rows come before the first one that is not of header cells alone; a row without a cell is none of these."""
    rows = F.transform(slots, lambda s: s["row"])
    mixed = F.array_min(F.transform(F.filter(slots, lambda s: ~s["header"]), lambda s: s["row"]))
    end = F.least(mixed, F.array_min(F.array_except(F.sequence(F.lit(1), F.col("n_rows")), rows)))
    return F.coalesce(end - 1, F.array_max(rows))


def _missing(slots: Column, width: Column, size: Column) -> Column:
    """Slots without a cell, told by their numbers row by row."""
    numbers = F.transform(slots, lambda s: (s["row"].cast("long") - 1) * width + s["col"])
    blank = lambda p: F.get(slots, F.lit(0)).withField("text", F.lit(None).cast("string")).withField("row", (F.floor(p / width) + 1).cast("int")).withField("col", (p % width).cast("int"))
    return F.transform(F.array_except(F.sequence(F.lit(0).cast("long"), size - 1), numbers), blank)


def _names(heads: Column, width: Column) -> Column:
    """A name for each column: the texts of its slots in head rows, none twice in a row, else V and its number."""
    pieces = F.filter(F.transform(heads, lambda s: F.struct(s["col"].alias("col"), s["row"].alias("row"), trim(s["text"]).alias("s"))), lambda p: p["s"] != "")

    def named(all_: Column) -> Column:
        kept = F.filter(all_, lambda p, i: (i == 0) | (p["col"] != F.get(all_, i - 1)["col"]) | (p["s"] != F.get(all_, i - 1)["s"]))
        return _let(kept, lambda k: _let(F.filter(F.transform(k, lambda p, i: i), lambda i: (i == 0) | (F.get(k, i)["col"] != F.get(k, i - 1)["col"])), lambda first: columns(k, first)))

    def columns(k: Column, first: Column) -> Column:
        """first: where the pieces of each column begin in `k`."""
        of = lambda i, j: F.transform(F.slice(k, i + 1, F.coalesce(F.get(first, j + 1), F.size(k)) - i), lambda p: p["s"])
        by_col = F.map_from_entries(F.transform(first, lambda i, j: F.struct(F.get(k, i)["col"] + 1, F.array_join(of(i, j), " / "))))
        return _let(by_col, lambda m: F.transform(F.sequence(F.lit(1), width), lambda c: F.coalesce(F.element_at(m, c), F.concat(F.lit("V"), c.cast("string")))))

    return _let(F.array_sort(pieces), named)


def unique_names(names: Column) -> Column:
    """An array of names in which each that occurs again has .1, .2, ... behind: the numbers that no given name uses, in order."""

    def one(n: Column, i: Column) -> Column:
        numbered = lambda k: F.concat(n, F.lit("."), k.cast("string"))
        again = F.size(F.filter(F.slice(names, 1, i), lambda m: m == n))  # how often it was before
        taken = F.filter(names, lambda m: m.startswith(F.concat(n, F.lit("."))))
        free = F.filter(F.sequence(F.lit(1), again + F.size(taken)), lambda k: ~F.array_contains(taken, numbered(k)))
        return F.when(again == 0, n).otherwise(numbered(F.element_at(free, again)))

    return F.transform(names, one)


# -- types ---------------------------------------------------------------------------------------------------------------

# What stands for true and false.
TRUE, FALSE = ("TRUE", "True", "true", "T"), ("FALSE", "False", "false", "F")


def converted(long: DataFrame, decimal: str = ".", thousands: str | None = None, key: str = KEY) -> DataFrame:
    """`tables` with col_type ("logical", "integer", "double" or "character", for a column as a whole), number, exact (a decimal, where it has at most 38
    digits, 10 of them behind the point) and flag.

    Numbers that would not come back as they are written, such as 007 or ones of over 15 significant digits, keep a column as text."""
    for mark, name in ((decimal, "decimal"), (thousands, "thousands")):
        if mark is not None and (not isinstance(mark, str) or len(mark) != 1 or mark in "+-eE0123456789"):
            raise InputError(f"{name} must be one character that is no part of a number", name)
    if decimal == thousands:
        raise InputError("decimal and thousands must differ", "thousands")
    quoted = lambda c: "\\" + c if not c.isalnum() and c != " " else c
    d, v = quoted(decimal), trim(F.col("value"))
    fits = F.lit(True)
    if thousands:
        mark = " " if thousands == "\xa0" else thousands  # cleaned text has plain spaces
        grouped = v.rlike(rf"^[+-]?[0-9]{{1,3}}(?:{quoted(mark)}[0-9]{{3}})+(?:{d}[0-9]*)?$")
        fits = ~v.contains(mark) | grouped
        v = F.replace(v, F.lit(mark), F.lit(""))
    plain = F.when(fits & v.rlike(rf"^[+-]?(?:[0-9]+(?:{d}[0-9]*)?|{d}[0-9]+)(?:[eE][+-]?[0-9]+)?$"), F.replace(v, F.lit(decimal), F.lit(".")))
    rows = long.withColumn("_v", plain).withColumn("_x", F.expr("try_cast(_v AS double)"))
    # most numbers are short and plain: all that is asked of others below holds for them
    short = (F.length("_v") <= 16) & F.col("_v").rlike(r"^[+-]?(?:0|[1-9][0-9]{0,13})(?:\.[0-9]*)?$")
    digits = F.regexp_replace(F.regexp_replace("_v", r"^[+-]", ""), "[eE].*$", "")
    significant = F.length(F.regexp_replace(F.replace(digits, F.lit("."), F.lit("")), "^0+|0+$", ""))
    small = (significant > 0) & (F.abs("_x") < 2.2250738585072014e-308)
    number = F.when(short, True).otherwise(F.col("_x").isNotNull() & ~digits.rlike("^0[0-9]") & (significant <= 15) & (F.abs("_x") < float("inf")) & ~small)
    number = F.coalesce(number, F.lit(False))
    column = Window.partitionBy(key, "table_no", "col_no", "name")
    there = F.col("value").isNotNull()
    all_are = lambda c: F.coalesce(F.min(F.when(there, c.cast("int"))).over(column), F.lit(0)) == 1
    rows = rows.withColumn("_n", number)
    rows = rows.withColumn("_i", F.col("_n") & F.coalesce(F.abs("_x") < 2.0**31, F.lit(False)) & F.col("_v").rlike("^[+-]?[0-9]+$"))
    kind = F.when(all_are(F.col("value").isin(*TRUE, *FALSE)), "logical").when(all_are(F.col("_n")), F.when(all_are(F.col("_i")), "integer").otherwise("double")).otherwise("character")
    rows = rows.withColumn("col_type", F.when(F.col("row_no").isNotNull(), kind))
    numeric = F.col("col_type").isin("integer", "double")
    return rows.select(*long.columns, "col_type", F.when(numeric, F.col("_x")).alias("number"), F.when(numeric, F.expr("try_cast(_v AS decimal(38, 10))")).alias("exact"), F.when(F.col("col_type") == "logical", F.col("value").isin(*TRUE)).alias("flag"))
