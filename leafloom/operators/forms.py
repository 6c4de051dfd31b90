"""Forms and their fields as windows and joins over nodes; nothing here walks a page.

Sums over document order tell each control what is around it (its form, table, disabled fieldsets) and each option its selects and group. A
reference by form= is an equality with the first element of that id. A form that the parser had to leave empty in a table owns what follows in
that table up to the next form: the last form before a control, by a running maximum. A fieldset's first legend takes its controls out
again: they are disabled where more disabled fieldsets than such legends are around them. Of several selected options of a single
select the last stays.

`nodes` are rows of nodes (`Pages.node_rows`, `nodes.nodes` or a stored table) and are read several times: parse them once, into `form_nodes`
or another stored table, in which every join here stays within its bucket. Where they have `text` (of options and textareas, as `form_nodes`
has), rows of text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions.columns import fold, raw_attr, resolve, squeeze
from leafloom.kernel.selectors import parse_selector
from leafloom.kernel.structure import INPUTS
from leafloom.operators.nodes import KEY
from leafloom.plans import selectors as S
from leafloom.plans.intervals import around, innermost, pairs
from leafloom.sources.pages import Below, Pages, Wanted
from leafloom.sources.stored import Stored, store_nodes

CONTROLS = ("input", "select", "textarea", "button")
TABLE_PARTS = ("table", "tbody", "thead", "tfoot", "tr")
COLUMNS = ("id", "parent", "subtree_end", "type", "ns", "name", "attrs", "in_template_of")
WANTED = Wanted(frozenset({*CONTROLS, *TABLE_PARTS, "form", "fieldset", "legend", "option", "optgroup"}), frozenset({"id"}))
TEXTS = Below(frozenset({"textarea", "option"}))


def form_nodes(pages: Pages) -> Stored:
    """The nodes that forms are made of, with the text of options and textareas, parsed and stored."""
    return store_nodes(pages, *COLUMNS, wanted=WANTED, texts=TEXTS)


def _elements(nodes: DataFrame, *names: str) -> DataFrame:
    return nodes.where((F.col("type") == "element") & (F.col("ns") == "html") & F.col("in_template_of").isNull() & F.col("name").isin(*names))


def _has(name: str) -> Column:
    return raw_attr(name).isNotNull()


def _around(nodes: DataFrame, key: str) -> DataFrame:
    """Controls and forms, with what is around each: form, table (the innermost ones) and off (whether a fieldset disables it)."""
    name = F.col("name")
    # of legends only the first of a disabled fieldset; siblings are told apart by their ids
    marked = _elements(nodes, "fieldset", "legend").withColumn("elem_pos", F.col("id")).withColumn("root_id", F.lit(None).cast("int"))
    exempt = S.flagged(marked, {"exempt": parse_selector("fieldset[disabled] > legend:nth-of-type(1)")}, [key]).select(*nodes.columns)
    rows = _elements(nodes, *CONTROLS, "form", "table", "fieldset").where((name != "fieldset") | _has("disabled")).unionByName(exempt)
    is_ = lambda n: (name == n).cast("int")
    rows = around(rows, {"forms": is_("form"), "tables": is_("table"), "off": is_("fieldset") - is_("legend")}, [key]).where(name.isin(*CONTROLS, "form", "table"))
    rows = innermost(rows, name == "form", "forms", F.col("id"), [key], "form")
    return innermost(rows, name == "table", "tables", F.col("id"), [key], "table").where(name != "table").withColumn("off", F.col("off") > 0).drop("forms", "tables")


def _texts(nodes: DataFrame, key: str, name: str) -> DataFrame:
    """The text of each element of that name that has any."""
    outer = _elements(nodes, name).select(key, "id", "subtree_end")
    inner = nodes.where((F.col("type") == "text") & F.col("in_template_of").isNull()).select(key, "id", "value")
    pieces = F.array_sort(F.collect_list(F.struct("id", "value")))
    return pairs(outer, inner, [key]).groupBy(F.col(key).alias("t_key"), F.col("o_id").alias("t_id")).agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "").alias("text"))


def _with_text(rows: DataFrame, nodes: DataFrame, key: str, name: str) -> DataFrame:
    """Aligned: `rows` with the text of each element of that name."""
    return rows if "text" in rows.columns else rows.join(_texts(nodes, key, name), _on(key, "t_key", "t_id"), "left").drop("t_key", "t_id")


def _on(key: str, k: str, i: str, node: str = "id") -> Column:
    return (F.col(key) == F.col(k)) & (F.col(node) == F.col(i))


def owners(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """Aligned with the controls and forms of all pages: their columns, owner (the control's form) and off (whether a fieldset disables it)."""
    rows = _around(nodes, key)
    parts = _elements(nodes, *TABLE_PARTS).select(F.col(key).alias("p_key"), F.col("id").alias("p_id"))
    empty = _elements(nodes, "form").where(F.col("subtree_end") == F.col("id")).select(F.col(key).alias("e_key"), F.col("id").alias("e_id"), "parent")
    empty = empty.join(parts, (F.col("e_key") == F.col("p_key")) & (F.col("parent") == F.col("p_id"))).select("e_key", "e_id")
    refs = _elements(nodes, *CONTROLS).where(_has("form")).select(F.col(key).alias("r_key"), F.col("id").alias("r_id"), raw_attr("form").alias("ref"))
    by_id = nodes.where((F.col("type") == "element") & F.col("in_template_of").isNull() & (raw_attr("id") != "")).groupBy(F.col(key).alias("i_key"), raw_attr("id").alias("i_name")).agg(F.min(F.struct("id", ((F.col("ns") == "html") & (F.col("name") == "form")).alias("is_form"))).alias("first"))
    refs = refs.join(by_id, (F.col("r_key") == F.col("i_key")) & (F.col("ref") == F.col("i_name"))).where("first.is_form").select("r_key", "r_id", F.col("first.id").alias("named"))
    rows = rows.join(empty, _on(key, "e_key", "e_id"), "left").join(refs, _on(key, "r_key", "r_id"), "left")
    before = Window.partitionBy(key).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last", F.max(F.when(F.col("name") == "form", F.struct("id", "table", F.col("e_id").isNotNull().alias("left_empty")))).over(before))
    by_table = F.when(F.col("last.left_empty") & (F.col("last.table") == F.col("table")), F.col("last.id"))
    owner = F.when(_has("form"), F.col("named")).when(F.col("form").isNotNull(), F.col("form")).otherwise(by_table)
    return rows.withColumn("owner", F.when(F.col("name") != "form", owner)).drop("last", "e_key", "e_id", "r_key", "r_id", "named", "form", "table")


def options(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """key, select (its id), and the options of each select with any: an array of (value, label, selected, disabled), in order."""
    size = raw_attr("size")
    sign, digits = F.regexp_extract("size", r"^[ \t\n\r\f]*([-+]?)([0-9]+)", 1), F.regexp_extract("size", r"^[ \t\n\r\f]*([-+]?)([0-9]+)", 2)
    told = (digits != "") & ~((sign == "-") & digits.rlike("[1-9]"))
    one_shows = F.when(F.coalesce(told, F.lit(False)), digits.rlike("^0*1$")).otherwise(~F.col("multiple"))
    is_ = lambda *n: F.col("name").isin(*n)
    rows = _elements(nodes, "select", "optgroup", "option").withColumn("multiple", _has("multiple")).withColumn("size", size)
    rows = around(rows, {"selects": is_("select").cast("int"), "groups": is_("select", "optgroup").cast("int")}, [key])
    # the innermost select or group around decides whether its group disables an option
    rows = innermost(rows, is_("select", "optgroup"), "groups", F.struct("id", (is_("optgroup") & _has("disabled")).alias("off")), [key], "group").where(is_("select", "option"))
    rows = innermost(rows, is_("select"), "selects", F.struct("id", "multiple", one_shows.alias("one_shows")), [key], "around", is_("option")).where(is_("option") & F.col("around").isNotNull())
    rows = _with_text(rows, nodes, key, "option").select(key, "id", "attrs", F.col("group.off").alias("group_off"), squeeze(F.coalesce("text", F.lit(""))).alias("body"), F.col("around.id").alias("select"), F.col("around.multiple").alias("multiple"), F.col("around.one_shows").alias("one_shows"))
    label = raw_attr("label")
    plain = rows.select(
        key, "id", "select", "multiple", "one_shows", F.coalesce(raw_attr("value"), F.col("body")).alias("value"), F.when(label != "", label).otherwise(F.col("body")).alias("label"), _has("selected").alias("chosen"),
        (_has("disabled") | F.col("group_off")).alias("disabled"),
    )
    w = Window.partitionBy(key, "select")
    last, first = F.max(F.when(F.col("chosen"), F.col("id"))).over(w), F.min(F.when(~F.col("disabled"), F.col("id"))).over(w)
    single = F.when(last.isNotNull(), F.col("id") == last).otherwise(F.coalesce(F.col("one_shows") & (F.col("id") == first), F.lit(False)))
    judged = plain.withColumn("selected", F.when(F.col("multiple"), F.col("chosen")).otherwise(single))
    held = F.array_sort(F.collect_list(F.struct("id", "value", "label", "selected", "disabled")))
    return judged.groupBy(F.col(key).alias("s_key"), F.col("select").alias("s_id")).agg(F.transform(held, lambda o: F.struct(o["value"].alias("value"), o["label"].alias("label"), o["selected"].alias("selected"), o["disabled"].alias("disabled"))).alias("options"))


def form_fields(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """A row for each field of each form: form (its number in the page), form_id (its node), field (its number in the form), id, name, type, value, checked,
    disabled, options."""
    rows = owners(nodes, key).join(options(nodes, key), _on(key, "s_key", "s_id"), "left")
    rows = _with_text(rows, nodes, key, "textarea")
    is_form = F.col("name") == "form"
    rows = rows.withColumn("number", F.count(F.when(is_form, True)).over(Window.partitionBy(key).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    rows = rows.withColumn("form_id", F.when(is_form, F.col("id")).otherwise(F.col("owner"))).where("form_id IS NOT NULL")
    mine = Window.partitionBy(key, "form_id")
    rows = rows.withColumn("form", F.max(F.when(is_form, F.col("number"))).over(mine)).withColumn("field", F.count(F.when(~is_form, True)).over(mine.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)).cast("int")).where(~is_form)
    tag, told = F.col("name"), fold(raw_attr("type"))
    kind = (
        F.when(tag == "input", F.when(told.isin(*INPUTS), told).otherwise("text")).when(tag == "button", F.when(told.isin("submit", "reset", "button"), told).otherwise("submit"))
        .when(tag == "textarea", "textarea").otherwise(F.when(_has("multiple"), "select-multiple").otherwise("select-one"))
    )
    check = F.col("kind").isin("checkbox", "radio")
    none = F.array().cast("array<struct<value: string, label: string, selected: boolean, disabled: boolean>>")
    chosen = F.get(F.filter("options", lambda o: o["selected"]), F.lit(0))["value"]
    value = F.when(tag == "input", F.coalesce(raw_attr("value"), F.when(check, "on").otherwise(""))).when(tag == "button", F.coalesce(raw_attr("value"), F.lit(""))).when(tag == "textarea", F.coalesce("text", F.lit(""))).otherwise(F.coalesce(chosen, F.lit("")))
    return rows.withColumn("kind", kind).select(
        key, "form", "form_id", "field", "id", raw_attr("name").alias("name"), F.col("kind").alias("type"), value.alias("value"), F.when((tag == "input") & check, _has("checked")).alias("checked"),
        (_has("disabled") | F.col("off")).alias("disabled"), F.coalesce("options", none).alias("options"),
    )


def forms(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """A row for each form: form, node, action (resolved), method, enctype, id, name, fields."""
    names = ("name", "type", "value", "checked", "disabled", "options")
    fields = form_fields(nodes, key).groupBy(F.col(key).alias("g_key"), F.col("form_id").alias("g_id")).agg(F.array_sort(F.collect_list(F.struct("field", *names))).alias("g"))
    method, enctype = fold(raw_attr("method")), fold(raw_attr("enctype"))
    rows = _elements(nodes, "form").select(
        key, F.row_number().over(Window.partitionBy(key).orderBy("id")).cast("int").alias("form"), F.col("id").alias("node"), resolve(F.coalesce(raw_attr("action"), F.lit("")), F.col("base")).alias("action"),
        F.when(method.isin("get", "post", "dialog"), method).otherwise("get").alias("method"), F.when(enctype.isin("multipart/form-data", "text/plain"), enctype).otherwise("application/x-www-form-urlencoded").alias("enctype"),
        raw_attr("id").alias("id"), raw_attr("name").alias("name"),
    )
    out = rows.join(fields, _on(key, "g_key", "g_id", "node"), "left")
    bare = F.transform("g", lambda x: F.struct(*(x[n].alias(n) for n in names)))
    empty = F.array().cast("array<struct<name: string, type: string, value: string, checked: boolean, disabled: boolean, options: array<struct<value: string, label: string, selected: boolean, disabled: boolean>>>>")
    return out.select(key, "form", "node", "action", "method", "enctype", "id", "name", F.coalesce(bare, empty).alias("fields"))
