"""What a page says about itself: title, base, meta, JSON-LD and microdata, as native expressions.

Title, base, meta elements and scripts come from one look over each parsed page's nodes, an array in document order: nothing is joined, exchanged
or sent to Python after the parse. Microdata follows references between elements and is found by frontiers over stored nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions.columns import WS, fold, raw_attr, resolve, squeeze, tokens, trim
from leafloom.operators.nodes import KEY
from leafloom.plans.intervals import nearest, pairs
from leafloom.sources.pages import Cleaned, Pages, Wanted
from leafloom.sources.stored import Stored, store_nodes
from leafloom.sources.work import hold

# -- one look over each page ---------------------------------------------------------------------------------------------


def _attr_of(n: Column, name: str) -> Column:
    return F.get(F.filter(n["attrs"], lambda a: (a["name"] == name) & (a["ns"] == "")), F.lit(0))["value"]


def _elements(*names: str) -> Column:
    """Elements of these names outside templates, from the column `nodes`."""
    return F.filter("nodes", lambda n: (n["type"] == "element") & n["name"].isin(*names) & n["in_template_of"].isNull())


def _text_below(n: Column) -> Column:
    """The text of an element that holds no template: all text between it and its end."""
    inside = F.slice("nodes", n["id"] + 2, n["subtree_end"] - n["id"])
    return F.array_join(F.transform(F.filter(inside, lambda t: t["type"] == "text"), lambda t: t["value"]), "")


def page_metadata(docs: DataFrame, key: str = KEY) -> DataFrame:
    """A row for each parsed page: title, base (what references resolve against), meta (an array of id, name, property, http_equiv, charset, content) and
    scripts (an array of JSON-LD texts), all found in one pass over the page's elements of those names. Pages with an error are left out."""
    heads = docs.where("nodes IS NOT NULL").select(key, F.col("resolved_base").alias("base"), "nodes", _elements("title", "meta", "script").alias("found"))
    title = F.get(F.filter("found", lambda n: (n["name"] == "title") & (n["ns"] == "html")), F.lit(0))
    metas = F.transform(F.filter("found", lambda n: n["name"] == "meta"), lambda n: F.struct(n["id"].alias("id"), *(_attr_of(n, a).alias(a.replace("-", "_")) for a in ("name", "property", "http-equiv", "charset", "content"))))
    kind = lambda n: fold(trim(F.substring_index(F.coalesce(_attr_of(n, "type"), F.lit("")), ";", 1)))
    scripts = F.transform(F.filter("found", lambda n: (n["name"] == "script") & (n["ns"] == "html") & (kind(n) == "application/ld+json")), _text_below)
    return heads.withColumn("t", title).select(key, F.when(F.col("t").isNotNull(), squeeze(_text_below(F.col("t")))).alias("title"), "base", metas.alias("meta"), scripts.alias("scripts"))


def title(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The first HTML title of each page, squeezed; null without one."""
    return page_metadata(docs, key).select(key, "title")


def meta(docs: DataFrame, key: str = KEY) -> DataFrame:
    """A row for each <meta>: id, name, property, http_equiv, charset, content."""
    return page_metadata(docs, key).select(key, F.explode("meta").alias("m")).select(key, "m.*")


def unwrapped(text: Column) -> Column:
    """JSON without a CDATA section or an HTML comment around, in script comments or not."""
    s = F.regexp_replace(text, rf"^{WS}|{WS}$", "")
    section, comment = r"(?s)^(?:/\*|//)?[ \t]*<!\[CDATA\[(?:[ \t]*\*/)?(.*?)(?:/\*|//)?[ \t]*\]\]>(?:[ \t]*\*/)?$", r"(?s)^<!--(.*?)(?://)?[ \t]*-->$"
    inner = F.when(s.rlike(section), F.regexp_extract(s, section, 1)).when(s.rlike(comment), F.regexp_extract(s, comment, 1)).otherwise(s)
    return F.regexp_replace(inner, rf"^{WS}|{WS}$", "")


def json_ld(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The text of each JSON-LD script (n: its number in the page), and what it parses to as VARIANT (null where it is no JSON)."""
    rows = page_metadata(docs, key).select(key, F.posexplode("scripts").alias("n", "text"))
    return rows.select(key, (F.col("n") + 1).alias("n"), "text", F.try_parse_json(unwrapped(F.col("text"))).alias("json"))


# -- microdata -----------------------------------------------------------------------------------------------------------

# Fixed values of the HTML standard: elements whose property value is a URL, by the attribute that holds it.
URL_ATTRIBUTES = {"href": ("a", "area", "link"), "src": ("audio", "embed", "iframe", "img", "source", "track", "video"), "data": ("object",)}
COLUMNS = ("id", "parent", "subtree_end", "type", "ns", "name", "value", "attrs", "in_template_of")
ITEM_NODES = Wanted(frozenset({"template"}), frozenset({"itemscope", "itemprop", "id"}))


def item_nodes(pages: Pages) -> Stored:
    """The elements that items are made of, parsed and stored: those with itemscope, itemprop or an id, and templates. Properties have their cleaned text,
    a walk that the parser's task makes while it holds the tree."""
    return store_nodes(pages, *COLUMNS, wanted=ITEM_NODES, texts=Cleaned(attrs=frozenset({"itemprop"})))


def _has(name: str) -> Column:
    return raw_attr(name).isNotNull()


def _distinct_tokens(name: str) -> Column:
    return F.coalesce(F.array_distinct(tokens(raw_attr(name))), F.array().cast("array<string>"))


def _value() -> Column:
    """A property's value, of an element that is no item."""
    name, out = F.col("name"), F.coalesce("text", F.lit(""))
    out = F.when((name == "time") & _has("datetime"), raw_attr("datetime")).otherwise(out)
    out = F.when(name.isin("data", "meter"), F.coalesce(raw_attr("value"), F.lit(""))).otherwise(out)
    for attribute, names in URL_ATTRIBUTES.items():
        out = F.when(name.isin(*names), F.coalesce(resolve(raw_attr(attribute), F.col("base")), F.lit(""))).otherwise(out)
    return F.when(name == "meta", F.coalesce(raw_attr("content"), F.lit(""))).otherwise(out)


def item_properties(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """key, item, property, ord, id (of the element), is_item and value: the properties of each element with itemscope, by name and in document order.

    A property belongs to the item that is the nearest item or template around it. It belongs to an item whose itemref names an element, too,
    if that is the property or around it, with no item or template in between."""
    elements = nodes.where("type = 'element'")
    barriers = elements.where(_has("itemscope") | ((F.col("ns") == "html") & (F.col("name") == "template"))).select(key, "id", "subtree_end")
    props = elements.where(F.size(_distinct_tokens("itemprop")) > 0).select(key, "id", _distinct_tokens("itemprop").alias("names"), _has("itemscope").alias("is_item"), _value().alias("value"))
    props = nearest(barriers, props, [key], "barrier")
    by_id = elements.where(F.col("in_template_of").isNull() & (raw_attr("id") != "")).groupBy(F.col(key).alias("i_key"), raw_attr("id").alias("i_name")).agg(F.min(F.struct("id", "subtree_end")).alias("first"))
    refs = elements.where(_has("itemscope") & _has("itemref")).select(F.col(key).alias("r_key"), F.col("id").alias("item"), F.explode(_distinct_tokens("itemref")).alias("ref"))
    roots = by_id.join(refs, (F.col("i_key") == F.col("r_key")) & (F.col("i_name") == F.col("ref"))).select(F.col("i_key").alias(key), "item", F.col("first.id").alias("id"), F.col("first.subtree_end").alias("subtree_end"))
    far = pairs(roots, props, [key], itself=True).where((F.col("id") == F.col("o_id")) | (F.coalesce("barrier", F.lit(-1)) < F.col("o_id")))
    columns = (key, "item", "id", "names", "is_item", "value")
    both = props.where("barrier IS NOT NULL").withColumnRenamed("barrier", "item").select(*columns).unionByName(far.withColumnRenamed("o_item", "item").select(*columns))
    own = both.where(F.col("id") != F.col("item")).dropDuplicates([key, "item", "id"]).select(key, "item", "id", "is_item", "value", F.explode("names").alias("property"))
    return own.withColumn("ord", F.row_number().over(Window.partitionBy(key, "item", "property").orderBy("id")))


def microdata(nodes: DataFrame, key: str = KEY) -> DataFrame:
    """A row for each property value of each item: item (its path), type tokens, id, property, ord, value, child (the path of an item that is the value).
    Items without properties give a row without one. The items of a level are the frontier for the next one; each carries the items
    that lead to it, and a value that would lead back to one of these is null.

    nodes: of `item_nodes`, with the column `text`. There is a pass for each level of nested items."""
    scope = nodes.where((F.col("type") == "element") & _has("itemscope"))
    kinds = _distinct_tokens("itemtype")
    facts = scope.select(F.col(key).alias("f_key"), F.col("id").alias("f_id"), kinds.alias("type"), F.when(F.size(kinds) > 0, resolve(raw_attr("itemid"), F.col("base"))).alias("own_id"))
    properties = hold(item_properties(nodes, key)).select(F.col(key).alias("q_key"), F.col("item").alias("q_item"), "property", "ord", F.col("id").alias("q_id"), "is_item", "value")
    tops = scope.where(F.col("in_template_of").isNull() & ~_has("itemprop"))
    frontier = tops.select(key, F.col("id").alias("item"), F.row_number().over(Window.partitionBy(key).orderBy("id")).cast("string").alias("path"), F.array("id").alias("above"))
    out = None
    while True:
        frontier = hold(frontier)
        if out is not None and frontier.isEmpty():
            return out
        rows = frontier.join(facts, (F.col(key) == F.col("f_key")) & (F.col("item") == F.col("f_id"))).join(properties, (F.col(key) == F.col("q_key")) & (F.col("item") == F.col("q_item")), "left")
        child = F.when(F.col("is_item") & ~F.array_contains("above", F.col("q_id")), F.concat("path", F.lit("/"), "property", F.lit("."), F.col("ord").cast("string")))
        rows = rows.withColumn("child", child)
        told = rows.select(key, F.col("path").alias("item"), "type", F.col("own_id").alias("id"), "property", "ord", F.when(~F.col("is_item"), F.col("value")).alias("value"), "child")
        out = told if out is None else out.unionByName(told)
        frontier = rows.where("child IS NOT NULL").select(key, F.col("q_id").alias("item"), F.col("child").alias("path"), F.concat("above", F.array("q_id")).alias("above"))
