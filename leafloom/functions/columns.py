"""Column functions over nodes: attributes, classes, names, URLs. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafloom.kernel.flat import URI

WS = r"[ \t\n\r\f]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(c: Column) -> Column:
    """ASCII letters in lower case."""
    return F.translate(c, _UPPER, _LOWER)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}|{WS}$", "")


def squeeze(c: Column) -> Column:
    """Runs of ASCII white space as one space, none at the ends."""
    return trim(F.regexp_replace(c, WS, " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, WS), lambda x: x != "")


def raw_attr(name: str, ns: str = "", attrs: str = "attrs") -> Column:
    """The value of the attribute with exactly that name, null if it is not there."""
    return F.get(F.filter(attrs, lambda a: (a["name"] == name) & (a["ns"] == ns)), F.lit(0))["value"]


def attr(name: str, default: str | None = None) -> Column:
    """An attribute by name: in any case on HTML elements, as written on others; xlink:, xml: and xmlns: choose a namespace."""
    low = name.lower() if name.isascii() else name
    head, _, rest = name.partition(":")
    exact = F.coalesce(raw_attr(rest, head), raw_attr(name)) if rest and head in ("xlink", "xml", "xmlns") else raw_attr(name)
    value = F.when(F.col("type") == "element", F.when(F.col("ns") == "html", raw_attr(low)).otherwise(exact))
    return value if default is None else F.when(F.col("id").isNotNull(), F.coalesce(value, F.lit(default)))


def attrs() -> Column:
    """All attributes in source order as (name, value), with prefixes."""
    named = F.transform("attrs", lambda a: F.struct(F.when((a["ns"] == "") | (a["name"] == "xmlns"), a["name"]).otherwise(F.concat(a["ns"], F.lit(":"), a["name"])).alias("name"), a["value"].alias("value")))
    return F.when(F.col("type") == "element", named).otherwise(F.when(F.col("id").isNotNull(), F.array().cast("array<struct<name: string, value: string>>")))


def classes() -> Column:
    c = F.coalesce(tokens(raw_attr("class")), F.array().cast("array<string>"))
    return F.when(F.col("id").isNotNull(), c)


def node_name() -> Column:
    return F.when(F.col("type").isin("element", "doctype"), F.col("name"))


def namespace() -> Column:
    c = F.lit(None).cast("string")
    for k, v in URI.items():
        c = F.when(F.col("ns") == k, v).otherwise(c)
    return F.when(F.col("type") == "element", c)


# -- URI references, RFC 3986 ----------------------------------------------------------------------------------------------

_SPLIT = r"(?s)^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def _part(c: Column, whole: int, part: int) -> Column:
    """A component, null where it is undefined."""
    return F.when(F.regexp_extract(c, _SPLIT, whole) != "", F.regexp_extract(c, _SPLIT, part))


def _dots(path: Column) -> Column:
    """Dot segments removed: segments are stacked, '..' takes the last one away."""
    segments = F.split(path, "/")
    rooted = path.startswith("/")
    last = F.element_at(segments, -1)
    body = F.filter(F.slice(segments, F.when(rooted, 2).otherwise(1), F.size(segments)), lambda s: s != ".")
    empty = F.array().cast("array<string>")
    stacked = F.aggregate(body, empty, lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    ends = last.isin(".", "..") & (F.size(stacked) > 0)
    out = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(stacked, "/"), F.when(ends, F.lit("/")).otherwise(F.lit("")))
    return F.when(path.contains("."), out).otherwise(path)


def resolve(reference: Column, base: Column) -> Column:
    """A reference resolved against a base; null where it is no reference or there is no absolute base for a relative one."""
    r = trim(reference)
    ok = lambda c: ~c.rlike(r"[\x01-\x20\x7f]") & (_part(c, 1, 2).isNull() | _part(c, 1, 2).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*$"))
    s, a, p, q, f = _part(r, 1, 2), _part(r, 3, 4), F.regexp_extract(r, _SPLIT, 5), _part(r, 6, 7), _part(r, 8, 9)
    bs, ba, bp, bq = _part(base, 1, 2), _part(base, 3, 4), F.regexp_extract(base, _SPLIT, 5), _part(base, 6, 7)
    merged = F.when(ba.isNotNull() & (bp == ""), F.concat(F.lit("/"), p)).otherwise(F.concat(F.regexp_extract(bp, r"(?s)^(.*/)?", 0), p))
    alone = s.isNotNull() | a.isNotNull()
    path = F.when(alone, _dots(p)).when(p == "", bp).when(p.startswith("/"), _dots(p)).otherwise(_dots(merged))
    query = F.when(~alone & (p == "") & q.isNull(), bq).otherwise(q)
    authority = F.when(alone, a).otherwise(ba)
    show = lambda mark, c: F.coalesce(F.concat(F.lit(mark), c), F.lit(""))
    whole = F.concat(F.coalesce(s, bs), F.lit(":"), show("//", authority), path, show("?", query), show("#", f))
    return F.when(ok(r) & (s.isNotNull() | (base.isNotNull() & ok(base) & bs.isNotNull())), whole)
