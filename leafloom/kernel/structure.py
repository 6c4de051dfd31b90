"""Lists, forms, JSON-LD and microdata of a page."""

from __future__ import annotations

import json
import re
from collections import deque

from leafloom.kernel.flat import Tree
from leafloom.kernel.text import clean, text
from leafloom.kernel.urls import resolve

WS = " \t\n\r\f"


def squeeze(s: str) -> str:
    return re.sub(r"[ \t\n\r\f]+", " ", s).strip(WS)


def tokens(s: str | None) -> list[str]:
    return [x for x in re.split(r"[ \t\n\r\f]+", s or "") if x]


# -- lists ---------------------------------------------------------------------------------------------------------------


def items(t: Tree, node: int) -> list[str]:
    """One text for each direct <li>, without lists nested in it."""
    return [clean(t, k, skip_lists=True) for k in t.kids[node] if t.is_html(k, "li")]


def list_rows(t: Tree, node: int) -> list[dict]:
    """Every item of a list and of the lists in it: path (such as 1.2), depth from 0, list type, number, text."""
    out: list[dict] = []
    todo = [(node, "", 0)]
    while todo:
        n, path, depth = todo.pop()
        inner = []
        for no, li in enumerate((k for k in t.kids[n] if t.is_html(k, "li")), 1):
            here = f"{path}.{no}" if path else str(no)
            out.append({"path": here, "depth": depth, "item_no": no, "type": t.name[n], "text": clean(t, li, skip_lists=True)})
            k = li + 1
            while k <= t.end[li]:
                if t.is_html(k, "ul", "ol"):
                    inner.append((k, here, depth + 1))
                    k = t.end[k] + 1
                else:
                    k = t.end[k] + 1 if t.is_html(k, "template") else k + 1
        todo.extend(reversed(inner))
    out.sort(key=lambda r: [int(x) for x in r["path"].split(".")])
    return out


# -- forms ---------------------------------------------------------------------------------------------------------------

# Fixed values of the HTML standard: the types of <input>.
INPUTS = frozenset("hidden text search tel url email password date month week time datetime-local number range color checkbox radio file submit image reset button".split())


def forms(t: Tree, at: list[int | None]) -> list[dict]:
    """The forms among `at` and below, with their fields: owner by form=, else the form around, else one that stands empty in a
    table before. Controls may stand anywhere in the page."""
    page = [k for k in t.visible(0) if t.is_html(k, "form", "input", "select", "textarea", "button")]
    mine: dict[int, list[int]] = {k: [] for k in page if t.name[k] == "form"}
    last = None
    for k in page:
        if t.name[k] == "form":
            last = k
        elif (owner := _owner(t, k, last)) is not None:
            mine[owner].append(k)
    out = []
    for f in (k for k in t.reach(at) if t.is_html(k, "form")):
        method = (t.attr(f, "method") or "get").lower()
        enctype = (t.attr(f, "enctype") or "").lower()
        out.append(
            {
                "form": len(out) + 1, "node": f, "action": resolve(t.attr(f, "action") or "", t.base), "method": method if method in ("get", "post", "dialog") else "get",
                "enctype": enctype if enctype in ("multipart/form-data", "text/plain") else "application/x-www-form-urlencoded", "id": t.attr(f, "id"), "name": t.attr(f, "name"),
                "fields": [_field(t, c) for c in mine.get(f, ())],
            }
        )
    return out


def _owner(t: Tree, c: int, f: int | None) -> int | None:
    """The form that control `c` belongs to; `f` is the last form before it."""
    ref = t.attr(c, "form")
    if ref is not None:
        k = t.by_id(ref)
        return k if k is not None and t.is_html(k, "form") else None
    if f is None:
        return None
    for a in t.ancestors(c):
        if t.is_html(a, "form"):
            return a
    # the parser leaves a form in a table empty; what follows in the table belongs to it, up to the next form
    table = next((a for a in t.ancestors(c) if t.is_html(a, "table")), None)
    if table is None:
        return None
    inside = t.parent[f] >= 0 and t.is_html(t.parent[f], "table", "tbody", "thead", "tfoot", "tr") and t.end[f] == f
    own = next((a for a in t.ancestors(f) if t.is_html(a, "table")), None)
    return f if inside and own == table else None


def _field(t: Tree, c: int) -> dict:
    kind, checked, options = t.name[c], None, []
    if kind == "input":
        kind = (t.attr(c, "type") or "text").lower()
        kind = kind if kind in INPUTS else "text"
        check = kind in ("checkbox", "radio")
        value = t.attr(c, "value")
        value = ("on" if check else "") if value is None else value
        checked = t.attr(c, "checked") is not None if check else None
    elif kind == "button":
        kind = (t.attr(c, "type") or "submit").lower()
        kind = kind if kind in ("submit", "reset", "button") else "submit"
        value = t.attr(c, "value") or ""
    elif kind == "textarea":
        value = text(t, c)
    else:
        multiple = t.attr(c, "multiple") is not None
        kind = "select-multiple" if multiple else "select-one"
        options = _options(t, c, _display_size(t.attr(c, "size"), multiple), multiple)
        value = next((o["value"] for o in options if o["selected"]), "")
    return {"name": t.attr(c, "name"), "type": kind, "value": value, "checked": checked, "disabled": _disabled(t, c), "options": options}


def _display_size(size: str | None, multiple: bool) -> int:
    m = re.match(r"[ \t\n\r\f]*([-+]?)(\d+)", size or "")
    usual = 4 if multiple else 1
    if not m or (m[1] == "-" and int(m[2])):
        return usual
    return int(m[2])


def _options(t: Tree, select: int, size: int, multiple: bool) -> list[dict]:
    out = []
    for o in (k for k in t.visible(select) if t.is_html(k, "option")):
        body = squeeze(text(t, o) or "")
        label, value = t.attr(o, "label"), t.attr(o, "value")
        group = next((a for a in t.ancestors(o) if t.is_html(a, "optgroup", "select")), None)
        off = t.attr(o, "disabled") is not None or (group is not None and t.name[group] == "optgroup" and t.attr(group, "disabled") is not None)
        out.append({"value": body if value is None else value, "label": label or body, "selected": t.attr(o, "selected") is not None, "disabled": off})
    if not multiple:
        chosen = [o for o in out if o["selected"]]
        for o in chosen[:-1]:
            o["selected"] = False
        if not chosen and size == 1 and (first := next((o for o in out if not o["disabled"]), None)):
            first["selected"] = True
    return out


def _disabled(t: Tree, c: int) -> bool:
    if t.attr(c, "disabled") is not None:
        return True
    below = c
    for a in t.ancestors(c):
        if t.is_html(a, "fieldset") and t.attr(a, "disabled") is not None:
            legend = next((k for k in t.kids[a] if t.is_html(k, "legend")), None)
            if legend is None or below != legend:
                return True
        below = a
    return False


# -- metadata ------------------------------------------------------------------------------------------------------------


def title(t: Tree) -> str | None:
    return next((squeeze(text(t, k) or "") for k in t.visible(0) if t.is_html(k, "title")), None)


def json_ld(t: Tree, at: list[int | None]) -> list[str]:
    return [text(t, k) or "" for k in t.reach(at) if t.is_html(k, "script") and (t.attr(k, "type") or "").split(";")[0].strip(WS).lower() == "application/ld+json"]


def unwrap_json(s: str) -> str:
    """Without a CDATA section or an HTML comment around, in script comments or not."""
    s = s.strip(WS)
    m = re.fullmatch(r"(?s)(?:/\*|//)?[ \t]*<!\[CDATA\[(?:[ \t]*\*/)?(.*?)(?:/\*|//)?[ \t]*\]\]>(?:[ \t]*\*/)?", s) or re.fullmatch(r"(?s)<!--(.*?)(?://)?[ \t]*-->", s)
    return m[1].strip(WS) if m else s


def parsed_json(s: str):
    """The value, None if it is no JSON."""
    try:
        return json.loads(unwrap_json(s))
    except ValueError:
        return None


# Fixed values of the HTML standard: elements whose property value is a URL, and the attribute that holds it.
_URL_ATTR = {
    "a": "href",
    "area": "href",
    "audio": "src",
    "embed": "src",
    "iframe": "src",
    "img": "src",
    "link": "href",
    "object": "data",
    "source": "src",
    "track": "src",
    "video": "src",
}


def microdata(t: Tree, at: list[int | None]) -> list[dict]:
    """A row for each property value of the top-level items among `at` and below: item (path), type tokens, item id, property, number,
    value, child item (path). Items without properties give a row without one; a value that would lead back to its own item is
    null. An item has an id only if it has a type."""
    tops = [k for k in t.reach(at) if t.type[k] == "element" and t.attr(k, "itemscope") is not None and t.attr(k, "itemprop") is None]
    out: list[dict] = []
    todo = deque((k, str(n), (k,)) for n, k in enumerate(tops, 1))
    while todo:
        item, path, above = todo.popleft()
        kinds, own_id = list(dict.fromkeys(tokens(t.attr(item, "itemtype")))), t.attr(item, "itemid")
        row = {"item": path, "type": kinds, "id": resolve(own_id, t.base) if kinds and own_id is not None else None}
        props, count = _properties(t, item), {}
        if not props:
            out.append(row | {"property": None, "ord": None, "value": None, "child": None})
        for p in props:
            for name in dict.fromkeys(tokens(t.attr(p, "itemprop"))):
                count[name] = n = count.get(name, 0) + 1
                value = child = None
                if t.attr(p, "itemscope") is not None:
                    if p not in above:
                        child = f"{path}/{name}.{n}"
                        todo.append((p, child, (*above, p)))
                else:
                    value = _value(t, p)
                out.append(row | {"property": name, "ord": n, "value": value, "child": child})
    return out


def _properties(t: Tree, item: int) -> list[int]:
    """The HTML standard's algorithm: the item's children and what itemref names, not entering other items."""
    found, met = [], {item}
    todo = [k for k in t.kids[item] if t.type[k] == "element"] + [k for r in tokens(t.attr(item, "itemref")) if (k := t.by_id(r)) is not None]
    while todo:
        k = todo.pop()
        if k in met:
            continue
        met.add(k)
        if t.attr(k, "itemscope") is None and not t.is_html(k, "template"):
            todo.extend(c for c in t.kids[k] if t.type[c] == "element")
        if tokens(t.attr(k, "itemprop")):
            found.append(k)
    return sorted(found)


def _value(t: Tree, k: int) -> str:
    name = t.name[k]
    if name == "meta":
        return t.attr(k, "content") or ""
    if name in _URL_ATTR:
        v = t.attr(k, _URL_ATTR[name])
        return "" if v is None else resolve(v, t.base) or ""
    if name in ("data", "meter"):
        return t.attr(k, "value") or ""
    if name == "time" and (v := t.attr(k, "datetime")) is not None:
        return v
    return clean(t, k) or ""
