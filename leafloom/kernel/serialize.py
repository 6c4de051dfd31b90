"""Markup of nodes, by the HTML standard's serialization, or laid out for reading."""

from __future__ import annotations

import re

from leafloom.kernel.flat import Tree

# Elements without an end tag; parents whose text is written as it is.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("style script xmp iframe noembed noframes plaintext".split())
# Elements on lines of their own, and those whose content stays as it is, in the layout for reading.
LINES = frozenset("""address article aside base blockquote body caption col colgroup dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav noscript ol optgroup option p pre script section
style summary table tbody td template tfoot th thead title tr ul""".split())
KEEP = frozenset("iframe listing noembed noframes plaintext pre script style textarea xmp".split())
_TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", "\xa0": "&nbsp;"})
_ATTR = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", "\xa0": "&nbsp;", '"': "&quot;"})


def _open(t: Tree, i: int) -> str:
    parts = [f"<{t.name[i]}"]
    for ns, k, v in t.attrs[i]:
        name = k if not ns or k == "xmlns" else f"{ns}:{k}"
        parts.append(f' {name}="{v.translate(_ATTR)}"')
    return "".join(parts) + ">"


def _leaf(t: Tree, i: int, raw: bool) -> str:
    kind, value = t.type[i], t.value[i]
    if kind == "text":
        return value if raw else value.translate(_TEXT)
    if kind == "comment":
        return f"<!--{value}-->"
    if kind == "processing_instruction":
        return f"<?{value}?>"
    return f"<!DOCTYPE {t.name[i]}>"


def serialize(t: Tree, i: int, outer: bool = True, pretty: bool = False, raw: bool = False) -> str:
    """The markup of node i, or with outer=False of what it holds."""
    if pretty:
        return _pretty(t, i, outer)
    out: list[str] = []
    todo: list = [i] if outer and t.type[i] not in ("document", "fragment") else list(reversed(t.kids[i]))
    if t.is_html(i, *VOID) and not outer:
        return ""
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif t.type[k] == "element":
            out.append(_open(t, k))
            if not (t.ns[k] == "html" and t.name[k] in VOID):
                todo.append(f"</{t.name[k]}>")
                todo.extend(reversed(t.kids[k]))
        else:
            p = t.parent[k]
            out.append(_leaf(t, k, raw if p <= 0 else t.is_html(p, *RAW)))
    return "".join(out)


def _pretty(t: Tree, i: int, outer: bool) -> str:
    lines: list[list] = []  # [indent, text]

    def line(depth: int, text: str) -> None:
        lines.append([depth, text])

    def inline(k: int, depth: int, fresh: bool) -> bool:
        """Adds k to the current line (a new one if fresh); whether the next one needs a new line."""
        s = serialize(t, k) if t.type[k] == "element" else _leaf(t, k, t.parent[k] > 0 and t.is_html(t.parent[k], *RAW))
        if t.type[k] == "text":
            s = re.sub(r"[ \t\n\f\r]+", " ", s)
        if fresh or not lines:
            line(depth, s.lstrip(" "))
        else:
            lines[-1][1] += s
        return False

    todo: list = [("node", i, 0)] if outer and t.type[i] not in ("document", "fragment") else [("kids", i, 0)]
    fresh = True
    while todo:
        what, k, depth = todo.pop()
        if what == "end":
            line(depth, f"</{t.name[k]}>")
            fresh = True
        elif what == "kids":
            todo.extend(("node", c, depth) for c in reversed(t.kids[k]))
        elif t.type[k] == "element" and t.is_html(k, *LINES):
            laid = not t.is_html(k, *KEEP) and any(t.is_html(c, *LINES) for c in t.kids[k])
            if laid:
                line(depth, _open(t, k))
                todo += [("end", k, depth), ("kids", k, depth + 1)]
            else:
                s = serialize(t, k)
                if not t.is_html(k, *KEEP, *VOID):
                    body = re.sub(r"[ \t\n\f\r]+", " ", serialize(t, k, outer=False)).strip(" ")
                    s = f"{_open(t, k)}{body}</{t.name[k]}>"
                line(depth, s)
            fresh = True
        elif t.type[k] == "text" and not t.value[k].strip(" \t\n\f\r") and (fresh or any(t.is_html(c, *LINES) for c in t.kids[t.parent[k]])):
            if not fresh and lines and t.parent[k] >= 0 and not any(t.is_html(c, *LINES) for c in t.kids[t.parent[k]]):
                lines[-1][1] += " "
        elif t.type[k] in ("doctype", "comment", "processing_instruction"):
            line(depth, _leaf(t, k, False))
            fresh = True
        else:
            fresh = inline(k, depth, fresh)
    return "\n".join("  " * d + s.rstrip(" ") for d, s in lines if s.strip(" "))


def dump(t: Tree, i: int = 0) -> str:
    """The nodes below `i` (and `i` itself, unless it is the document), one a line, in the notation of the public tree-construction tests:
    two spaces a level, attributes in order of their names below their element, a template's contents below `content`. The identifiers of a doctype are told where the page
    has just been parsed."""
    out: list[str] = []
    todo = [(k, 0) for k in reversed(t.kids[0] if i == 0 else [i])]
    while todo:
        k, depth = todo.pop()
        pad, kind = "| " + "  " * depth, t.type[k]
        if kind == "element":
            space = "" if t.ns[k] == "html" else f"{t.ns[k]} "
            out.append(f"{pad}<{space}{t.name[k]}>")
            out += sorted(f"{pad}  {ns + ' ' if ns else ''}{n}=\"{v}\"" for ns, n, v in t.attrs[k])
            inner = depth + 1
            if t.is_html(k, "template"):
                out.append(f"{pad}  content")
                inner += 1
            todo.extend((c, inner) for c in reversed(t.kids[k]))
        elif kind == "text":
            out.append(f'{pad}"{t.value[k]}"')
        elif kind == "comment":
            out.append(f"{pad}<!-- {t.value[k]} -->")
        elif kind == "processing_instruction":
            out.append(f"{pad}<?{t.value[k]}?>")
        else:
            ids = f' "{t.doctype[0] or ""}" "{t.doctype[1] or ""}"' if any(x is not None for x in t.doctype) else ""
            out.append(f"{pad}<!DOCTYPE {t.name[k]}{ids}>")
    return "\n".join(out)
