"""URI references by RFC 3986: splitting, removing dots, resolving."""

from __future__ import annotations

import re

_PARTS = re.compile(r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$")
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*$")
_BAD = re.compile(r"[\x01-\x20\x7f]")


def split(uri: str) -> tuple[str | None, str | None, str, str | None, str | None]:
    """Scheme, authority, path, query, fragment; None where undefined, which is not the same as empty."""
    return _PARTS.match(uri).groups()


def valid(uri: str) -> bool:
    if _BAD.search(uri):
        return False
    scheme = split(uri)[0]
    return scheme is None or bool(_SCHEME.match(scheme))


def without_dots(path: str) -> str:
    """Section 5.2.4."""
    out: list[str] = []
    while path:
        if path.startswith("../"):
            path = path[3:]
        elif path.startswith("./"):
            path = path[2:]
        elif path.startswith("/./"):
            path = path[2:]
        elif path == "/.":
            path = "/"
        elif path.startswith("/../") or path == "/..":
            path = "/" + path[4:]
            if out:
                out.pop()
        elif path in (".", ".."):
            path = ""
        else:
            end = path.find("/", 1)
            out.append(path if end < 0 else path[:end])
            path = "" if end < 0 else path[end:]
    return "".join(out)


def resolve(reference: str | None, base: str | None) -> str | None:
    """Section 5.2.2; None where the reference is no URI reference, or is relative and there is no absolute base."""
    if reference is None:
        return None
    reference = reference.strip(" \t\n\r\f")
    if not valid(reference):
        return None
    s, a, p, q, f = split(reference)
    if s is not None:
        p = without_dots(p)
    else:
        if base is None or not valid(base) or split(base)[0] is None:
            return None
        bs, ba, bp, bq, _ = split(base)
        s = bs
        if a is not None:
            p = without_dots(p)
        else:
            a = ba
            if not p:
                p, q = bp, bq if q is None else q
            elif p.startswith("/"):
                p = without_dots(p)
            else:
                merged = "/" + p if ba is not None and not bp else bp[: bp.rfind("/") + 1] + p
                p = without_dots(merged)
    return f"{s}:" + ("" if a is None else f"//{a}") + p + ("" if q is None else f"?{q}") + ("" if f is None else f"#{f}")


def document_base(t, base_url: str | None) -> str | None:
    """The first HTML <base href>, resolved against the page's own URL; else that URL."""
    for i in range(len(t.type)):
        if t.is_html(i, "base") and (href := t.attr(i, "href")) is not None:
            return resolve(href, base_url) or base_url
    return base_url
