"""Tables: the grid of slots that cells with spans fill, header rows, column names, conversion."""

from __future__ import annotations

import re
from dataclasses import dataclass

from leafloom.errors import InputError, LimitError, TableError
from leafloom.kernel.flat import Tree
from leafloom.kernel.text import clean
from leafloom.kernel.urls import resolve

MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
_NUMBER = re.compile(r"[ \t\n\r\f]*\+?(\d+)")


def whole(value: str | None) -> int | None:
    """A non-negative integer at the start, by the rules of HTML."""
    m = _NUMBER.match(value or "")
    return int(m[1]) if m else None


def _spans(t: Tree, c: int, left: int) -> tuple[int, int]:
    """Columns and rows of a cell with `left` rows from its own to the end of its group."""
    span = min(whole(t.attr(c, "colspan")) or 1, MAX_COLSPAN)
    down = whole(t.attr(c, "rowspan"))
    down = 1 if down is None else min(down, MAX_ROWSPAN)
    return span, left if down == 0 else min(down, left)


@dataclass
class Cell:
    node: int
    row: int  # from 0
    col: int
    rowspan: int
    colspan: int
    section: str
    header: bool


@dataclass
class Grid:
    cells: list[Cell]
    rows: list[tuple[int, str]]  # node, section
    width: int
    slots: list[list[int]]  # index of the cell, -1: none


def grid(t: Tree, table: int, max_cells: int = 1_000_000) -> Grid:
    """Row groups in the order head, bodies, foot; a run of rows that stand directly in the table is a body of its own."""
    groups: dict[str, list[tuple[str, list[int]]]] = {"thead": [], "tbody": [], "tfoot": []}
    run: list[int] | None = None
    for k in t.kids[table]:
        if t.is_html(k, "thead", "tbody", "tfoot"):
            groups[t.name[k]].append((t.name[k], [r for r in t.kids[k] if t.is_html(r, "tr")]))
            run = None
        elif t.is_html(k, "tr"):
            if run is None:
                run = []
                groups["tbody"].append(("tbody", run))
            run.append(k)
    cells: list[Cell] = []
    rows: list[tuple[int, str]] = []
    slots: list[list[int]] = []
    width = 0
    for section, trs in [*groups["thead"], *groups["tbody"], *groups["tfoot"]]:
        first = len(rows)
        rows += [(r, section) for r in trs]
        slots += [[] for _ in trs]
        for r, tr in enumerate(trs, first):
            col = number = 0
            line, left = slots[r], first + len(trs) - r
            for c in t.kids[tr]:
                if t.name[c] not in ("td", "th") or not t.is_html(c):
                    continue
                number += 1
                while col < len(line) and line[col] >= 0:
                    col += 1
                span, down = _spans(t, c, left) if t.attrs[c] else (1, 1)
                width = max(width, col + span)
                if width * len(rows) > max_cells:
                    raise LimitError("max_table_cells", max_cells, width * len(rows))
                n = len(cells)
                cells.append(Cell(c, r, col, down, span, section, t.name[c] == "th"))
                if down == span == 1 and col == len(line):
                    line.append(n)
                    col += 1
                    continue
                for y in range(r, r + down):
                    below = slots[y]
                    if len(below) < col + span:
                        below.extend([-1] * (col + span - len(below)))
                    for x in range(col, col + span):
                        if below[x] >= 0:
                            raise TableError(f"cells overlap in row {r + 1}, at cell {number}", r + 1, number)
                        below[x] = n
                col += span
    for line in slots:
        line.extend([-1] * (width - len(line)))
    return Grid(cells, rows, width, slots)


def header_rows(t: Tree, g: Grid, header="auto") -> list[int]:
    """Rows (from 0) that hold headers: the head's, else the first rows of <th> alone; True: the first; or given numbers from 1."""
    n = len(g.rows)
    if header is False:
        return []
    if header is True:
        return [0] if n else []
    if header != "auto":
        return [h - 1 for h in header if 1 <= h <= n]
    head = [i for i, (_, s) in enumerate(g.rows) if s == "thead"]
    if head:
        return head
    out = []
    for i in range(n):
        mine = {g.cells[c].header for c in g.slots[i] if c >= 0}
        if mine != {True}:
            break
        out.append(i)
    return out


def unique(names: list[str]) -> list[str]:
    """Names that occur again get .1, .2, ..., the first that is free."""
    taken, seen, out, count = set(names), set(), [], {}
    for n in names:
        if n in seen:
            k = count.get(n, 1)
            while f"{n}.{k}" in taken:
                k += 1
            count[n] = k + 1
            n = f"{n}.{k}"
            taken.add(n)
        seen.add(n)
        out.append(n)
    return out


def table(t: Tree, node: int, header="auto", trim: bool = True, max_cells: int = 1_000_000) -> tuple[list[str], list[list[str | None]]]:
    """Column names and rows of text; slots that no cell fills are None."""
    g = grid(t, node, max_cells)
    texts = [clean(t, c.node, trim, skip_tables=True) for c in g.cells]
    heads = header_rows(t, g, header)
    names = []
    for x in range(g.width):
        parts: list[str] = []
        for r in heads:
            s = texts[g.slots[r][x]].strip(" \t\n\r\f") if g.slots[r][x] >= 0 else ""
            if s and (not parts or parts[-1] != s):
                parts.append(s)
        names.append(" / ".join(parts) or f"V{x + 1}")
    named = set(heads)
    body = [[texts[c] if c >= 0 else None for c in g.slots[r]] for r in range(len(g.rows)) if r not in named]
    return unique(names), body


def cells(t: Tree, node: int, trim: bool = True, absolute: bool = False, max_cells: int = 1_000_000) -> list[dict]:
    """A row for each cell: row and column from 1, spans, section, header, text, links outside nested tables."""
    g = grid(t, node, max_cells)
    base = t.base if absolute else None
    out = []
    for c in g.cells:
        links, k = [], c.node + 1
        while k <= t.end[c.node]:
            if t.is_html(k, "table", "template"):
                k = t.end[k] + 1
                continue
            if t.type[k] == "element" and t.name[k] in ("a", "area") and (h := t.attr(k, "href")) is not None:
                links.append(resolve(h, base) if absolute else h)
            k += 1
        out.append({"row": c.row + 1, "column": c.col + 1, "rowspan": c.rowspan, "colspan": c.colspan, "section": c.section, "header": c.header, "text": clean(t, c.node, trim, skip_tables=True), "links": links})
    return out


_NUM = r"[+-]?(?:\d+(?:{d}\d*)?|{d}\d+)(?:[eE][+-]?\d+)?"


def convert(column: list[str | None], decimal: str = ".", thousands: str | None = None) -> tuple[str, list]:
    """All or nothing: ("logical" | "integer" | "double" | "character", values). None stays None.

    Numbers that would not come back as they are written, such as 007 or ones of over 15 significant digits, keep a column as text."""
    there = [v for v in column if v is not None]
    if not there:
        return "character", list(column)
    truth = {"TRUE": True, "True": True, "true": True, "T": True, "FALSE": False, "False": False, "false": False, "F": False}
    if all(v in truth for v in there):
        return "logical", [v if v is None else truth[v] for v in column]
    for mark, name in ((decimal, "decimal"), (thousands, "thousands")):
        if mark is not None and (not isinstance(mark, str) or len(mark) != 1 or mark in "+-eE0123456789"):
            raise InputError(f"{name} must be one character that is no part of a number", name)
    if decimal == thousands:
        raise InputError("decimal and thousands must differ", "thousands")
    thousands = " " if thousands == "\xa0" else thousands  # cleaned text has plain spaces
    d = re.escape(decimal)
    plain, number = [], re.compile(_NUM.format(d=d))
    for v in there:
        v = v.strip(" \t\n\r\f")
        if thousands and thousands in v:
            if not re.fullmatch(rf"[+-]?\d{{1,3}}(?:{re.escape(thousands)}\d{{3}})+(?:{d}\d*)?", v):
                return "character", list(column)
            v = v.replace(thousands, "")
        if not number.fullmatch(v):
            return "character", list(column)
        v = v.replace(decimal, ".")
        digits = re.sub(r"[eE].*", "", v.lstrip("+-"))
        if re.match(r"0\d", digits):
            return "character", list(column)
        significant = digits.replace(".", "").strip("0")
        x = float(v)
        if len(significant) > 15 or x in (float("inf"), float("-inf")) or (significant and abs(x) < 2.2250738585072014e-308):
            return "character", list(column)
        plain.append(v)
    values = iter(plain)
    if all(re.fullmatch(r"[+-]?\d+", v) and abs(int(v)) < 1 << 31 for v in plain):
        return "integer", [v if v is None else int(next(values)) for v in column]
    return "double", [v if v is None else float(next(values)) for v in column]


def outermost(t: Tree, nodes: list[int]) -> list[int]:
    out, end = [], -1
    for n in sorted(set(nodes)):
        if n > end:
            out.append(n)
            end = t.end[n]
    return out
