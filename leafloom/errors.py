"""Errors of the library. Markup is never an error: it is repaired. Errors are about inputs, limits, encodings and selectors."""

from __future__ import annotations


class PageError(Exception):
    """Base of all errors."""

    kind = "page"

    def fields(self) -> dict:
        return {"kind": self.kind, "message": str(self)} | {k: v for k, v in vars(self).items() if not k.startswith("_")}


class InputError(PageError, ValueError):
    kind = "input"

    def __init__(self, message: str, arg: str | None = None):
        super().__init__(message)
        self.arg = arg


class EncodingError(PageError, ValueError):
    kind = "encoding"

    def __init__(self, message: str, encoding: str | None = None):
        super().__init__(message)
        self.encoding = encoding


class LimitError(PageError, ValueError):
    kind = "limit"

    def __init__(self, limit: str, maximum: int, observed: int):
        super().__init__(f"{limit} is {maximum}, and {observed} was reached")
        self.limit, self.maximum, self.observed = limit, maximum, observed


class SelectorError(PageError, ValueError):
    """position: of the offending character, from 1. unsupported: valid CSS that is not part of the language here."""

    kind = "selector"

    def __init__(self, selector: str, position: int, reason: str, unsupported: bool = False):
        super().__init__(f"{reason} at character {position}\n  {selector}\n  {' ' * (position - 1)}^")
        self.selector, self.position, self.reason, self.unsupported = selector, position, reason, unsupported


class TableError(PageError, ValueError):
    kind = "table_structure"

    def __init__(self, message: str, row: int, cell: int):
        super().__init__(message)
        self.row, self.cell = row, cell
