"""Limits of a parse. Each is a whole number within bounds; what exceeds one becomes that page's error."""

from __future__ import annotations

from dataclasses import dataclass, fields

from leafloom.errors import InputError

_BOUNDS = {"max_input": (1, 1 << 31), "max_depth": (1, 100_000), "max_nodes": (1, 1 << 31), "max_errors": (0, 1_000_000), "max_table_cells": (1, 1 << 31), "max_selector_length": (1, 1 << 31), "max_selector_tests": (1, 1 << 62)}


@dataclass(frozen=True)
class Limits:
    """max_input: bytes of decoded input. max_depth: open elements, html and body included. max_nodes: with the document node.
    max_selector_tests: tests of a node against a compound, in all searches of one page while it is parsed."""

    max_input: int = 16 << 20
    max_depth: int = 512
    max_nodes: int = 4_000_000
    max_errors: int = 100
    max_table_cells: int = 1_000_000
    max_selector_length: int = 16 << 10
    max_selector_tests: int = 1_000_000_000

    def __post_init__(self):
        for f in fields(self):
            v, (low, high) = getattr(self, f.name), _BOUNDS[f.name]
            if isinstance(v, bool) or not isinstance(v, (int, float)) or v != int(v) or not low <= v <= high:
                raise InputError(f"{f.name} must be a whole number from {low} to {high}", f.name)
            object.__setattr__(self, f.name, int(v))
