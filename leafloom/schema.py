"""Schemas of parsed pages."""

from __future__ import annotations

ATTRS = "array<struct<ns: string, name: string, value: string>>"
NODE = f"""struct<id: int, parent: int, subtree_end: int, depth: int, first_child: int, next_sib: int, prev_sib: int, next_elem: int, prev_elem: int,
elem_pos: int, elem_count: int, n_elem_children: int, n_text_children: int, type: string, ns: string, name: string, value: string,
is_template: boolean, in_template_of: int, attrs: {ATTRS}>"""
PROBLEMS = "array<struct<stage: string, code: string, line: int, column: int, byte_offset: long>>"
ERROR = "struct<kind: string, message: string, arg: string, encoding: string, limit: string, maximum: long, observed: long>"
PAGE = f"""type string, context string, root_id int, encoding string, encoding_source string, base_url string, resolved_base string, quirks_mode string,
n_nodes long, n_attrs long, input_bytes long, n_problems long, problems_truncated boolean, problems {PROBLEMS}, error {ERROR}, nodes array<{NODE}>"""
