"""The public tree-construction cases (.dat files), where a folder of them is at hand: TREE_CASES names it. Without it, nothing runs."""

import os
import re
from pathlib import Path

import pytest

from leafloom.kernel.flat import parse_html
from leafloom.kernel.serialize import dump

FOLDER = os.environ.get("TREE_CASES", "")
FILES = sorted(Path(FOLDER).glob("*.dat")) if FOLDER else []


def cases(path):
    """(data, context, scripting, tree) of each case."""
    for block in re.split(r"(?:^|\n)#data\n", path.read_bytes().decode("utf-8", "surrogatepass")):
        if not block:
            continue
        parts = re.split(r"(?:^|\n)#(errors|new-errors|document-fragment|script-on|script-off|document)(?=\n|$)", block)
        found = {name: body.removeprefix("\n") for name, body in zip(parts[1::2], parts[2::2])}
        yield parts[0], found.get("document-fragment"), "script-on" in found, found["document"].rstrip("\n")


@pytest.mark.skipif(not FILES, reason="no folder of cases")
@pytest.mark.parametrize("path", FILES, ids=lambda p: p.name)
def test_trees(path):
    wrong = []
    for n, (data, context, scripting, want) in enumerate(cases(path)):
        if scripting or "\0" in data:  # NUL is an error of decoding here
            continue
        got = dump(parse_html(data, context=context))
        if got.rstrip("\n") != want:
            wrong.append((n, data, got, want))
    assert not wrong, f"{len(wrong)} cases differ, the first: {wrong[0]}"
