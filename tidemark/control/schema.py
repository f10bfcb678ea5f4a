"""The records' shapes as data, and a check of records on disk against them.

``schema.json`` describes each record for readers in other languages. It is checked
apart from the classes that write the records, so that the two can't drift unseen:
``python -m tidemark.control.schema FOLDER`` lists what doesn't fit in a repository or a dataset.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from typing import Any

from .records import CONTROL


@cache
def shapes() -> dict[str, Any]:
    return json.loads((Path(__file__).parent / "schema.json").read_text("utf-8"))


def misfits(value: Any, shape: dict[str, Any] | str, at: str = "") -> Iterator[str]:
    """Where a value doesn't have a shape, or a named one."""
    if isinstance(shape, str):
        yield from misfits(value, shapes()[shape], at)
        return
    (rule, of), wrong = next(iter(shape.items())), False
    if rule == "is":
        yield from misfits(value, of, at)
    elif rule == "or_null":
        yield from () if value is None else misfits(value, of, at)
    elif rule == "fields":
        if not isinstance(value, dict) or value.keys() != of.keys():
            yield f"{at}: fields other than {', '.join(of)}"
            return
        for name, inner in of.items():
            yield from misfits(value[name], inner, f"{at}.{name}")
    elif rule in ("list", "each"):
        if not isinstance(value, list if rule == "list" else dict):
            yield f"{at}: no {'list' if rule == 'list' else 'object'}"
            return
        for key, inner in enumerate(value) if rule == "list" else value.items():
            yield from misfits(inner, of, f"{at}[{key}]")
    elif rule == "text":
        wrong = not isinstance(value, str) or re.search(of, value) is None
    elif rule == "equals":
        wrong = type(value) is not type(of) or value != of
    elif rule == "count":
        wrong = type(value) is not int or value < 0
    elif rule == "flag":
        wrong = type(value) is not bool
    elif rule == "object":
        wrong = not isinstance(value, dict)
    else:
        raise ValueError(f"no such rule: {rule}")
    if wrong:
        yield f"{at}: not {rule} {of}: {value!r}"


def records(root: Path) -> Iterator[tuple[Path, str]]:
    """The control records below a repository's or dataset's folder, and the shape each has."""
    control = Path(root) / CONTROL
    named = {"register.json": "register", "dataset.json": "dataset", "head.json": "state"}
    yield from ((control / name, shape) for name, shape in named.items() if (control / name).exists())
    yield from ((file, "change") for file in sorted(control.glob("work/*/change.json")))
    if (control / "intent.json").exists():
        kind = json.loads((control / "intent.json").read_text("utf-8")).get("kind")
        yield control / "intent.json", kind if kind in ("publish", "rollback", "prune") else "publish"


def check(root: Path) -> list[str]:
    """What doesn't fit in the records below a folder."""
    return [f"{file}{x}" for file, shape in records(Path(root)) for x in misfits(json.loads(file.read_text("utf-8")), shape)]


def main(folders: list[str]) -> int:
    found = [x for folder in folders for x in check(Path(folder))]
    print("\n".join(found) or "all records fit")
    return int(bool(found))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
