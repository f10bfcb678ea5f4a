"""Control records: their fields, and the rules for paths, ids and metadata.

A record is a frozen dataclass. ``read`` builds one from parsed JSON and fails closed:
unknown or missing fields and values of another type are corruption.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, fields
from typing import Any, Self

from ..errors import CorruptionError, UnsupportedFormatError

#: The folder that holds a dataset's or a repository's control records.
CONTROL = ".tidemark"
FORMAT = 1

_ID = re.compile(r"[0-9a-f]{32}\Z")


def new_id() -> str:
    return uuid.uuid4().hex


def is_id(value: Any) -> bool:
    return isinstance(value, str) and _ID.match(value) is not None


def checked_id(value: Any) -> str:
    if not is_id(value):
        raise CorruptionError(f"no operation id: {value!r}")
    return value


def data_path(value: Any) -> str:
    """A path inside a dataset: relative, POSIX, normal, outside control. Else ValueError."""
    if not isinstance(value, str) or "\0" in value or "\\" in value:
        raise ValueError(f"not a data path: {value!r}")
    parts = value.split("/")
    if {"", ".", "..", CONTROL} & set(parts):
        raise ValueError(f"not a data path: {value!r}")
    return value


def name_of(value: Any) -> str:
    if not isinstance(value, str) or not value or "\0" in value:
        raise ValueError("a dataset's name is a text that isn't empty and has no NUL")
    return value


class PathSet:
    """Paths of which none is another or lies below another."""

    def __init__(self) -> None:
        self.paths: dict[str, None] = {}
        self._above: set[str] = set()

    def add(self, path: str) -> str:
        data_path(path)
        parts = path.split("/")
        above = {"/".join(parts[:i]) for i in range(1, len(parts))}
        if path in self.paths or path in self._above or not above.isdisjoint(self.paths):
            raise ValueError(f"two changes meet at {path!r}")
        self.paths[path] = None
        self._above |= above
        return path


def plain(metadata: Any) -> dict[str, Any]:
    """Metadata as it will be read back; later changes by the caller don't reach it."""
    if not isinstance(metadata, dict) or not all(isinstance(k, str) for k in metadata):
        raise ValueError("metadata is a JSON object with text keys")
    return json.loads(json.dumps(metadata, allow_nan=False))


def is_revision(value: Any) -> bool:
    return type(value) is int and value >= 0


class Record:
    """What the records share."""

    def check(self) -> None:
        """Raise ValueError if the fields don't fit together."""

    @classmethod
    def read(cls, value: Any) -> Self:
        try:
            if not isinstance(value, dict) or value.keys() != {f.name for f in fields(cls)}:
                raise ValueError("other fields")
            made = cls(**value)
            made.check()
        except (ValueError, TypeError) as e:
            raise CorruptionError(f"invalid {cls.__name__.lower()} record: {e}") from e
        return made

    def payload(self) -> dict[str, Any]:
        return asdict(self)


@dataclass(frozen=True)
class State(Record):
    """What is published: the revision, who made it, the publication in force, its metadata, what can be undone."""

    revision: int
    operation: str | None
    publication: str | None
    metadata: dict[str, Any]
    undo: str | None

    def check(self) -> None:
        if not is_revision(self.revision):
            raise ValueError("revision")
        for value in (self.operation, self.publication, self.undo):
            if value is not None and not is_id(value):
                raise ValueError("id")
        if (self.revision == 0) is not (self.operation is None):
            raise ValueError("only the first state has no operation")
        if self.undo not in (None, self.publication):
            raise ValueError("only the publication in force can be undone")
        plain(self.metadata)

    def published(self, operation: str, metadata: dict[str, Any], undoable: bool = True) -> State:
        return State(self.revision + 1, operation, operation, metadata, operation if undoable else None)

    def undone(self, operation: str, previous: State) -> State:
        return State(self.revision + 1, operation, previous.publication, previous.metadata, None)


FIRST = State(0, None, None, {}, None)


@dataclass(frozen=True)
class Change(Record):
    """What a publication touched, so that it can be undone."""

    id: str
    before: dict[str, Any]
    entries: list[dict[str, Any]]

    def check(self) -> None:
        checked_id(self.id)
        State.read(self.before)
        if not isinstance(self.entries, list):
            raise ValueError("entries")
        seen = set()
        for e in self.entries:
            if not isinstance(e, dict) or e.keys() != {"path", "existed"} or type(e["existed"]) is not bool:
                raise ValueError("entry")
            if data_path(e["path"]) in seen:
                raise ValueError("a path twice")
            seen.add(e["path"])


@dataclass(frozen=True)
class Swap(Record):
    """Intent of a publication or a rollback: ``source`` names the change record."""

    kind: str
    id: str
    source: str
    before: dict[str, Any]

    def check(self) -> None:
        checked_id(self.id), checked_id(self.source)
        if self.kind not in ("publish", "rollback"):
            raise ValueError("kind")
        before = State.read(self.before)
        if self.kind == "publish" and self.id != self.source:
            raise ValueError("a publication is its own source")
        if self.kind == "rollback" and before.undo != self.source:
            raise ValueError("a rollback undoes the publication in force")


@dataclass(frozen=True)
class Removal(Record):
    """Intent of a prune: all that is needed to go forward."""

    kind: str
    id: str
    before: dict[str, Any]
    metadata: dict[str, Any]
    paths: list[str]
    work: list[str]

    def check(self) -> None:
        checked_id(self.id)
        State.read(self.before), plain(self.metadata)
        if self.kind != "prune" or not isinstance(self.paths, list) or not self.paths or not isinstance(self.work, list):
            raise ValueError("targets")
        targets = PathSet()
        for p in self.paths:
            targets.add(p)
        if len({checked_id(w) for w in self.work}) != len(self.work):
            raise ValueError("work twice")


def intent(value: Any) -> Swap | Removal:
    kind = value.get("kind") if isinstance(value, dict) else None
    return (Removal if kind == "prune" else Swap).read(value)


def expect(record: dict[str, Any], kind: str) -> dict[str, Any]:
    """The record if it is of this format and kind."""
    if record.get("format") != FORMAT or record.get("kind") != kind:
        raise UnsupportedFormatError(f"no {kind} of format {FORMAT}")
    return record
