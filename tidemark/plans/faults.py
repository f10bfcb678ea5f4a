"""Stopping an operation at a chosen durable step."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from ..control import disk


class Stopped(BaseException):
    """Stands for the process's death: no handler of ordinary errors sees it."""


@dataclass
class Steps:
    """How many primitives ran, and which."""

    done: list[str]


@contextmanager
def stopping(at: int | None = None, after: bool = False, only: str | None = None) -> Iterator[Steps]:
    """Raise Stopped at the at-th call (from 0) of a primitive, before or after it takes effect.

    With ``only`` calls of one primitive are counted; without ``at`` all calls are
    counted and none stops.
    """
    steps = Steps([])
    real = {name: getattr(disk, name) for name in disk.PRIMITIVES}
    depth = 0

    def wrap(name):
        def call(*args):
            nonlocal depth
            if depth or (only and name != only):  # a primitive inside another is part of it
                return real[name](*args)
            n = len(steps.done)
            steps.done.append(name)
            if n == at and not after:
                raise Stopped(f"before {name}")
            depth += 1
            try:
                out = real[name](*args)
            finally:
                depth -= 1
            if n == at:
                raise Stopped(f"after {name}")
            return out

        return call

    for name in real:
        setattr(disk, name, wrap(name))
    try:
        yield steps
    finally:
        for name, function in real.items():
            setattr(disk, name, function)
