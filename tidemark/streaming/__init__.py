"""A streaming sink. Nothing in the core needs it."""

from .sink import sink

__all__ = ["sink"]
