"""What publications do, as operations on frames of files."""

from .algebra import changed, deleted, obsolete, pruned, published, restored

__all__ = ["changed", "deleted", "obsolete", "pruned", "published", "restored"]
