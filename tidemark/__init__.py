"""Tidemark: publish, undo and analyse Hive-partitioned datasets with Spark."""

from .control.records import State
from .dataset import Batch, Dataset, PruneBatch
from .errors import ConflictError, CorruptionError, NoRollbackError, RecoveryRequiredError, TidemarkError, UnsupportedFormatError
from .repository import Repository

__all__ = [
    "Batch",
    "ConflictError",
    "CorruptionError",
    "Dataset",
    "NoRollbackError",
    "PruneBatch",
    "RecoveryRequiredError",
    "Repository",
    "State",
    "TidemarkError",
    "UnsupportedFormatError",
]
