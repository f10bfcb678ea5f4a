"""Reading datasets with Spark and staging what Spark has written."""

from .staging import publish, rollback, spread, stage_frame
from .tables import datasets_frame, inventory, numbered, read, refresh, state_frame, steady

__all__ = ["datasets_frame", "inventory", "numbered", "publish", "read", "refresh", "rollback", "spread", "stage_frame", "state_frame", "steady"]
