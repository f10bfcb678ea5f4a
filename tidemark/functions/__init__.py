"""Column functions on data paths."""

from .paths import below, hive_folder, partition_value

__all__ = ["below", "hive_folder", "partition_value"]
