"""Column functions on paths inside a dataset, all built in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def below(path: Column, targets: list[str]) -> Column:
    """Whether a path is one of the targets or lies below one."""
    tests = [(path == F.lit(t)) | path.startswith(t + "/") for t in targets]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def partition_value(path: Column, key: str) -> Column:
    """The value of a Hive partition folder ``key=value`` in a path, decoded; null without one."""
    raw = F.regexp_extract(path, rf"(?:^|/){key}=([^/]*)/", 1)
    return F.when(path.rlike(rf"(?:^|/){key}=[^/]*/"), F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))


def hive_folder(*keys: str) -> Column:
    """``a=x/b=y`` from columns of those names."""
    return F.concat_ws("/", *(F.concat(F.lit(k + "="), F.col(k).cast("string")) for k in keys))
