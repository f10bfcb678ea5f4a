"""The relational form of publishing, undoing and pruning.

A dataset is a frame with a column ``path``; whatever else a row holds goes with it. The
driver's control plane does the same to folders; these forms answer what a change would
do, and the tests compare the two. Changed paths are few beside a dataset's, so Spark
broadcasts them by their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import below


def published(base: DataFrame, staged: DataFrame, gone: DataFrame) -> DataFrame:
    """Base files without the replaced and deleted ones, and the staged ones."""
    touched = staged.select("path").unionByName(gone.select("path"))
    return base.join(touched, "path", "left_anti").unionByName(staged)


def deleted(base: DataFrame, gone: DataFrame) -> DataFrame:
    return base.join(gone.select("path"), "path", "left_anti")


def pruned(base: DataFrame, targets: list[str]) -> DataFrame:
    """Base files that are no target and lie below none."""
    return base.where(~below(F.col("path"), targets))


def restored(current: DataFrame, entries: DataFrame, kept: DataFrame) -> DataFrame:
    """Current files as before a change: what it touched is taken out, what it kept comes back."""
    return current.join(entries.select("path"), "path", "left_anti").unionByName(kept)


def changed(base: DataFrame, after: DataFrame, value: str) -> DataFrame:
    """path and change (added, deleted, replaced) of files that differ in ``value``."""
    both = base.select("path", F.col(value).alias("old"), F.lit(True).alias("was")).join(
        after.select("path", F.col(value).alias("new"), F.lit(True).alias("is")),
        "path",
        "full",
    )
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "replaced")
    return both.select("path", kind.alias("change")).where(F.col("change").isNotNull())


def obsolete(work: DataFrame, undo: str | None) -> DataFrame:
    """Ids of operations that no undo needs, ascending."""
    return work.where(~F.col("id").eqNullSafe(F.lit(undo))).orderBy("id")
