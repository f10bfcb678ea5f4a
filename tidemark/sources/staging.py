"""Frames into batches: executors write and copy, the driver moves files and names.

The folder must be on a file system that driver and executors share.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..control import disk
from ..control.records import State
from ..dataset import Batch, Dataset
from .tables import refresh


#: Bytes of the files that an operation copies from which on Spark's tasks copy them.
SPREAD_BYTES = 64 << 20


def spread(spark: SparkSession, dataset: Dataset, least: int = SPREAD_BYTES) -> Dataset:
    """The dataset, whose operations let Spark's tasks copy files of ``least`` bytes or more in all.

    A file is copied by one task, durably, before any file of the dataset moves; a task
    that is repeated copies it again. Smaller changes are copied by the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                disk.duplicate(Path(source), Path(target))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    def copies(pairs: list[tuple[Path, Path]]) -> None:
        if not pairs or sum(os.path.getsize(source) for source, _ in pairs) < least:
            disk.duplicate_all(pairs)
            return
        disk.make_folders(target for _, target in pairs)
        names = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "source string, target string")
        tasks = min(len(pairs), 4 * spark.sparkContext.defaultParallelism)
        done = names.repartition(tasks).mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
        if done != len(pairs):
            raise OSError(f"{done} of {len(pairs)} files were copied")
        for folder in sorted({target.parent for _, target in pairs}):
            disk.flush_folder(folder)

    dataset.copies = copies
    return dataset


def stage_frame(
    batch: Batch,
    df: DataFrame,
    partition_by: list[str] | None = None,
    file: str = "data",
    format: str = "parquet",
    files: int = 1,
    **options: str,
) -> list[str]:
    """Stage a frame's rows as complete files, one for each partition, and return their paths.

    Rows are dealt by the partition columns, so each file is written by one task. Where a
    partition is too large for that, ``files`` deals its rows to up to as many tasks and files.
    Names are ``file.format``, or ``file-00000.format`` and so on. Partition folders keep
    the names that Spark gave them; one that Spark would hide is refused.
    """
    keys = partition_by or []
    place = batch.work / f"spark-{len(batch._staged)}"
    if files > 1 and not keys:
        dealt = df.repartition(files)
    elif files > 1:
        # Salted by the whole row: a hot partition becomes that many tasks.
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(files)).alias("_salt")
        n = max(files, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = df.select("*", salt).repartition(n, *keys, "_salt").drop("_salt")
    else:
        dealt = df.repartition(*keys) if keys else df.repartition(1)  # what is upstream keeps its tasks
    writer = dealt.write.format(format).options(**options)
    (writer.partitionBy(*keys) if keys else writer).save(str(place))
    return harvest(batch, place, file, format)


def harvest(batch: Batch, place: Path, file: str, format: str) -> list[str]:
    """Move the part files that Spark wrote into the batch, without its other files."""
    staged = []
    for folder, _, names in sorted(os.walk(place)):
        parts = sorted(n for n in names if n.startswith("part-"))
        inside = Path(folder).relative_to(place)
        if parts and any(p[0] in "._" for p in inside.parts):
            raise ValueError(f"Spark would not list {inside}")
        for i, name in enumerate(parts):
            plain = f"{file}.{format}" if len(parts) == 1 else f"{file}-{i:05}.{format}"
            path = (inside / plain).as_posix()
            os.replace(Path(folder) / name, batch.stage(path))
            staged.append(path)
    disk.discard_tree(place)
    return staged


def publish(
    spark: SparkSession,
    dataset: Dataset,
    df: DataFrame | None,
    *,
    metadata: dict[str, Any],
    quiescent: bool,
    partition_by: list[str] | None = None,
    delete: list[str] | None = None,
    expected_revision: int | None = None,
    **staging: Any,
) -> State:
    """Stage a frame and deletions, commit, and drop what the session has cached.

    Copies of replaced files are made by tasks if they are large.
    """
    if dataset.copies is None:
        spread(spark, dataset)
    with dataset.write(expected_revision=expected_revision) as batch:
        if df is not None:
            stage_frame(batch, df, partition_by, **staging)
        for path in delete or []:
            batch.delete(path)
        state = batch.commit(metadata=metadata, quiescent=quiescent)
    refresh(spark, dataset)
    return state


def rollback(spark: SparkSession, dataset: Dataset, *, quiescent: bool, expected_revision: int | None = None) -> State:
    """Undo the publication in force, with copies made by tasks if they are large, and drop what the session has cached."""
    if dataset.copies is None:
        spread(spark, dataset)
    state = dataset.rollback(quiescent=quiescent, expected_revision=expected_revision)
    refresh(spark, dataset)
    return state
