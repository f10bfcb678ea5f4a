"""A dataset as DataFrames: its rows, its files and its state.

Spark lists files when a frame is built, so frames are built anew after each
publication, and ``refresh`` drops what the session has cached of the old files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..control.records import CONTROL, State
from ..dataset import Dataset
from ..errors import ConflictError
from ..repository import Repository

STATE_SCHEMA = "revision long not null, operation string, publication string, metadata string, undo string"
FILE_SCHEMA = "path string, length long"


def read(
    spark: SparkSession,
    dataset: Dataset,
    pattern: str = "",
    schema: str | StructType | None = None,
    format: str = "parquet",
    **options: str,
) -> DataFrame:
    """The rows of a dataset's files, with its partition columns.

    ``pattern`` is a glob inside the dataset, everything by default; filters on
    partition columns prune files, so it is seldom needed. With a schema a dataset
    without files, never published or rolled back to nothing, gives no rows. An
    operation under way is refused.
    """
    dataset.current()
    found = dataset.root.glob(pattern) if pattern else (p for p in dataset.root.iterdir() if p.name != CONTROL)
    if next((p for p in found if p.is_file() or any(q.is_file() for q in p.rglob("*"))), None) is None:
        if schema is None:
            raise FileNotFoundError(f"no files of {dataset.name!r}; pass a schema to read none as no rows")
        return spark.createDataFrame([], schema)
    reader = spark.read.format(format).option("basePath", str(dataset.root)).options(**options)
    reader = reader if schema is None else reader.schema(schema)
    return reader.load(str(dataset.root / pattern) if pattern else str(dataset.root))


def refresh(spark: SparkSession, dataset: Dataset) -> None:
    """Forget cached listings and blocks of the dataset's files."""
    spark.catalog.refreshByPath(str(dataset.root))


@contextmanager
def steady(dataset: Dataset) -> Iterator[State]:
    """Raise if the dataset changed while the block ran. This detects, it doesn't isolate."""
    before = dataset.current()
    yield before
    if dataset.current() != before:
        raise ConflictError("the dataset changed while it was read")


def inventory(spark: SparkSession, dataset: Dataset, *more: Column) -> DataFrame:
    """path (inside the dataset) and length of each data file that Spark can list.

    ``more`` are further columns over those of Spark's binary files, content among them.
    """
    if not more and not any(p.name != CONTROL for p in dataset.root.iterdir()):
        return spark.createDataFrame([], FILE_SCHEMA)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(dataset.root))
    plain = F.regexp_replace("path", r"^file:/+", "/")
    return files.select(F.substring(plain, len(str(dataset.root)) + 2, 1 << 20).alias("path"), "length", *more)


def state_row(state: State) -> tuple:
    return state.revision, state.operation, state.publication, json.dumps(state.metadata, sort_keys=True), state.undo


def state_frame(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """The state as one row; metadata as JSON text with sorted keys."""
    return spark.createDataFrame([state_row(dataset.current())], STATE_SCHEMA)


def datasets_frame(spark: SparkSession, repository: Repository) -> DataFrame:
    """name of each dataset, without those being removed."""
    return spark.createDataFrame([(n,) for n in repository.list_datasets()], "name string")


def numbered(df: DataFrame, name: str = "place") -> DataFrame:
    """The frame's rows with their place in it, from 1. Rows keep their tasks; one count for each task reaches the driver."""
    spark = df.sparkSession
    own = df.withColumn("_id", F.monotonically_increasing_id())
    task = F.shiftright("_id", 33).cast("int")
    counts = own.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()
    rows, before = [], 0
    for r in counts:
        rows.append((r["task"], before))
        before += r["n"]
    starts = spark.createDataFrame(rows, "_task int, _before long")
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return own.join(F.broadcast(starts), task == F.col("_task")).select(*df.columns, place.alias(name))
