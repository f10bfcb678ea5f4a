"""What the operators share: table access, scratch tables and word rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Strips the same characters that separate words.
WHITE = " \t\n\x0b\x0c\r"

#: Bytes of a batch that a Python worker gets at a time.
BATCH_BYTES = "16m"

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset, as in
    tests on one machine, a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not f"{spark.sparkContext.master}[".startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch
        pass


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            _drop(spark, path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Scratch tables made inside are removed at the end, but for those put into the list."""
    keep: list[DataFrame] = []
    before = len(_made)
    yield keep
    kept = {df._tidemark_path for df in keep}
    for item in _made[before:]:
        if item[1] not in kept:
            _drop(*item)
            _made.remove(item)


def written(df: DataFrame, label: str, batch: str = BATCH_BYTES, **options: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back.

    The table survives lost executors, so later passes don't compute it again.
    Python workers get ``batch`` bytes at a time, or one row.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", batch):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of a table up to which it is broadcast.
BROADCAST_ROWS = 100_000


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the jobs inside, then as it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from the driver, to be joined: broadcast if its count allows.

    Beyond that the join is shuffled, and Spark splits its skewed partitions.
    """
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table if its count allows; else the join is shuffled and skew is split."""
    return F.broadcast(df) if df.count() <= rows else df


def smallest(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of smallest hash of a key column, or all; ties by text.

    Hashes are even, so only rows below a small cut are ordered: the tasks together
    send about twice as many rows as are asked for, however many tasks there are.
    """
    h = F.xxhash64(key)
    total = rows.count()
    share = min(1.0, 2 * most / max(total, 1))
    while share < 1 and rows.where(h < int(share * 2.0**64) - 2**63).count() < most:
        share = min(1.0, 4 * share)
    low = rows if share >= 1 else rows.where(h < int(share * 2.0**64) - 2**63)
    return low.orderBy(h, "text").limit(most)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't use, for operators that add helpers."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
