"""Datasets made from the test tables, in a folder of their own that lasts until the driver ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..repository import Repository
from ..sources import publish, read

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def local_path(spark: SparkSession, folder: str) -> Path | None:
    """Where a folder lies that Spark is given as a plain path, file:/ or file:///, or None if in another store."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    path = hadoop.Path(folder)
    scheme = path.toUri().getScheme() or hadoop.FileSystem.getDefaultUri(conf).getScheme()
    return Path(path.getFileSystem(conf).makeQualified(path).toUri().getPath()) if scheme == "file" else None


class Lab:
    """A repository with a dataset ``market`` of events by date, and helpers to change it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        parent = local_path(spark, shared) if shared else None
        if parent is None and not f"{spark.sparkContext.master}[".startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder on a file system that driver and executors mount")
        if parent:
            parent.mkdir(parents=True, exist_ok=True)
        self.folder = Path(tempfile.mkdtemp(prefix="tidemark-lab-", dir=parent))
        atexit.register(shutil.rmtree, self.folder, True)
        self.repository = Repository(self.folder / "repository")
        self.repository.initialize()
        self.market = self.create("market")

    def create(self, name: str) -> Dataset:
        return self.repository.create_dataset(name, self.folder / "data" / name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def events(self) -> DataFrame:
        """All events of the table, with their date."""
        return self.table("events").select(*EVENT_COLUMNS).withColumn("date", F.to_date("ts"))

    def days(self, first: int, last: int, plus: float = 0) -> DataFrame:
        """Events of January 2024 from the first to the last day, values raised by ``plus``: a revision."""
        span = [F.lit(f"2024-01-{n:02}").cast("date") for n in (first, last)]
        events = self.events().where(F.col("date").between(*span))
        return events.withColumn("value", F.col("value") + F.lit(float(plus))) if plus else events

    def put(
        self,
        frame: DataFrame | None,
        batch: int,
        delete: list[str] | None = None,
        dataset: Dataset | None = None,
        keys: list[str] | None = None,
    ):
        return publish(
            self.spark,
            dataset or self.market,
            frame,
            metadata={"batch": batch},
            quiescent=True,
            partition_by=keys or ["date"],
            delete=delete,
        )

    def base(self) -> Lab:
        """All events, by date."""
        self.put(self.events(), 1)
        return self

    def revised(self) -> Lab:
        """All events, and then days 8 to 12 of January 2024 replaced."""
        self.base().put(self.days(8, 12, 1000), 2)
        return self

    def rows(self, **options) -> DataFrame:
        return read(self.spark, self.market, **options).select(*EVENT_COLUMNS, "date")


def day(n: int) -> str:
    return f"date=2024-01-{n:02}/data.parquet"
