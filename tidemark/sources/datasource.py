"""``format("tidemark")``: a Spark data source over a dataset.

Reading plans one task for each file; the option ``only`` prunes files by the values of
partition columns. Spark's own pushdown to Python sources isn't used: Spark keeps what a
filtered scan has planned and would reuse it for a later scan of the same frame without
the filter. Writing stages one file for each task and publishes all of them in one commit
on the driver; a failed job publishes nothing. ``spark.read.parquet`` remains the faster
reader; this one refuses a dataset with an operation under way at planning time.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from ..control import disk
from ..control.records import CONTROL, new_id
from ..dataset import Dataset


#: What Hive and Spark write for a null in a path.
NULL = "__HIVE_DEFAULT_PARTITION__"


def _values(path: str) -> dict[str, str | None]:
    """Partition columns of a path, as text or null."""
    pairs = (p.partition("=") for p in path.split("/")[:-1])
    return {k: None if v == NULL else unquote(v) for k, sign, v in pairs if sign}


def _files(root: Path) -> list[str]:
    found = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f != CONTROL and f[0] not in "._")
        found += [(Path(folder) / n).relative_to(root).as_posix() for n in sorted(names) if n[0] not in "._"]
    return found


class TidemarkSource(DataSource):
    """Options: ``path``, the dataset's folder, and ``name``; for reading ``only``, a JSON object of
    partition columns and the value (or null) that files must have; for writing ``file`` and
    ``metadata`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def _dataset(self) -> Dataset:
        return Dataset(self.options["path"], self.options["name"])

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        root = self._dataset().root
        files = _files(root)
        if not files:
            raise FileNotFoundError("no files; give a schema")
        keys = list(_values(files[0]))
        if any(list(_values(f)) != keys for f in files):
            raise ValueError("files with other partition columns; give a schema")
        # Columns that came later stand in the last file; a file without one gives nulls.
        inner = {f.name: f for place in (files[-1], files[0]) for f in from_arrow_schema(pq.read_schema(root / place)).fields}
        return StructType([*inner.values(), *(StructField(k, StringType()) for k in keys)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._dataset(), schema, json.loads(self.options.get("only", "{}")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        dataset = self._dataset()
        return _Writer(
            str(dataset.root),
            dataset.name,
            new_id(),
            self.options.get("file", "data"),
            json.loads(self.options.get("metadata", "{}")),
            self.options.get("quiescent") == "true",
        )


@dataclass
class _File(InputPartition):
    path: str
    values: dict[str, str | None]


class _Reader(DataSourceReader):
    def __init__(self, dataset: Dataset, schema: StructType, only: dict[str, str | None]):
        self.root, self.name, self.schema, self.only = str(dataset.root), dataset.name, schema, only

    def partitions(self) -> list[InputPartition]:
        Dataset(self.root, self.name).current()
        files = [_File(p, _values(p)) for p in _files(Path(self.root))]
        return [f for f in files if all(k in f.values and f.values[k] == v for k, v in self.only.items())]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read no files
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        file = pq.ParquetFile(Path(self.root) / partition.path)
        there = set(file.schema_arrow.names)
        names, kinds = [f.name for f in self.schema.fields], to_arrow_schema(self.schema)
        inner = [n for n in names if n not in partition.values and n in there]

        def value(batch: pa.RecordBatch, name: str) -> pa.Array:
            if name in partition.values:
                return pa.array([partition.values[name]] * batch.num_rows, pa.string())
            at = batch.schema.get_field_index(name)
            return pa.nulls(batch.num_rows, kinds.field(name).type) if at < 0 else batch.column(at)

        for batch in file.iter_batches(columns=inner):
            yield pa.RecordBatch.from_arrays([value(batch, n) for n in names], names=names)


@dataclass
class _Staged(WriterCommitMessage):
    file: str | None


class _Writer(DataSourceArrowWriter):
    """Tasks write into the work folder of an operation to be; the driver publishes."""

    def __init__(self, root: str, name: str, operation: str, file: str, metadata: dict, quiescent: bool):
        self.root, self.name, self.operation, self.file, self.metadata, self.quiescent = root, name, operation, file, metadata, quiescent

    @property
    def work(self) -> Path:
        return Path(self.root) / CONTROL / "work" / self.operation

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        place = self.work / f"{task.partitionId():05}-{task.taskAttemptId()}.parquet"
        out = None
        for batch in iterator:
            if out is None:
                place.parent.mkdir(parents=True, exist_ok=True)
                out = pq.ParquetWriter(place, batch.schema)
            out.write_batch(batch)
        if out is not None:
            out.close()
        return _Staged(None if out is None else place.name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        dataset = Dataset(self.root, self.name)
        files = sorted(m.file for m in messages if m is not None and m.file)
        with dataset.write() as batch:
            for i, f in enumerate(files):
                os.replace(self.work / f, batch.stage(f"{self.file}-{i:05}.parquet"))
            batch.commit(metadata=self.metadata, quiescent=self.quiescent)
        disk.discard_tree(self.work)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        disk.discard_tree(self.work)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(TidemarkSource)
