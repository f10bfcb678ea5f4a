"""Arrow batches in Python workers: bounded slices, list columns and bounded caches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that a worker handles at a time, one row at least.
SLICE_CHARS = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column's values stay under ``most`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's texts, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


@contextmanager
def no_gc() -> Iterator[None]:
    """Without searches for reference cycles, which would go through large memos again and again.

    Only for work that makes no cycles.
    """
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def tidy(run: Callable) -> Callable:
    """The same batches; at a task's end the worker, which may wait long, gives memory back."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return inner


def int_lists(rows: list[bytes]) -> pa.Array:
    """A list<int32> column from the little-endian bytes of each row."""
    ends = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(r) // 4 for r in rows], out=ends[1:])
    values = pa.array(np.frombuffer(b"".join(rows), dtype="<i4"))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def by_words(values: pa.Array, words: Callable[[list[str]], list[bytes | None]], first: Callable[[str], bytes | None]) -> list[bytes | None]:
    """Each text's ids as little-endian 32-bit integers, put together from its words'.

    Texts are cut at each space. ``words`` encodes the distinct words of the batch,
    ``first`` each text's first word; a text with a word for which they give None
    gives None.
    """
    lists = pc.split_pattern(pc.fill_null(values, ""), " ")
    ends, flat = lists.offsets.to_numpy().astype(np.int64), lists.values
    coded = flat.dictionary_encode()
    heads = flat.take(pa.array(ends[:-1])).to_pylist()
    found = words(coded.dictionary.to_pylist()) + [first(w) for w in heads]
    which = coded.indices.to_numpy().astype(np.int64)
    which[ends[:-1]] = len(found) - len(heads) + np.arange(len(heads))
    odd = np.array([f is None for f in found], dtype=bool)
    pool = np.frombuffer(b"".join([f or b"" for f in found]), dtype="<i4")
    sizes = np.array([len(f or b"") // 4 for f in found], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    n = sizes[which]
    till = np.concatenate([[0], np.cumsum(n)])
    raw = pool[np.repeat(starts[which] - till[:-1], n) + np.arange(till[-1])].tobytes()
    bad = np.add.reduceat(odd[which].astype(np.int64), ends[:-1]) > 0
    cuts = 4 * till[ends]
    return [None if b else raw[i:j] for b, i, j in zip(bad, cuts[:-1], cuts[1:], strict=True)]


class Memo(dict):
    """Results of a pure function, in bounded memory.

    There are two generations of up to ``most`` results each. When the young one is
    full it becomes the old one, from which results that are asked for again return.
    """

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        """Give the memory back; a worker may wait long for its next task."""
        self.clear()
        self.old = {}
