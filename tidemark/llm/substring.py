"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts each text where its leading bits are
zero, so cuts depend on the text near them alone and an insertion moves no cut behind
it. Chunks are deduplicated by a digest of 128 bits: the first chunk of a digest stays,
each later one is a repeat, in another document or in the same. Repeats that follow each
other form passages; long passages are reported and can be removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow import column, no_gc, slices, texts, tidy
from .common import fresh, small, table, written

#: Bytes that the hash sees, and the zero bits that make a cut.
WINDOW, CUT_BITS = 16, 5

#: Bytes of a chunk at least, and at most where no cut is found. 16 + 2^5 bytes on average.
LEAST, MOST = 16, 256

#: Characters of following repeats that make a passage. The first chunk inside a repeated
#: passage starts some 50 bytes behind the passage's start, and the last ends as
#: much before its end, so passages of 50 words are found and single short lines aren't.
PASSAGE = 96

#: A fixed random number for each byte value.
GEAR = np.random.default_rng(20_231).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(raw: np.ndarray) -> np.ndarray:
    """The rolling hash behind each byte: h = 2 h + GEAR[byte] over the last 16 bytes.

    Sums over 2, 4, 8 and 16 bytes are built from those over half as many.
    """
    h = GEAR[raw]
    width = 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint16(width)
        h = longer
        width *= 2
    return h


def cuts(raw: np.ndarray) -> list[int]:
    """Ends of a text's chunks, in bytes; never inside a character."""
    n = len(raw)
    if not n:
        return []
    starts = (raw & 0xC0) != 0x80
    zero = (gear(raw) >> np.uint16(16 - CUT_BITS)) == 0
    zero[:-1] &= starts[1:]
    out, last = [], 0
    for at in (np.flatnonzero(zero) + 1).tolist():
        while at - last > MOST:
            last = _forced(starts, last)
            out.append(last)
        if at - last >= LEAST:
            out.append(at)
            last = at
    while n - last > MOST:
        last = _forced(starts, last)
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _forced(starts: np.ndarray, last: int) -> int:
    at = last + MOST
    while not starts[at]:
        at -= 1
    return at


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and text: what tells one document from others, whether or not ids repeat."""
    return docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), "text")


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end (code points, end exclusive), and digest in two longs of each chunk of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in slices(batches):
            counts, starts, ends, digests = [], [], [], []
            with no_gc():
                for text in texts(batch):
                    data = text.encode()
                    raw = np.frombuffer(data, np.uint8)
                    at = cuts(raw)
                    counts.append(len(at))
                    digests.extend([digest(data[i:j]) for i, j in zip([0, *at[:-1]], at, strict=True)] if at else [])
                    bounds = np.array([0, *at], dtype=np.int64)
                    if len(text) != len(data):
                        bounds = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds]
                    starts.append(bounds[:-1])
                    ends.append(bounds[1:])
            which = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            ints = lambda parts: pa.array(np.concatenate(parts).astype(np.int32))
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id").take(which),
                column(batch, "text_hash").take(which),
                ints(starts),
                ints(ends),
                *(pa.array(np.ascontiguousarray(x)) for x in both.T),
            ], names=["doc_id", "text_hash", "start", "end", "digest", "digest2"])

    return _identified(docs).mapInArrow(tidy(run), f"doc_id {kind}, text_hash long, start int, end int, digest long, digest2 long")


def _passages(docs: DataFrame, least: int) -> DataFrame:
    cut = written(chunks(docs), "chunks", compression="lz4_raw")
    # Half a digest finds what may repeat, a small part; the rest compares whole digests.
    maybe = cut.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("digest")
    maybe = small(written(maybe, "maybe"))  # a plain table, so that Spark can split the join on a digest that is everywhere
    again = written(cut.join(maybe, "digest"), "repeats", compression="lz4_raw")
    place = F.struct("doc_id", "text_hash", "start")
    first = small(written(again.groupBy("digest", "digest2").agg(F.min(place).alias("first")), "firsts"))
    later = again.join(first, ["digest", "digest2"]).where(place != F.col("first"))
    # Rows that repeat a document word for word have the same chunks.
    later = later.select("doc_id", "text_hash", "start", "end", F.struct(F.col("first.doc_id")).alias("first")).distinct()
    own = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    run = F.sum(F.when(F.lag("end").over(own) == F.col("start"), 0).otherwise(1)).over(own)
    runs = later.withColumn("run", run).groupBy("doc_id", "text_hash", "run")
    found = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.min("first").alias("first"))
    found = found.where(F.col("end") - F.col("start") >= least)
    return found.select(
        "doc_id",
        "text_hash",
        "start",
        "end",
        (F.col("end") - F.col("start")).alias("size"),
        F.col("n_chunks").cast("int").alias("n_chunks"),
        F.col("first.doc_id").alias("first_doc_id"),
    )


def passages(docs: DataFrame, least: int = PASSAGE) -> DataFrame:
    """Repeated passages: doc_id, start, end, size (code points), n_chunks, first_doc_id.

    Of chunks of one digest that of smallest doc_id, then text hash, then start is the
    first; the others are repeats, also in the same text. first_doc_id is the smallest
    id of a passage's firsts. Who has a passage first keeps it and gives no row for it.
    Null and empty texts have no chunks, null doc_ids stand before all others, texts of
    one doc_id are documents of their own, and repeated rows count as one document. An
    empty table gives none.

    Counting digests combines on the map side; in the joins a digest that is everywhere
    is split by Spark's skew handling. What meets in one task is one text's repeats.
    """
    return _passages(docs, least).drop("text_hash")


def deduplicated(docs: DataFrame, least: int = PASSAGE) -> DataFrame:
    """docs without their repeated passages; all columns stay, a whole repeat leaves an empty text.

    Null texts stay null and repeated rows stay repeated. Columns of any name may stand beside.
    """
    own, key, cut = (fresh(docs, c) for c in ("row_key", "cut_key", "cut"))
    gone = _passages(docs, least).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cut))
    gone = gone.select(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).alias(key), cut)
    rows = docs.withColumn(own, F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash")))
    out = rows.join(gone, F.col(own) == F.col(key), "left")

    @F.pandas_udf("string")
    def left(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([
            t if s is None else "".join(t[i:j] for i, j in zip([0, *e], [*s, len(t)], strict=True)) for t,
            s,
            e in zip(text, starts, ends, strict=True)
        ], dtype=object)

    new = F.when(F.col(cut).isNull() | F.col("text").isNull(), F.col("text")).otherwise(left("text", F.col(cut)["start"], F.col(cut)["end"]))
    return out.select(*(new.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return passages(table(spark, sf_dir, "documents"))
