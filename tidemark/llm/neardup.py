"""Near-duplicate documents by ProbMinHash, banding and verification.

Texts with the same words are one node. A node's sketch is cut into bands; nodes that
agree in a band share a bucket. All nodes of a bucket are compared with a few of them, its
centres. In buckets whose nodes then still stand in different classes, those outside the
bucket's largest class are compared with all that are in another class than they, block by
block, each pair in the first bucket it shares. Shingles that two blocks have in common
are counted for all pairs at once, by a matrix product; that gives plain sets' similarity
and bounds that of weighted ones. So a large class of near copies costs a comparison or a
few for each copy, and no link between nodes that share a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import probminhash as pm
from .arrow import column, slices, tidy
from .common import fresh, passing, setting, small, table, written
from .components import components

#: Bands and registers of a band: at a similarity of 0.8, 0.9997 of all pairs share a bucket.
BANDS, ROWS = 20, 5

#: The least probability Jaccard similarity of a link.
LEAST = 0.8

#: Centres of a bucket, with which all its nodes are compared.
CENTRES = 3

#: Nodes of a bucket that are compared with others together.
BLOCK = 200

#: Shingles that blocks have in common, counted at a time.
SHINGLES_AT_ONCE = 4096


#: Documents that are sketched at a time: each has some 800 arrivals in memory.
DOCS_AT_ONCE = 400


def _steps(n: int, size: int) -> list[tuple[int, int]]:
    return [(i, min(i + size, n)) for i in range(0, n, size)]


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(np.ascontiguousarray(hashes).tobytes())


def _packed(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def _longs(values: np.ndarray, some: np.ndarray) -> pa.Array:
    """A list<int64> column of the rows of values, empty where not ``some``."""
    ends = np.concatenate([[0], np.cumsum(np.where(some, values.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values[some]).reshape(-1).view(np.int64)))


def sketched(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, node, bands, shingles and weights of each row.

    The node is a 128-bit digest of the text's words, null without words; bands has a
    hash of each band. Shingles and weights are binary; weights are empty where all are 1.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = batch.num_rows
            hashes, ends = pm.words(column(batch, "text"))
            doc, shingle, weight = pm.shingles(hashes, ends)
            at = np.searchsorted(doc, np.arange(n + 1))
            sketch = np.concatenate([
                pm.sketches(doc[at[i] : at[j]] - i, shingle[at[i] : at[j]], weight[at[i] : at[j]], j - i, bands * rows) for i,
                j in _steps(n, DOCS_AT_ONCE)
            ])
            band = np.zeros((n, bands), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for k in range(rows):
                    band = pm.mixed(band + sketch[:, k::rows].astype(np.uint64) + np.uint64(1))
                band = pm.mixed(band + np.arange(bands, dtype=np.uint64))
            some = np.diff(ends) > 0
            nodes = [_digest(hashes[i:j]) if i < j else None for i, j in zip(ends[:-1], ends[1:], strict=True)]
            sets = [_packed(shingle[i:j], "<u4") for i, j in zip(at[:-1], at[1:], strict=True)]
            loads = [_packed(weight[i:j], "<u4") if (weight[i:j] > 1).any() else b"" for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"),
                column(batch, "text_hash"),
                pa.array(nodes, pa.binary()),
                _longs(band, some),
                pa.array(sets, pa.binary()),
                pa.array(loads, pa.binary()),
            ], names=["doc_id", "text_hash", "node", "bands", "shingles", "weights"])

    rows_in = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), "text")
    return rows_in.mapInArrow(tidy(run), f"doc_id {kind}, text_hash long, node binary, bands array<bigint>, shingles binary, weights binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs a, b those whose sets are similar enough."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"), F.col("weights").alias(f"w{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, wa, sb, wb in (tuple(column(batch, c)[i].as_py() for c in ("sa", "wa", "sb", "wb")) for i in range(batch.num_rows)):
                a, b = np.frombuffer(sa, "<u4"), np.frombuffer(sb, "<u4")
                fa = np.frombuffer(wa, "<u4") if wa else np.ones(len(a))
                fb = np.frombuffer(wb, "<u4") if wb else np.ones(len(b))
                keep.append(pm.similarity(a, fa, b, fb) >= least - 1e-9)  # a sum of fractions may round
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield out

    return rows.select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(tidy(run), "a binary, b binary")


def linked(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """node, root of all nodes, from sketched rows; a node without links is its own root."""
    spark = rows.sparkSession
    known = rows.where(F.col("node").isNotNull())
    # One row for each node; a node's rows combine on the map side.
    nodes = known.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "bands")).alias("r")).select("node", "r.*")
    nodes = written(nodes, "nodes")
    each = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    centres = [F.min_by("node", F.xxhash64(F.lit(i), "node")) for i in range(CENTRES)]
    shared = written(
        each.groupBy("bucket").agg(F.array_distinct(F.array(*centres)).alias("centres"), F.count("*").alias("n")).where(F.col("n") > 1),
        "buckets",
    )
    pairs = each.join(shared, "bucket").select("node", F.explode("centres").alias("centre")).where(F.col("node") != F.col("centre"))
    pairs = written(pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "pairs")
    # A pair's nodes are all that are ever compared: whoever shares a bucket has its centres.
    asked = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    asked = nodes.select("node", "doc_id", "text_hash").join(asked, "node")
    same = (F.col("k.node") == F.col("r.node")) & F.col("k.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("k.text_hash") == F.col("r.text_hash"))
    sets = asked.alias("k").join(known.alias("r"), same).select("r.node", "r.shingles", "r.weights").groupBy("node").agg(F.min(F.struct("shingles", "weights")).alias("s")).select("node", "s.*")
    sets = written(sets, "sets", compression="lz4_raw")
    roots = written(components(written(_verified(pairs, sets, least), "verified")), "classes")
    roots = written(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    # Buckets up to one more than their centres are done. In others, pairs that no centre's test has joined.
    now = each.join(shared.where(F.col("n") > CENTRES + 1).select("bucket"), "bucket").join(roots, "node").select("bucket", "band", "node", "root")
    now = written(now, "members")
    sizes = now.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    open_ = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max("k").alias("n_main"), F.sum("k").alias("n"))
    open_ = small(written(open_.where(F.col("n") > F.col("n_main")), "open"))
    left = now.join(open_, "bucket").join(nodes.select("node", "bands"), "node").join(sets, "node")
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "20"):  # each row holds two blocks' shingles
        more = written(_within(left, least), "verified")
    if not more.head(1):
        return roots
    joined = written(components(more), "classes").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return written(roots.join(small(joined), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")


def _within(members: DataFrame, least: float) -> DataFrame:
    """Links a, b between classes of a bucket's members, whose largest one is ``main``.

    A bucket's members are dealt into blocks of about BLOCK, those of the main class and
    the others apart, and blocks of others are compared with all blocks: nothing is made
    for each pair, and no two blocks of the main class meet. Two nodes are compared in
    the first bucket they share, if their classes differ, also after the links found so far.
    """
    main = (F.col("root") == F.col("main")).alias("is_main")
    n = F.when(F.col("root") == F.col("main"), F.col("n_main")).otherwise(F.col("n") - F.col("n_main"))
    block = F.pmod(F.xxhash64("node"), F.ceil(n / BLOCK)).alias("block")
    blocks = members.groupBy("bucket", "band", main, block).agg(F.collect_list(F.struct("node", "root", "bands", "shingles", "weights")).alias("m"))
    blocks = written(blocks, "blocks", compression="lz4_raw")
    x, y = blocks.where(~F.col("is_main")).alias("x"), blocks.alias("y")
    both = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("y.is_main") | (F.col("x.block") <= F.col("y.block"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _block_links(
                    column(batch, "band")[i].as_py(),
                    *(Block.of(column(batch, c)[i].values) for c in ("one", "other")),
                    column(batch, "own")[i].as_py(),
                    least,
                )
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    own = (~F.col("y.is_main") & (F.col("x.block") == F.col("y.block"))).alias("own")
    return both.select(
        F.col("x.band").alias("band"),
        F.col("x.m").alias("one"),
        F.col("y.m").alias("other"),
        own,
    ).mapInArrow(tidy(run), "a binary, b binary")


@dataclass(frozen=True)
class Block:
    """Nodes with their classes (root), band hashes and weighted shingles."""

    nodes: list[bytes]
    roots: list[bytes]
    bands: np.ndarray
    sets: list[tuple[np.ndarray, np.ndarray | None]]

    @staticmethod
    def of(members: pa.StructArray) -> Block:
        node, root, bands, shingles, weights = members.flatten()
        sets = [
            (np.frombuffer(s, "<u4"), np.frombuffer(w, "<u4") if w else None) for s,
            w in zip(shingles.to_pylist(), weights.to_pylist(), strict=True)
        ]
        return Block(node.to_pylist(), root.to_pylist(), bands.flatten().to_numpy().reshape(len(node), -1), sets)

    def of_rows(self, rows: np.ndarray) -> Block:
        at = np.flatnonzero(rows).tolist()
        return Block([self.nodes[i] for i in at], [self.roots[i] for i in at], self.bands[rows], [self.sets[i] for i in at])


def _block_links(band: int, one: Block, other: Block, own: bool, least: float) -> list[tuple[bytes, bytes]]:
    """Links a, b of classes (root) that a pair of nodes of two blocks of a bucket joins; ``own`` if both are one block."""
    ids: dict[bytes, int] = {}
    roots = [np.array([ids.setdefault(r, len(ids)) for r in side.roots]) for side in (one, other)]
    worth = (roots[0][:, None] != roots[1][None, :]) & (one.bands[:, band, None] == other.bands[None, :, band])
    for k in range(band):
        worth &= one.bands[:, k, None] != other.bands[None, :, k]
    if own:  # a block with itself: each pair once
        worth = np.triu(worth, 1)
    if not worth.any():
        return []
    rows, columns = worth.any(axis=1), worth.any(axis=0)
    one, other, worth = one.of_rows(rows), other.of_rows(columns), worth[rows][:, columns]
    most = _most(one.sets, other.sets)
    worth &= most >= least - 1e-6
    at = np.argwhere(worth)
    above: dict[bytes, bytes] = {}

    def top(root: bytes) -> bytes:
        while root in above:
            root = above[root]
        return root

    found = []
    # The likeliest first: their links spare the rest a comparison.
    for i, j in at[np.argsort(-most[worth], kind="stable")].tolist():
        p, q = top(one.roots[i]), top(other.roots[j])
        if p != q and _similarity(one.sets[i], other.sets[j]) >= least - 1e-9:
            found.append((one.roots[i], other.roots[j]))
            above[max(p, q)] = min(p, q)
    return found


def _similarity(a: tuple[np.ndarray, np.ndarray | None], b: tuple[np.ndarray, np.ndarray | None]) -> float:
    wa, wb = (np.ones(len(v)) if w is None else w for v, w in (a, b))
    return pm.similarity(a[0], wa, b[0], wb)


def _most(one: list[tuple], other: list[tuple]) -> np.ndarray:
    """What no similarity of a set of one block with a set of the other exceeds; it is the similarity of plain sets.

    Of weighted sets it is the share of either set's weight that lies in shingles of both:
    each term of the similarity is at most the shingle's share of either set's weight.
    """
    flat = [np.concatenate([v for v, _ in side]) for side in (one, other)]
    both = np.intersect1d(*flat)
    plain = [np.array([w is None for _, w in side]) for side in (one, other)]
    mixed = not (plain[0].all() and plain[1].all())
    count, common = np.zeros((len(one), len(other))), np.zeros((2, len(one), len(other)))
    every = []
    for side, values in zip((one, other), flat, strict=True):
        row = np.repeat(np.arange(len(side)), [len(v) for v, _ in side])
        share = np.concatenate([np.full(len(v), 1 / len(v)) if w is None else w / w.sum() for v, w in side])
        at = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        known = both[at] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(at[known], kind="stable")
        every.append([x[known][order] for x in (at, row, share)])
    for start in range(0, len(both), SHINGLES_AT_ONCE):
        width = min(SHINGLES_AT_ONCE, len(both) - start)
        has, shares = [], []
        for side, (at, row, share) in zip((one, other), every, strict=True):
            i, j = np.searchsorted(at, [start, start + width])
            has.append(np.zeros((len(side), width), np.float32))
            has[-1][row[i:j], at[i:j] - start] = 1
            if mixed:
                shares.append(np.zeros((len(side), width), np.float32))
                shares[-1][row[i:j], at[i:j] - start] = share[i:j]
        count += has[0] @ has[1].T
        if mixed:
            common += shares[0] @ has[1].T, has[0] @ shares[1].T
    size = [np.array([len(v) for v, _ in side]) for side in (one, other)]
    exact = count / (size[0][:, None] + size[1][None, :] - count)
    return np.where(plain[0][:, None] & plain[1][None, :], exact, common.min(axis=0)) if mixed else exact


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, class_id, class_hash, representative.

    Documents are in one class if a chain of links joins them: equal words, or word
    shingles of a probability Jaccard similarity of ``least`` or more. class_id is the
    smallest doc_id of the class, class_hash tells rows of that doc_id apart, and
    ``representative`` is true for its row, and for repeats of that row. A text without
    words, null among them, is in a class of its own. Only doc_id and text are read.
    """
    rows = written(sketched(docs), "sketches", compression="lz4_raw")
    roots = linked(rows, least)
    slim = rows.select("doc_id", "text_hash", "node")
    own = slim.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    own = own.join(roots, "node").select("node", "root", "first")
    low = small(written(own.groupBy("root").agg(F.min("first").alias("class")), "lowest"))
    known = written(own.join(low, "root").select("node", "class"), "node-classes")
    out = slim.join(known, "node", "left").select("doc_id", "text_hash", F.coalesce("class", F.struct("doc_id", "text_hash")).alias("class"))
    return out.select(
        "doc_id",
        "text_hash",
        F.col("class.doc_id").alias("class_id"),
        F.col("class.text_hash").alias("class_hash"),
        F.struct("doc_id", "text_hash").eqNullSafe(F.col("class")).alias("representative"),
    )


def kept(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of docs for each class: the one of smallest doc_id, with all its columns.

    Of rows of that doc_id the one of smallest text hash stays, and one of repeats. Texts
    without words, null ones among them, are classes of their own; an empty table stays
    empty. Columns of any name may stand beside.
    """
    with passing(docs.sparkSession) as keep:
        keep.append(written(classes(docs, least), "near-classes"))
    found = keep[0]
    own, other = fresh(docs, "row_key"), fresh(docs, "found_key")
    key = F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).alias(other)
    gone = small(written(found.where(~F.col("representative")).select(key).distinct(), "near-gone"))
    rows = docs.withColumn(own, F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash")))
    left = rows.join(gone, F.col(own) == F.col(other), "left_anti")
    # Rows that repeat a representative word for word: one of them stays.
    twice = found.where(F.col("representative")).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(key)
    if twice.head(1):
        one = left.join(twice, F.col(own) == F.col(other), "left_semi").dropDuplicates([own])
        left = left.join(twice, F.col(own) == F.col(other), "left_anti").unionAll(one)
    return left.drop(own)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document, by its smallest doc_id; texts without words are alone."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
