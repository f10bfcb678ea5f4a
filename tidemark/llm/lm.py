"""Language-model scores of whole texts: a count base, and causal self-attention.

Words are counted over all training documents, and each distinct one is cut into subword
ids once. Scoring needs each word's count and ids: those of frequent words, a bounded
number, go to all tasks; the rest of a document's words are cut where they stand and meet
their counts in a shuffled join. The attention model has its classes from the counts of
subword ids over all training documents. It starts from a bounded sample; shards of all
training documents, whose ids are written once, train it further, each by itself, and
their weighted mean scores every text's ids in overlapping windows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from .arrow import Memo, column, no_gc, slices, tidy
from .common import smallest, table, written
from .langid import remainder
from .tokenfile import default_tokenizer, encoder

#: Words whose counts and ids are broadcast at most: some 30 bytes each.
HEAD = 1 << 20

#: Training documents that the attention model starts from: those of the smallest hash.
SAMPLE = 1500

#: Bytes of text that a worker handles at a time.
AT_ONCE = 8_000_000

KEPT_WORDS = 250_000


def words(values: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words, each word's place among them, and where each text's words end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(values, "")))
    flat, ends = lists.values, lists.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    ends = np.concatenate([[0], np.cumsum(full)])[ends]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), ends


def strings(values: pa.Array) -> list[str]:
    """The words as Python strings; Arrow's own list takes several times as long."""
    return values.to_numpy(zero_copy_only=False).tolist()


def hashes(known: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's UTF-8."""
    raw = known.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, raw), dtype=np.uint64, count=len(raw))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (64-bit hash), its text and n over all texts. A batch's counts are combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=AT_ONCE):
            known, which, _ = words(column(batch, "text"))
            n = np.bincount(which, minlength=len(known)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes(known).view(np.int64)), known, pa.array(n)], names=["word", "text", "n"])

    return docs.select("text").mapInArrow(tidy(run), "word long, text string, n long").groupBy("word", "text").agg(F.sum("n").alias("n"))


class Subwords:
    """Subword ids of a word with a space before it, from a byte-level vocabulary's merges."""

    def __init__(self, path: str):
        self.use = encoder(path)
        self.size = len(self.use.raw)
        self.word: Memo = Memo(self.make, KEPT_WORDS)

    def make(self, word: str) -> bytes:
        return self.use.merged("Ġ" + word) if word.isascii() and word.isprintable() else self.use.merged(self.use.lettered(" " + word))


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    return Subwords(path)


def pooled(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words one after another, and where each word's begin and end."""
    return np.frombuffer(b"".join(raw), dtype="<i4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)


def gathered(pool: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the words that stand in a pool some, one after another, and where they begin and end."""
    n = bounds[which + 1] - bounds[which]
    till = np.concatenate([[0], np.cumsum(n)])
    place = np.repeat(bounds[which] - till[:-1], n)
    place += np.arange(till[-1])
    return pool.take(place), till


def packed(values: np.ndarray, till: np.ndarray) -> pa.Array:
    """A binary column of rows of ids as little-endian 32-bit integers."""
    return pa.Array.from_buffers(
        pa.binary(),
        len(till) - 1,
        [None, pa.py_buffer((4 * till).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, dtype="<i4"))],
    )


def unpacked(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a binary column's rows one after another, and where each row's begin and end."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, dtype="<i4", offset=4 * values.offset, count=n + 1).astype(np.int64) // 4
    ids = np.frombuffer(data, dtype="<i4", offset=4 * ends[0], count=ends[-1] - ends[0]) if ends[-1] > ends[0] else np.zeros(0)
    return ids.astype(np.int64), ends - ends[0]


def encoded(counts: DataFrame, tokenizer: str) -> DataFrame:
    """word, n and ids (binary) of each counted word, which is encoded this once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = subwords(tokenizer)
        for batch in batches:
            with no_gc():
                raw = [use.make(w) for w in strings(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "word"), column(batch, "n"), pa.array(raw, pa.binary())], names=["word", "n", "ids"])

    return counts.select("word", "text", "n").mapInArrow(tidy(run), "word long, n long, ids binary")


def id_counts(counts: DataFrame, n_docs: int, size: int) -> np.ndarray:
    """How often each subword id, and the end as the last, stands in the texts whose words are counted.

    A task sends a count for each id at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size)
        for batch in batches:
            ids, till = unpacked(column(batch, "ids"))
            n += np.bincount(ids, weights=np.repeat(column(batch, "n").to_numpy(), np.diff(till)), minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some].astype(np.int64))], names=["id", "n"])

    got = counts.select("n", "ids").mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, dtype=np.int64)
    out[got.column("id").to_numpy()] = got.column("n").to_numpy()
    out[-1] = n_docs
    return out


def fit(docs: DataFrame, tokenizer: str, ids: np.ndarray, sample: int = SAMPLE) -> attention.Model:
    """The model with the classes of ``ids``, counts of ids, trained on the ``sample`` documents of smallest hash.

    One task trains it, as Spark gives its workers a thread each; the driver's numpy
    might spread the small products over all cores and lose time to it.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = subwords(tokenizer)
        streams = []
        for batch in batches:
            known, which, ends = words(column(batch, "text"))
            flat, till = gathered(*pooled([use.make(w) for w in strings(known)]), which)
            streams += [flat[till[i] : till[j]] for i, j in zip(ends[:-1], ends[1:], strict=True)]
        made = attention.fit(streams, use.size, counts=ids)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["model"])

    picked = smallest(docs.select("doc_id", "text"), "doc_id", sample).select("text")
    found = picked.coalesce(1).mapInArrow(tidy(train), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else attention.fit([], subwords(tokenizer).size, counts=ids)


def trained(model: attention.Model, rows: DataFrame) -> attention.Model:
    """The model trained further on all rows' ids, a shard in each task, and the mean of what they made of it.

    An id's row is the mean over the shards that have the id, by how often they have it.
    A task sends a row for each id at most; how many shards there are follows the input.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"v{i}" for i in range(attention.DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in slices(batches, "ids", AT_ONCE):
            now = now or attention.Shard(shared.value)
            now.add(*unpacked(column(batch, "ids")))
        if now is not None:
            at, weight, values = now.done()
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(weight.astype(np.float32)), *[pa.array((weight * v).astype(np.float32)) for v in values.T]],
                names=["at", "weight", *names],
            )

    parts = rows.select("ids").mapInArrow(tidy(run), f"at long, weight float, {', '.join(f'{v} float' for v in names)}")
    got = parts.groupBy("at").agg(*[(F.sum(v) / F.sum("weight")).cast("float").alias(v) for v in names]).toArrow()
    return attention.replaced(model, got.column("at").to_numpy(), np.stack([got.column(v).to_numpy() for v in names], axis=1))


class Head:
    """Counts and ids of the words that stand in the texts most often."""

    def __init__(self, counts: DataFrame, most: int):
        """All words with ``least`` or more, the least count that at most ``most`` words reach."""
        tiers = counts.groupBy("n").agg(F.count("*").alias("words")).groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.sum("words").alias("words")).collect()
        total, self.least = 0, (1 << 20) + 1
        for r in sorted(tiers, key=lambda r: -r["n"]):
            if total + r["words"] > most:
                break
            total, self.least = total + r["words"], r["n"]
        got = counts.where(F.col("n") >= self.least).select("word", "n", "ids").toArrow()
        word = got.column("word").to_numpy().view(np.uint64)
        order = np.argsort(word)
        self.word, self.logs = word[order], np.log10(got.column("n").to_numpy()[order] + 1.0)
        pool, bounds = unpacked(got.column("ids").combine_chunks())
        self.pool, till = gathered(pool, bounds, order)
        self.pool, self.bounds = self.pool.astype(np.int32), till

    def find(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word hash stands, and whether it does. Asked in ascending order, which goes through memory once."""
        if not len(self.word):
            return np.zeros(len(word), np.int64), np.zeros(len(word), bool)
        order = np.argsort(word)
        at = np.empty(len(word), np.int64)
        at[order] = np.minimum(np.searchsorted(self.word, word[order]), len(self.word) - 1)
        return at, self.word[at] == word


def coded(docs: DataFrame, training: Column, tokenizer: str, head: Head, end_log: float) -> DataFrame:
    """One row for each row of docs: doc_id, row, learn, n_tokens, ids, and what of its base is known.

    ``sure`` counts the words that ``head`` has, ``base`` adds up their logs and the
    end's; words and times are the others, by hash.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, use = shared.value, subwords(tokenizer)
        for batch in slices(batches, most=AT_ONCE):
            known, which, ends = words(column(batch, "text"))
            n = batch.num_rows
            word = hashes(known)
            at, found = top.find(word)
            with no_gc():
                pool, bounds = pooled(list(map(use.word.__getitem__, strings(known.filter(pa.array(~found))))))
            # The batch's words: those of the head where they stand there, the others behind it.
            place = np.where(found, at, len(top.word) + np.cumsum(~found) - 1)
            every = np.concatenate([top.bounds, top.bounds[-1] + bounds[1:]])
            local, cut = gathered(np.concatenate([top.pool, pool]), every, place)
            ids, till = gathered(local, cut, which)
            logs = np.where(found, top.logs[at], 0.0) if len(top.logs) else np.zeros(len(word))
            doc = np.repeat(np.arange(n), np.diff(ends))
            base = np.bincount(doc, weights=logs[which], minlength=n) + end_log
            sure = np.bincount(doc, weights=found[which], minlength=n).astype(np.int64)
            # The rest: each document's other words with their number in it.
            rest = ~found[which]
            order = np.lexsort((which[rest], doc[rest]))
            d, w = doc[rest][order], which[rest][order]
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])])) if len(d) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(d))).astype(np.int64)
            offsets = pa.array(np.searchsorted(d[new], np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    column(batch, "row"),
                    column(batch, "learn"),
                    pa.array(np.diff(ends) + 1),
                    pa.array(sure),
                    pa.array(base),
                    packed(ids, till[ends]),
                    pa.ListArray.from_arrays(offsets, pa.array(word[w[new]].view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(times)),
                ],
                names=["doc_id", "row", "learn", "n_tokens", "sure", "base", "ids", "words", "times"],
            )

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce(training, F.lit(False)).alias("learn"), "text")
    return rows.mapInArrow(
        tidy(run),
        f"doc_id {kind}, row long, learn boolean, n_tokens long, sure long, base double, ids binary, words array<bigint>, times array<bigint>",
    )


def scores(rows: DataFrame, model: attention.Model) -> DataFrame:
    """row, score: the model's log10 probability of each row's ids."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", AT_ONCE):
            found = shared.value.log_probs(*unpacked(column(batch, "ids"))) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), pa.array(found)], names=[*kept, "score"])

    kept = [c for c in rows.columns if c != "ids"]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.select(*kept, "ids").mapInArrow(tidy(run), ", ".join([*kinds, "score double"]))


def scored(docs: DataFrame, training: Column, tokenizer: str | None = None, sample: int = SAMPLE, most: int = HEAD) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` tells the rows to learn from. Tokens are words in lower case (A-Z
    alone) and one end for each text; null and empty texts have the end alone. base_score
    adds up log10((c + 1) / (N + V + 1)) for counts c, N tokens and V distinct ones of
    the training rows; score is the log10 probability of the attention model, which all of
    them train. Without a training row N and V are 0 and the model is as it was at first.
    Repeated rows are counted and scored each; an empty table gives none. Only doc_id and
    text are read, beside what ``training`` reads.
    """
    path = tokenizer or default_tokenizer()
    size = subwords(path).size
    learn = docs.where(training)
    counts = written(encoded(written(word_counts(learn), "word-counts"), path), "word-ids")
    n_docs = learn.count()
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = (sums[0] or 0) + n_docs, sums[1] + (n_docs > 0)
    head = Head(counts, most)
    rows = written(coded(docs, training, path, head, float(np.log10(n_docs + 1.0))), "lm-rows", compression="lz4_raw")
    model = fit(learn, path, id_counts(counts, n_docs, size), sample)
    if n_docs:
        model = trained(model, rows.where("learn"))
    each = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        "row",
        F.col("x.words").alias("word"),
        F.col("x.times").alias("times"),
    )
    rare = counts.where(F.col("n") < head.least).select("word", "n")
    tail = each.join(rare, "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_base"),
        F.sum("times").alias("tail_known"),
    )
    out = written(scores(rows.drop("words", "times", "learn"), model), "lm-scores").join(tail, "row", "left")
    floor = F.lit(float(np.log10(total + distinct + 1.0)))
    none = F.lit(0)
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("sure") + F.coalesce("tail_known", none) + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        "score",
    )


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each document; every seventh, by crc32 of its id, is held out of all learning."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 7) == 2
    return scored(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
