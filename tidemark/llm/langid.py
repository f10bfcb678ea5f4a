"""Language identification by n-gram filters that hold a bitmask of languages.

A bit-sliced Bloom filter is an array of slots, each a bitmask with a bit for each
language, in as many 64-bit words as the languages need. An n-gram's slots, taken together
by AND, are all languages that contain it, in one look-up for all languages. A text's hits are counted per language, freed of the
share that chance sets, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow import column, slices, texts, tidy
from .common import local, table, written

#: Characters of an n-gram, and what stands around a text and for all that is no letter.
SIZES, GAP = (2, 3, 4), 32

#: Slots of the filter at least, slots for each n-gram of the language that has most, and look-ups of an n-gram.
SLOTS, SPACE, LOOKUPS = 1 << 20, 16, 3

#: Labelled documents of a language that it is fitted on at most: those of the smallest
#: hash. A language's filter stops changing long before. All its n-grams above the
#: limits below are kept, however many they are; languages may be any number.
SAMPLE = 3000

#: An n-gram must be in this many sample documents of the language, and in this share.
LEAST_DOCS, LEAST_SHARE = 2, 0.002

#: And at least this share as often as in the language that has it most: mixed and
#: wrongly labelled documents then don't carry one language's n-grams into another.
LEAST_OF_MOST = 0.2

#: Fixed odd multipliers of the hashes.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def letters(text: str) -> np.ndarray:
    """Code points in lower case, runs of other than letters as one gap, gaps at both ends."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    known, inverse = np.unique(points, return_inverse=True)
    is_letter = np.array([chr(c).isalpha() for c in known], dtype=bool)
    mapped = np.where(is_letter, known, GAP).astype(np.uint64)[inverse]
    mapped = np.concatenate([[GAP], mapped, [GAP]]).astype(np.uint64)
    keep = np.ones(len(mapped), dtype=bool)
    keep[1:] = (mapped[1:] != GAP) | (mapped[:-1] != GAP)
    return mapped[keep]


def grams(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams that have a letter."""
    out = []
    for n in SIZES:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, dtype=np.uint64)
        any_letter = np.zeros(len(h), dtype=bool)
        with np.errstate(over="ignore"):
            for k in range(n):
                part = points[k : len(points) - n + 1 + k]
                h = (h ^ part) * _MIX[0]
                h ^= h >> np.uint64(29)
                any_letter |= part != GAP
            h *= _MIX[1]
            h ^= h >> np.uint64(32)
        out.append(h[any_letter])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def slots(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """The slots of each hash in a filter of some size (a power of two), one array for each look-up."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((hashes + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(LOOKUPS)]


@dataclass(frozen=True)
class Model:
    """Languages in order of their bit, the filter, and each language's chance of a false hit.

    The filter has a row of slots for each 64 languages.
    """

    languages: tuple[str, ...]
    filter: np.ndarray
    false: np.ndarray

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Hits of each language among the hashes."""
        at, out = slots(hashes, self.filter.shape[1]), []
        for word in self.filter:
            mask = word[at[0]]
            for s in at[1:]:
                mask = mask & word[s]
            mask = mask[mask != 0]
            out += [np.count_nonzero(mask & np.uint64(1 << i)) for i in range(min(64, len(self.languages) - len(out)))]
        return np.array(out, dtype=np.float64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; ``und`` and 0 without a letter or without a language.

        Hits that chance would give are taken off: of n n-grams with c hits at a false
        rate f, (c - f n) / (1 - f). The score is the winner's share of what is left of
        all; the first language wins a tie.
        """
        points = letters(text or "")
        if not self.languages or not (points != GAP).any():
            return "und", 0.0
        hashes = grams(points)
        real = np.maximum((self.counts(hashes) - self.false * len(hashes)) / (1 - self.false), 0)
        best = int(real.argmax())
        total = float(real.sum())
        return self.languages[best], float(real[best]) / total if total > 0 else 1 / len(self.languages)


def model_of(found: dict[str, np.ndarray]) -> Model:
    """The filter of each language's n-gram hashes; its false rate from its own fill."""
    names = tuple(sorted(found))
    most = max((len(h) for h in found.values()), default=0)
    size = max(SLOTS, 1 << (SPACE * most - 1).bit_length())
    bits = np.zeros((-(-len(names) // 64), size), dtype=np.uint64)
    fill = np.zeros(len(names))
    for i, name in enumerate(names):
        word, bit = bits[i // 64], np.uint64(1 << i % 64)
        for s in slots(found[name], size):
            word[s] |= bit
        fill[i] = np.count_nonzero(word & bit) / size
    return Model(names, bits, np.minimum(fill**LOOKUPS, 0.99))


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def sampled(rows: DataFrame, sample: int) -> tuple[DataFrame, dict[str, int]]:
    """lang, text: of each language the rows of smallest hash of doc_id, ties by text; and how many they are.

    One pass counts the languages, one takes the rows below a cut of each language,
    twice as many as are asked for or all, and only those are ordered.
    """
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    h, wide = F.xxhash64("doc_id"), 2
    while True:
        cut = {k: (2**63 - 1 if wide * sample >= n else int(wide * sample / n * 2.0**64) - 2**63) for k, n in totals.items()}
        cuts = local(rows.sparkSession, sorted(cut.items()), "lang string, cut long")
        low = written(rows.select("lang", "text", h.alias("h")).join(cuts, "lang").where(F.col("h") <= F.col("cut")).drop("cut"), "langid-low")
        got = {r["lang"]: r["count"] for r in low.groupBy("lang").count().collect()}
        if all(got.get(k, 0) >= min(n, sample) for k, n in totals.items()):
            break
        wide *= 4
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    picked = low.withColumn("order", order).where(F.col("order") <= sample)
    return picked.repartition("lang", F.col("order") % 64).select("lang", "text"), {k: min(n, sample) for k, n in totals.items()}


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn the languages of rows with text and lang.

    Of each language the ``sample`` rows of smallest hash are used, a bounded set that
    no order or partitioning of the rows changes. Their n-grams are counted in many tasks.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", "doc_id")
    picked, totals = sampled(rows, sample)
    if not totals:
        return model_of({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, found = column(batch, "lang").to_pylist(), {}
            for lang, text in zip(langs, texts(batch), strict=True):
                found.setdefault(lang, []).append(np.unique(grams(letters(text))))
            for lang, parts in found.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "h", "n"],
                )

    tops = picked.mapInArrow(tidy(run), "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    sizes = local(rows.sparkSession, sorted(totals.items()), "lang string, docs long")
    tops = tops.join(sizes, "lang").withColumn("share", F.col("n") / F.col("docs"))
    most = F.max("share").over(Window.partitionBy("h"))  # a row for each language at most
    tops = tops.withColumn("most", most).where((F.col("n") >= LEAST_DOCS) & (F.col("share") >= LEAST_SHARE) & (F.col("share") >= LEAST_OF_MOST * F.col("most")))
    got = tops.select("lang", "h").toArrow().sort_by("lang")  # bounded by the sample
    lang, h = got.column("lang").combine_chunks().dictionary_encode(), got.column("h").to_numpy().view(np.uint64)
    which = lang.indices.to_numpy()
    found = {name: h[which == i] for i, name in enumerate(lang.dictionary.to_pylist())}
    return model_of({name: found.get(name, h[:0]) for name in totals})


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score. Only doc_id and text are read.

    Whole texts are used. Null texts and those without a letter are ``und`` with score
    0; a tie goes to the first language by name. Repeated rows give repeated rows, an
    empty table none. The filter, whose size the fit's sample bounds, is broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = shared.value
        for batch in slices(batches):
            found = [use.predict(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document; every fifth, by crc32 of its id, is held out of the fit."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder(F.col("doc_id"), 5) != 0))
    out = predicted(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


