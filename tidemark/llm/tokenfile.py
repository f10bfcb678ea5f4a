"""Token ids in Parquet: list columns, encodings, row groups and page indexes.

A token file is a folder of Parquet files in ascending document order. Ids are a list
column with dictionary encoding (delta encoding where a chunk has too many values for
a dictionary); document id, token count and place stand beside it, so a reader can
take metadata alone, or a range of documents by row group and page index, without
touching other ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import Memo, by_words, column, int_lists, no_gc, slices, tidy
from .common import local, scratch_path, table

KEPT_WORDS = 200_000

#: Bytes of text whose distinct words are looked up together.
WORDS_AT_ONCE = 8_000_000

#: Row groups in bytes, pages in bytes and rows. Page indexes are written with every file.
ROW_GROUP, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000


#: Letters that need no table of Unicode: ASCII and extended Latin.
_L = "A-Za-zÀ-ÖØ-öø-ɏ"

#: Texts whose byte-level parts the pattern below finds: those letters and ASCII without "<".
_PLAIN = regex.compile(rf"[{_L}\t\n\x20-;=-~]+")

#: The pattern of byte-level pre-tokenizers, for such texts.
_PARTS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens:
    """Encodes with the tokenizers library, each distinct word once.

    A byte-level pre-tokenizer never joins what lies before a lone space to what lies
    behind it, so a text's ids are those of its parts. Parts with runs of white space
    stay whole. Where a part has plain letters only, its words go straight to the
    library's merges; others go through the whole library.
    """

    #: Between parts: one space with other than white space on both sides.
    parts = regex.compile(r"(?<=\S)(?= \S)")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        before = self.tokenizer.pre_tokenizer
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.split = isinstance(before, ByteLevel) and not before.add_prefix_space and before.use_regex and self.tokenizer.normalizer is None
        self.split = self.split and all("<" in t.content and " " not in t.content and not (t.lstrip or t.rstrip) for t in added)
        self.merges, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.piece: Memo = Memo(self._piece, KEPT_WORDS // 4)
        self.word: Memo = Memo(self._word, 4 * KEPT_WORDS)
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def lettered(self, piece: str) -> str:
        """A letter for each byte, as the vocabulary has them."""
        return piece.encode().decode("latin-1").translate(self.letters)

    def merged(self, letters: str) -> bytes:
        raw = self.raw
        return b"".join([raw[t.id] for t in self.merges(letters)])

    def _piece(self, piece: str) -> bytes:
        return self.merged(self.lettered(piece))

    def _word(self, word: str) -> bytes | None:
        """Ids of a word behind a space; a stop or comma behind its letters is a part of its own.

        None if the word is empty or has white space at an end: the space before or
        behind it is then no boundary.
        """
        if word.isalpha():
            if word.isascii():
                return self.merged("Ġ" + word)
            if max(word) <= "ɏ":
                return self._piece(" " + word)
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        head, tail = word[:-1], word[-1]
        if tail in ".," and head.isalpha() and (head.isascii() or max(head) <= "ɏ"):
            return self.word[head] + self.piece[tail]
        return self.one(" " + word)

    def all_words(self, words: list[str]) -> list[bytes | None]:
        """Ids of words behind a space; most words are looked up or go straight to the merges."""
        known, merges, raw, out = self.word, self.merges, self.raw, []
        if len(known) > KEPT_WORDS:
            known.old = dict(known)
            known.clear()
        old = known.old
        for w in words:
            ids = known.get(w, 0)
            if ids == 0:
                ids = old.get(w, 0)
                if ids == 0:
                    ids = b"".join([raw[t.id] for t in merges("Ġ" + w)]) if w.isascii() and w.isalpha() else self._word(w)
                known[w] = ids
            out.append(ids)
        return out

    def _first(self, word: str) -> bytes | None:
        return None if not word or word[-1].isspace() else self.one(word)

    def one(self, text: str) -> bytes:
        """A part's ids."""
        if _PLAIN.fullmatch(text):
            found = _PARTS.findall(text)
            return self._piece(text) if len(found) == 1 else b"".join(map(self.piece.__getitem__, found))
        return self.whole(text)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return b"".join(map(self.one, self.parts.split(text) if self.split else [text])) if text else b""

    def encode_all(self, values: pa.Array) -> list[bytes]:
        """The ids of each text, null as empty, word by word where spaces part words."""
        found = by_words(values, self.all_words, self._first) if self.split and len(values) else [None] * len(values)
        return [self.encode(v.as_py() or "") if f is None else f for v, f in zip(values, found, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordTokens:
    return WordTokens(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int | None = 0,
    row_group: int = ROW_GROUP,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode whole texts and write them in ascending doc_id order.

    Columns: part (number of the file in order), doc_id, at (ids of the part before
    the document), n_tokens, ids. ``end_id`` is appended to each document unless None.
    Null texts count as empty; null doc_ids come first; rows of equal doc_id follow
    each other, in order of their texts. Documents are dealt by range of doc_id, so no
    task sees more than its range and the files follow each other in order.
    """
    tok = tokenizer or default_tokenizer()
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, at = encoder(tok), 0
        for batch in slices(batches, most=WORDS_AT_ONCE):
            with no_gc():
                found = [x + end for x in use.encode_all(column(batch, "text"))]
            counts = np.array([len(x) // 4 for x in found], dtype=np.int64)
            ends = at + np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(ends - counts), pa.array(counts), int_lists(found)],
                names=["doc_id", "at", "n_tokens", "ids"],
            )
            at = int(ends[-1])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(tidy(run), f"doc_id {kind}, at long, n_tokens long, ids array<int>").select(F.spark_partition_id().alias("part"), "*")
    options = {
        "compression": "lz4_raw",
        "parquet.enable.dictionary": "true",
        "parquet.writer.version": "v2",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
    }
    rows.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """A token file's rows, with ``start``: ids of all documents before.

    Without ids only metadata columns are read. One row for each part passes through
    the driver, to add up what lies before it.
    """
    rows = spark.read.parquet(path)
    sums = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, plan = 0, []
    for part, n in sums:
        plan.append((part, before))
        before += n
    rows = rows.join(local(spark, plan, "part int, before long"), "part").withColumn("start", F.col("before") + F.col("at"))
    return rows.select("doc_id", "start", "n_tokens", *["ids"] * ids)


def id_checksums(rows: DataFrame) -> DataFrame:
    """Replaces ids by n_tokens, counted from them, and ids_crc32 of their little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "ids")
            ends = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "start", "ids").mapInArrow(tidy(run), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, count and checksum of each document's ids, from a token file written and read back."""
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return id_checksums(read_tokens(spark, path))
