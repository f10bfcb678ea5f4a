"""Exact merge-type subword encoding by backtracking, and decoding.

A merge-type (BPE) encoding is the only cut of a text into pieces in which each two
neighbours stay apart when they are merged on their own. So pieces are taken longest
first, as an Aho-Corasick automaton finds them; a piece is kept if merging it anew
with the piece before it gives the two back; a position from which no piece leads on
is marked in a bitfield and left, and the search steps back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import Memo, by_words, column, int_lists, no_gc, slices, tidy
from .common import table

#: The mark that stands for a space.
SPACE = "▁"

#: Words and pairs of pieces whose results a worker keeps.
KEPT_WORDS, KEPT_PAIRS = 120_000, 100_000

#: Bytes of text whose distinct words are looked up together.
WORDS_AT_ONCE = 4_000_000


class PieceCodec:
    """Encodes and decodes as a merge-type model with byte fallback does."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        rules, kind = model.normalizer_spec, proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("a BPE model with byte fallback and plain normalisation is needed")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.byte_ids = [0] * 256
        self.bytes = {}
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.bytes[i] = int(p.piece[3:5], 16)
        self.found = ahocorasick.Automaton()
        whole = {p for p in self.scores if len(p) > 1 and self.merged(p) == [p]}
        #: The longest piece, or single character, that a piece begins with.
        self.shorter = {p: next(p[:k] for k in range(len(p) - 1, 0, -1) if k == 1 or p[:k] in whole) for p in whole}
        for p in whole:
            self.found.add_word(p, (len(p) - 1, p))
        self.found.make_automaton()
        self.raw: Memo = Memo(self._raw, len(self.pieces))
        self.apart: Memo = Memo(lambda pair: self.merged(pair[0] + pair[1]) == [*pair], KEPT_PAIRS)
        self.word: Memo = Memo(self._word, KEPT_WORDS // 10)
        self.spaced: Memo = Memo(self._spaced, KEPT_WORDS)
        # A word can't merge with what follows if no piece has the mark behind another
        # character; a line break can't if it is in no piece.
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            self.unit = regex.compile(r"[\s\S]+")
        elif any("\n" in p for p in self.scores):
            self.unit = regex.compile(rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        else:
            self.unit = regex.compile(rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")

    def merged(self, text: str) -> list[str]:
        """The encoding by definition: merge the best pair, the first of equals, again and again."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def cut(self, text: str) -> list[str]:
        """The text's pieces; a character without a piece stands alone."""
        n = len(text)
        if n < 2:
            return [text] if n else []
        longest = list(text)
        for end, (back, piece) in self.found.iter(text):
            longest[end - back] = piece  # ends ascend, so the longest comes last
        failed, apart, shorter = bytearray(n + 1), self.apart, self.shorter
        out: list[str] = []
        at, last, piece = 0, None, longest[0]
        while True:
            to = at + len(piece)
            if not failed[to] and (last is None or apart[last, piece]):
                out.append(piece)
                if to == n:
                    return out
                at, last, piece = to, piece, longest[to]
                continue
            piece = shorter.get(piece)
            while piece is None:  # nothing leads on from here
                failed[at] = 1
                before = out.pop()
                at -= len(before)
                last = out[-1] if out else None
                piece = shorter.get(before)

    def _raw(self, piece: str) -> tuple[bytes, str]:
        ids = [self.ids[piece]] if piece in self.ids else [self.byte_ids[b] for b in piece.encode()]
        return b"".join(i.to_bytes(4, "little") for i in ids), self.pieced(ids)

    def _word(self, unit: str) -> tuple[bytes, str]:
        found = list(map(self.raw.__getitem__, self.cut(unit)))
        return b"".join([i for i, _ in found]), "".join([t for _, t in found])

    def units(self, text: str) -> list[str]:
        """Parts of a text that encode independently of each other."""
        return self.unit.findall(self.prefix + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [int.from_bytes(u[i : i + 4], "little") for u, _ in map(self.word.__getitem__, self.units(text)) for i in range(0, len(u), 4)]

    def pieced(self, ids: list[int]) -> str:
        """The ids' text with its leading mark as a space."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes:
                raw.append(self.bytes[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(self.pieces[i].replace(SPACE, " "))
        return "".join(out) + raw.decode(errors="replace")

    def decode(self, ids: list[int]) -> str:
        text = self.pieced(ids)
        return text[1:] if self.prefix and ids and self.pieces[ids[0]].startswith(SPACE) else text

    def both(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the text decoded from them."""
        if not text:
            return b"", ""
        found = list(map(self.word.__getitem__, self.units(text)))
        back = "".join([t for _, t in found])
        return b"".join([i for i, _ in found]), back[1:] if self.prefix else back

    def _spaced(self, word: str) -> bytes | None:
        """Ids of a word and the space before it; None if they decode to anything else,
        or the word is empty or has the mark, so that it may merge with the next."""
        if not word or SPACE in word:
            return None
        if "\n" in word:
            parts = [p for u in self.unit.findall(SPACE + word) for p in self.cut(u)]
        else:
            parts = self.cut(SPACE + word)
        found = list(map(self.raw.__getitem__, parts))
        return b"".join([i for i, _ in found]) if "".join([t for _, t in found]) == " " + word else None

    def both_all(self, values: pa.Array) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each text, null as empty.

        Where every word decodes to itself behind its space, so does the text: it is
        not put together anew.
        """
        found = by_words(
            values,
            lambda words: list(map(self.spaced.__getitem__, words)),
            self.spaced.__getitem__,
        ) if self.prefix and len(values) else [None] * len(values)
        out = []
        for v, f in zip(values, found, strict=True):
            text = v.as_py() or ""
            out.append(self.both(text) if f is None else (f, text))
        return out


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, ids array<int>, decoded string.

    Whole texts are encoded; null and empty texts give no ids and an empty text. No
    row depends on another, so there is no shuffle and repeated rows give repeated
    rows. Only doc_id and text are read, whatever other columns there are. The model
    file must be at the same path on all executors.
    """
    model = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model)
        for batch in slices(batches, most=WORDS_AT_ONCE):
            with no_gc():
                found = use.both_all(column(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), int_lists([i for i, _ in found]), pa.array([t for _, t in found], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )
        for memo in (use.spaced, use.word, use.apart):
            memo.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>, decoded string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and decoded text; a null text has no ids."""
    out = encode_pieces(table(spark, sf_dir, "documents"))
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
