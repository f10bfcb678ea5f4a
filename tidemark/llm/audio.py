"""Telephony audio in media columns: mu-law, A-law and ADPCM in WAV, to resampled PCM.

Companded samples are expanded by tables of 256 entries. ADPCM blocks depend on
nothing outside themselves, so numpy steps through the samples of a block once for
all blocks of a batch. PCM is resampled to twice the rate by a half-band filter and
stands in a column of its own, which whoever writes the table stores.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrow import column, slices, texts, tidy
from .common import table, written

#: WAV format tags of the three codecs.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 0x11}
NAMES = {v: k for k, v in TAGS.items()}

RATE = 8000
#: Bytes of an ADPCM block: four of header, then two samples a byte.
BLOCK = 64
BLOCK_SAMPLES = (BLOCK - 4) * 2 + 1
#: Blocks that are decoded at a time.
BLOCKS_AT_ONCE = 1 << 15

# Fixed values of the ADPCM format: index changes by the code's low three bits.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)

# Fixed values of the ADPCM format: the 89 step sizes.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31,
        34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
        157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658,
        724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024,
        3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899,
        15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law byte."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law byte."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part = (code >> 4) & 7
    size = ((code & 15) << 4) + 8
    size = np.where(part == 0, size, (size + 0x100) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of ADPCM blocks, one row each; an index above 88 counts as 88."""
    out = np.empty((len(blocks), BLOCK_SAMPLES), dtype=np.int16)
    for at in range(0, len(blocks), BLOCKS_AT_ONCE):
        some = np.ascontiguousarray(blocks[at : at + BLOCKS_AT_ONCE].T)  # a block is a column
        value = (some[0].astype(np.int32) | some[1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
        index = np.minimum(some[2].astype(np.int32), 88)
        pcm = np.empty((BLOCK_SAMPLES, some.shape[1]), dtype=np.int16)
        pcm[0] = value
        k = 1
        for row in some[4:]:
            for code in (row & 15, row >> 4):
                step = STEPS[index]
                low = code & 7
                change = (step >> 3) + step * (low >> 2) + (step >> 1) * ((low >> 1) & 1) + (step >> 2) * (low & 1)
                value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
                index = np.clip(index + INDEX_STEPS[low], 0, 88)
                pcm[k] = value
                k += 1
        out[at : at + BLOCKS_AT_ONCE] = pcm.T
    return out


def wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAV file around coded samples, which it holds unchanged."""
    if codec == "adpcm":
        blocks = len(payload) // BLOCK
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * BLOCK // BLOCK_SAMPLES, BLOCK, 4, 2, BLOCK_SAMPLES)
        count = blocks * BLOCK_SAMPLES
    else:
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
        count = len(payload)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and coded samples of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = NAMES.get(tag)
        elif name == b"data":
            if codec is None:
                raise ValueError("no supported format before the samples")
            if at + 8 + size > len(media):
                raise ValueError("samples are cut short")
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


#: The odd taps of a half-band filter of length 31 with a Hamming window, summing to 1.
_k = np.arange(-15, 16, 2)
HALF = np.sinc(_k / 2) * (0.54 + 0.46 * np.cos(np.pi * _k / 16))
HALF = HALF / HALF.sum()


def doubled(pcm: np.ndarray) -> np.ndarray:
    """PCM at twice the rate: each sample, then the filter's value half-way to the next."""
    edge = len(HALF) // 2
    wide = np.pad(pcm.astype(np.float64), (edge - 1, edge), mode="edge") if len(pcm) else np.zeros(0)
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    if len(pcm):
        out[1::2] = np.clip(np.rint(np.convolve(wide, HALF, "valid")), -32768, 32767)
    return out


def decoded(media: list[bytes]) -> list[tuple[str, int, bytes, np.ndarray]]:
    """Codec, rate, coded samples and PCM of each WAV file; ADPCM across all files' blocks."""
    parts = [unwav(m) for m in media]
    blocks = [np.frombuffer(p, np.uint8)[: len(p) // BLOCK * BLOCK].reshape(-1, BLOCK) for c, _, p in parts if c == "adpcm"]
    pcm = adpcm(np.concatenate(blocks)) if blocks else None
    out, at = [], 0
    for codec, rate, payload in parts:
        if codec == "adpcm":
            n = len(payload) // BLOCK
            out.append((codec, rate, payload, pcm[at : at + n].reshape(-1)))
            at += n
        else:
            out.append((codec, rate, payload, TABLES[codec][np.frombuffer(payload, np.uint8)]))
    return out


def payload_of(text: str) -> bytes:
    """The text's UTF-8 bytes, then bytes 0 up to a positive multiple of 64."""
    raw = text.encode()
    return raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))


def codec_of(payload: bytes) -> str:
    """The codec a payload is stored with; equal payloads have the same."""
    return ("mulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as coded samples in a WAV file.

    Null texts count as empty. Only doc_id and text are read; repeated rows give
    repeated rows, and equal texts equal media.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = texts(batch)
            sizes = [len(t.encode()) for t in raw]
            media = [wav(p, codec_of(p)) for p in map(payload_of, raw)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, media binary")


def resampled(media: DataFrame) -> DataFrame:
    """Replaces media by codec, rate, payload and pcm: 16-bit little-endian samples at twice the rate.

    Media that is null or no WAV file of the three codecs gives nulls. Other columns stay.
    """
    keep = [c for c in media.columns if c not in ("media", "codec", "rate", "payload", "pcm")]
    kinds = [f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            found = _resampled(column(batch, "media").to_pylist())
            codecs, rates, payloads, pcm = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([
                *(column(batch, c) for c in keep),
                pa.array(codecs, pa.string()),
                pa.array(rates, pa.int32()),
                pa.array(payloads, pa.binary()),
                pa.array(pcm, pa.binary()),
            ], names=[*keep, "codec", "rate", "payload", "pcm"])

    return media.mapInArrow(tidy(run), ", ".join([*kinds, "codec string", "rate int", "payload binary", "pcm binary"]))


def _resampled(media: list[bytes | None]) -> list[tuple]:
    good = []
    for i, m in enumerate(media):
        try:
            if m is not None:
                unwav(m)
                good.append(i)
        except (ValueError, struct.error):
            pass
    out: list[tuple] = [(None, None, None, None)] * len(media)
    for i, (codec, rate, payload, pcm) in zip(good, decoded([media[i] for i in good]), strict=True):
        out[i] = (codec, 2 * rate, payload, doubled(pcm).astype("<i2").tobytes())
    return out


#: Samples whose squares are added up at a time: their sum is exact in a double.
SQUARES_AT_ONCE = 1 << 20


def energy(wave: np.ndarray) -> int:
    """The exact sum of the samples' squares."""
    parts = (wave[i : i + SQUARES_AT_ONCE].astype(np.float64) for i in range(0, len(wave), SQUARES_AT_ONCE))
    return sum(int(x @ x) for x in parts)


def described(codec: str, rate: int, pcm: bytes) -> str:
    """Codec, rate, samples, energy, peak, sign changes and checksum of PCM."""
    wave = np.frombuffer(pcm, "<i2")
    peak = max(int(wave.max()), -int(wave.min())) if len(wave) else 0
    turns = np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0))
    return f"{codec}:{rate}:{len(wave)}:{energy(wave)}:{peak}:{turns}:{zlib.crc32(pcm):08x}"


def features(media: DataFrame) -> DataFrame:
    """Features of stored media, one row each: what the contract asks for, and the resampled PCM.

    Reads doc_id, n_bytes and media. Media that is null or no WAV file of the three
    codecs has null features and PCM, but its own size and digest if there are bytes.
    Repeated rows give repeated rows; an empty table gives none.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]

    def row(m: bytes | None, codec: str | None, rate: int | None, payload: bytes | None, pcm: bytes | None) -> tuple:
        own = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
        if codec is None:
            return (None, None, None, *own, None, None)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *own, described(codec, rate, pcm), pcm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in slices(batches, "media"):
            stored = column(batch, "media").to_pylist()
            rows = [row(m, *found) for m, found in zip(stored, _resampled(stored), strict=True)]
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), *made], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        tidy(run),
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    )


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents (null as empty) stored as telephony audio, read back, with its PCM.

    The media are written to the shared folder. The PCM, some five times the text, is
    the result's last column: whoever keeps the result stores it.
    """
    media = written(to_media(table(spark, sf_dir, "documents")), "media", compression="zstd")
    return features(media)
