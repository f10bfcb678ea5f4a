import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import audio


def slow_adpcm(block):
    """One block, one sample at a time."""
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = step >> 3
            if code & 4:
                change += step
            if code & 2:
                change += step >> 1
            if code & 1:
                change += step >> 2
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def test_tables():
    mu, a = audio.mulaw_table(), audio.alaw_table()
    assert mu[0xFF] == 0 and mu[0x7F] == 0 and mu[0x80] == 32124 and mu[0x00] == -32124
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255


def test_adpcm_equals_brute_force():
    blocks = np.random.default_rng(1).integers(0, 256, (300, audio.BLOCK), dtype=np.uint8)
    got = audio.adpcm(blocks)
    for b, row in zip(blocks, got, strict=True):
        assert slow_adpcm(b.tobytes()) == row.tolist()


@pytest.mark.parametrize("codec", list(audio.TAGS))
def test_wav_round_trip(codec):
    payload = bytes(range(256)) * 2
    name, rate, back = audio.unwav(audio.wav(payload, codec))
    assert (name, rate, back) == (codec, 8000, payload)


def test_doubled():
    tone = (8000 * np.sin(2 * np.pi * 440 * np.arange(400) / 8000)).astype(np.int16)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(800) / 16000)
    got = audio.doubled(tone)
    assert len(got) == 800 and (got[::2] == tone).all()
    assert np.abs(got[60:-60] - want[60:-60]).max() < 60
    assert len(audio.doubled(np.zeros(0, np.int16))) == 0


def test_frame(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "é" * 33), (5, "long " * 40_000), (5, "long " * 40_000), (6, "x" * 64)]
    docs = spark.createDataFrame([(*r, b"?") for r in rows], "doc_id long, text string, media binary")
    got = audio.features(audio.to_media(docs)).collect()
    by = {}
    for (k, text), r in zip(rows, got, strict=True):
        raw = (text or "").encode()
        payload = raw + b"\0" * ((64 - len(raw) % 64) % 64 if raw else 64)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (k, len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert by.setdefault(text or "", tuple(r)[1:]) == tuple(r)[1:]
    assert audio.features(audio.to_media(docs.limit(0))).count() == 0


def slow_table(codec):
    """Each code's sample by its definition: sign, exponent, mantissa."""
    out = []
    for code in range(256):
        if codec == "mulaw":
            code ^= 0xFF
            size = (((code & 15) * 2 + 33) << (code >> 4 & 7)) - 33
            out.append((-1 if code & 128 else 1) * size * 4)
        else:
            code ^= 0x55
            part = code >> 4 & 7
            size = (code & 15) * 2 + 1 + (32 if part else 0)
            out.append((1 if code & 128 else -1) * (size << max(part - 1, 0)) * 8)
    return out


@pytest.mark.parametrize("codec", ["mulaw", "alaw"])
def test_tables_equal_definition(codec):
    assert audio.TABLES[codec].tolist() == slow_table(codec)


def slow_doubled(pcm):
    """Each sample, then the weighted mean of the 16 around the gap behind it."""
    out = []
    for i, x in enumerate(pcm):
        near = [pcm[max(0, min(len(pcm) - 1, i + k))] for k in range(-7, 9)]
        mid = sum(float(w) * float(v) for w, v in zip(audio.HALF, near, strict=True))
        out += [int(x), max(-32768, min(32767, round(mid)))]
    return out


def test_features_equal_brute_force(spark):
    rows = [(i, chr(33 + i) * (5 * i + 1) + "wave" * i) for i in range(40)]
    got = {r.doc_id: r for r in audio.features(audio.to_media(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    seen = set()
    for k, text in rows:
        payload = audio.payload_of(text)
        codec = audio.codec_of(payload)
        seen.add(codec)
        if codec == "adpcm":
            wave = [v for i in range(0, len(payload), audio.BLOCK) for v in slow_adpcm(payload[i : i + audio.BLOCK])]
        else:
            wave = [slow_table(codec)[b] for b in payload]
        wide = slow_doubled(wave)
        mine = np.frombuffer(got[k].pcm, "<i2")
        assert np.abs(mine - np.array(wide)).max() <= 1  # a sum may round the other way
        wide = [int(v) for v in mine]
        turns = sum((a < 0) != (b < 0) for a, b in zip(wide[1:], wide, strict=False))
        want = f"{codec}:16000:{len(wide)}:{sum(v * v for v in wide)}:{max(map(abs, wide))}:{turns}:{zlib.crc32(got[k].pcm):08x}"
        assert got[k].feature == want
    assert seen == set(audio.TAGS)


def test_energy_is_exact():
    loud = np.full(3 * audio.SQUARES_AT_ONCE + 5, -32767, dtype="<i2")
    assert audio.energy(loud) == 32767**2 * len(loud) and audio.energy(loud[:0]) == 0


def test_features_of_bad_media(spark):
    df = spark.createDataFrame([(1, 2, b"no"), (2, None, None), (3, 1, b"")], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in audio.features(df).collect()}
    assert (got[1].media_bytes, got[1].payload_bytes, got[1].feature, got[1].pcm) == (2, None, None, None)
    assert (got[2].media_bytes, got[2].media_sha256, got[2].feature) == (None, None, None) and got[3].media_bytes == 0


def test_resampled_keeps_other_columns_and_bad_media(spark):
    good = audio.wav(b"\x00\x80" * 32, "mulaw")
    df = spark.createDataFrame([(1, good, "a"), (2, b"no", "b"), (3, None, "c")], "k int, media binary, pcm string")
    got = {r.k: r for r in audio.resampled(df).collect()}
    assert got[1].rate == 16000 and len(got[1].pcm) == 4 * 64 and got[1].payload == b"\x00\x80" * 32
    assert got[2].pcm is None and got[3].codec is None
