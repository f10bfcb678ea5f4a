"""The registered queries over whole tables: against DuckDB, the libraries, or brute force."""

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")

from tidemark.llm import audio, neardup, subword, substring, tokenfile  # noqa: E402
from tidemark.llm import probminhash as pm  # noqa: E402
from tidemark.llm.registry import ORACLE_SQL, QUERIES  # noqa: E402

from . import test_lm as lm  # noqa: E402
from . import test_neardup as near  # noqa: E402
from . import test_pii as pii  # noqa: E402
from . import test_substring as passages  # noqa: E402

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(MIDDLE), reason="needs the test tables")


def documents(folder, columns="doc_id, text"):
    return duckdb.execute(f"SELECT {columns} FROM read_parquet('{folder}/documents.parquet')").fetchall()


def run(spark, number, folder=SMALL):
    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    return QUERIES[name](spark, folder).collect()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert {n.split("_")[0] for n in ORACLE_SQL} == {"op3", "op4"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_query_equals_sql(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    got = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    df = QUERIES[name](spark, folder)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(got.fetchall())


def test_passages(spark):
    rows = documents(SMALL)
    keys = spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) AS h")
    passages.HASHES.update({r.t: r.h for r in keys.collect()})
    assert {tuple(r) for r in run(spark, 1)} == passages.brute(rows, substring.PASSAGE)


def test_personal_data(spark):
    texts = dict(documents(SMALL))
    got = run(spark, 2)
    assert len(got) == len(texts)
    for r in got:
        base = pii.brute(texts[r.doc_id] or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        every = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(every)
        added = sorted(set(every) - set(base), key=lambda s: s[1])
        assert all(a[2] <= b[1] for a, b in zip(added, added[1:], strict=False))
        assert all(a[2] <= b[1] or b[2] <= a[1] for a in added for b in base)


def test_token_file(spark):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(tokenfile.default_tokenizer()), 0
    got = sorted(run(spark, 5), key=lambda r: r.doc_id)
    for r, (k, text) in zip(got, sorted(documents(SMALL)), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_language_model(spark):
    rows = documents(SMALL)
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    want = lm.base(rows, lambda r: not held(r[0]))
    got = run(spark, 7)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), n, known, total)
        assert r.base_score == pytest.approx(base) and -1e9 < r.score < 0


def test_classes(spark):
    rows = documents(SMALL)
    assert sorted(map(tuple, run(spark, 8))) == sorted(near.brute(rows))


def test_recall_of_links(spark):
    """Rows whose id is divisible by 50 against all rows, by exact similarity."""
    rows = documents(MIDDLE)
    classes = {r.doc_id: r.class_id for r in run(spark, 8, MIDDLE)}
    hashes, ends = pm.words(pa.array([t for _, t in rows], pa.string()))
    doc, shingle, weight = pm.shingles(hashes, ends)
    at = np.searchsorted(doc, np.arange(len(rows) + 1))
    sets = [(shingle[i:j], weight[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
    links = found = 0
    for i, (k, _) in enumerate(rows):
        if k % 50 == 0:
            for j, (other, _) in enumerate(rows):
                if other != k and len(sets[i][0]) and len(sets[j][0]) and pm.similarity(*sets[i], *sets[j]) >= neardup.LEAST:
                    links += 1
                    found += classes[k] == classes[other]
    assert links > 3 and found >= 0.9 * links


def test_subword_ids(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=subword.default_model())
    texts = dict(documents(SMALL))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = run(spark, 9)
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(",".join(map(str, ids))))
        assert r.decoded_sha256 == digest(library.decode(ids))


def test_audio(spark):
    texts = dict(documents(SMALL))
    got = run(spark, 10)
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = audio.payload_of(texts[r.doc_id] or "")
        assert len(payload) % 64 == 0 and payload[: len(raw)] == raw and not payload[len(raw) :].strip(b"\0")
        media = audio.wav(payload, audio.codec_of(payload))
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(media))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        codec, rate, samples = r.feature.split(":")[:3]
        assert (codec, rate) == (audio.codec_of(payload), "16000") and len(r.pcm) == 2 * int(samples)
        assert r.feature.endswith(f":{zlib.crc32(r.pcm):08x}")
