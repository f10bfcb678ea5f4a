import random

import pyarrow as pa
import pytest

pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import sentencepiece  # noqa: E402

from tidemark.llm import mixing, subword  # noqa: E402

from . import test_neardup as near  # noqa: E402
from . import test_pii as pii  # noqa: E402
from . import test_quality as quality  # noqa: E402


def fixture():
    r = random.Random(9)
    rows = []
    for k in range(60):
        words = near.prose(r, r.randint(10, 120))
        if k % 9 == 0:
            words += ["mail", "x.y@example.org", "card", "4111", "1111", "1111", "1111,", "end"]
        text = " ".join(words)
        rows.append((k, text, "en", f"s{k % 4}" if k % 5 else None, len(text)))
        if k % 6 == 0:
            copy = list(words)
            copy[3] = "changed"
            rows.append((1000 + k, " ".join(copy), "en", "s1", len(" ".join(copy))))
        if k % 10 == 0:
            rows.append((2000 + k, text, "en", "s2", len(text)))
    rows += [(3000, None, None, None, None), (3001, "", "en", "s0", 0), (3002, "la la la la la la la la " * 20, "en", "s0", 1), rows[5], rows[5]]
    return rows


def brute(rows):
    """The stages by definition, for documents with a verdict by base rules alone."""
    rows = [r for r in rows if not quality.brute(r[1] or "")[5]]
    lowest = {}
    for (k, c), r in zip(near.brute([(r[0], r[1]) for r in rows]), rows, strict=True):
        if k == c:
            lowest[k] = r
    out = []
    for r in lowest.values():
        text = r[1]
        for kind, i, j in sorted(pii.brute(text), key=lambda s: -s[1]):
            text = f"{text[:i]}[{kind.upper()}]{text[j:]}"
        out.append((r[0], text, *r[2:4], len(text)))
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {r[0]: r for r in brute(rows)}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    assert sorted(map(tuple, now.collect())) == sorted(want.values())
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(list(want.values()), docs.schema)).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=subword.default_model())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(k for k, n in copies.items() for _ in range(n))
    for r in got:
        assert r.ids == library.encode(want[r.doc_id][1]) and r.n_tokens == len(r.ids) and r.decoded_chars == len(want[r.doc_id][1])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ids_are_made_from_small_batches(spark, tmp_path, monkeypatch):
    """Not from a whole task's text at once, whoever runs the job on the result."""

    def sizes(docs):
        def run(batches):
            for b in batches:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[b.nbytes]] * n, pa.list_(pa.int32())), pa.array([""] * n)], names=["doc_id", "ids", "decoded"])

        return docs.mapInArrow(run, "doc_id long, ids array<int>, decoded string")

    monkeypatch.setattr(subword, "encode_pieces", sizes)
    docs = spark.range(1000).coalesce(1).selectExpr("id AS doc_id", "repeat('word ', 4000) AS text")
    got = corpus_pipeline.pieces(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(1000))
    assert max(r.ids[0] for r in got) < 3_000_000
