import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from tidemark.llm import tokenfile  # noqa: E402

CASES = [
    "",
    " ",
    "a  b",
    "Hello, it's a test.\n\nNew  line \n x",
    " lead",
    "trail ",
    "tab\t x \t y",
    "<|endoftext|> a <|endoftext|>b c<|endoftext|>",
    "a\x1c b \x85 c　 d",
    "漢字 🙂 é",
    "x" * 5000,
]


def library(text):
    return tokenizers.Tokenizer.from_file(tokenfile.default_tokenizer()).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", CASES)
def test_equals_library(text):
    got = tokenfile.encoder(tokenfile.default_tokenizer()).encode(text)
    assert np.frombuffer(got, "<i4").tolist() == library(text)


_tok = tokenizers.Tokenizer.from_file(tokenfile.default_tokenizer())


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab'st 1.\n\t\x1c\x85　é\xa0"), max_size=40))
def test_equals_library_on_any_text(text):
    got = tokenfile.encoder(tokenfile.default_tokenizer()).encode(text)
    assert np.frombuffer(got, "<i4").tolist() == _tok.encode(text, add_special_tokens=False).ids
    use = tokenfile.encoder(tokenfile.default_tokenizer())
    assert use.encode_all(pa.array([text, None, text + " x"])) == [got, b"", use.encode(text + " x")]


def test_file(spark, tmp_path):
    rows = [
        (9, "last one", 1),
        (2, None, 1),
        (2, "b", 1),
        (2, "b", 1),
        (-5, "first  text", 1),
        (7, "", 1),
        (8, "long " * 30_000, 1),
        (None, "no id", 1),
    ]
    path = str(tmp_path / "t")
    tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, part int"), path)
    got = tokenfile.read_tokens(spark, path).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    at = 0
    for r, (_, text, _) in zip(got, order, strict=True):
        assert r.ids == library(text or "") + [0] and r.n_tokens == len(r.ids) and r.start == at
        at += len(r.ids)
    sums = {(r.start): r.ids_crc32 for r in tokenfile.id_checksums(tokenfile.read_tokens(spark, path)).collect()}
    assert sums == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    assert "ids" not in tokenfile.read_tokens(spark, path, ids=False).columns
    found = [pq.ParquetFile(f).metadata.row_group(0).column(4) for f in sorted((tmp_path / "t").glob("part-*.parquet")) if pq.ParquetFile(f).metadata.num_row_groups]
    assert found and all(c.has_column_index or c.has_offset_index for c in found)
    assert any("DICTIONARY" in e for c in found for e in c.encodings)


def test_empty(spark, tmp_path):
    path = str(tmp_path / "e")
    tokenfile.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert tokenfile.id_checksums(tokenfile.read_tokens(spark, path)).count() == 0
