import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

from tidemark.llm import subword  # noqa: E402

CASES = [
    "",
    " ",
    "  ",
    "a",
    "Hello world",
    " lead",
    "trail ",
    "a  b   c",
    " " * 40 + "x" + " " * 33,
    "line\nbreak\n\n end",
    "\ttab\r\n",
    "▁mark ▁▁x",
    "漢字かな🙂 emoji",
    "<s> </s> <0x41>",
    "\x00nul",
    "éàü ß",
    "x" * 3000,
    "aaaaaaaaab" * 50,
    "the the  thethe",
    "1234567890 " * 20,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=subword.default_model())


@pytest.mark.parametrize("text", CASES)
def test_equals_library(library, text):
    use = subword.codec(subword.default_model())
    ids = library.encode(text)
    assert use.encode(text) == ids
    assert use.decode(ids) == library.decode(ids)
    raw, back = use.both(text)
    assert len(raw) == 4 * len(ids) and back == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("theinra sŁ▁ \n\té漢.,0"), max_size=60))
def test_equals_library_on_any_text(text):
    library = sentencepiece.SentencePieceProcessor(model_file=subword.default_model())
    use = subword.codec(subword.default_model())
    assert use.encode(text) == library.encode(text)
    assert use.both(text)[1] == library.decode(library.encode(text))
    pair = use.both_all(pa.array([text, None, text + " x"]))
    assert pair[0] == use.both(text) and pair[1] == (b"", "") and pair[2] == use.both(text + " x")


def test_cut_equals_merging():
    use = subword.codec(subword.default_model())
    for word in ["▁internationalisation", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁the", "▁thhaha", "unbelievably", "ththththth"]:
        assert use.cut(word) == use.merged(word)


def test_frame(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "same text", "x"), (3, "same text", "x"), (4, "word " * 50_000, "x")]
    got = subword.encode_pieces(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert [r.doc_id for r in got] == [1, 2, 3, 3, 4]
    for (_, text, _), r in zip(rows, got, strict=True):
        assert r.ids == library.encode(text or "") and r.decoded == (text or "")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert subword.encode_pieces(empty).count() == 0
