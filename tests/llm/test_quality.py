import re

import pytest

from tidemark.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORDS.findall(text)
    seen, repeat = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            repeat |= {j for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed


@pytest.fixture(params=["broadcast", "shuffled"], autouse=True)
def way(request, monkeypatch):
    """Both ways of bringing frequent lines to their texts."""
    if request.param == "shuffled":
        monkeypatch.setattr(quality, "BROADCAST_ROWS", -1)


TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c d e f g h " * 5,
    "x y z " * 4 + "1 2 3 4 5 6 7 8 9 " * 3,
    "l1 a\nl1 a\n \n\nl1 a \nb\r\nb",
    "é 漢字 🙂 # <b> $$ %",
    "w" * 100_000,
    " ".join(f"w{i % 7}" for i in range(20_000)),
    " ".join(f"w{i}" for i in range(30)),
]


def test_equals_brute_force(spark):
    rows = [(i, t, "h", "extra") for i, t in enumerate(TEXTS)] * 2
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string, lines string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(TEXTS[r.doc_id] or ""), TEXTS[r.doc_id]


@pytest.mark.parametrize("copies", [1, 3])
def test_lines_across_documents(spark, copies):
    body = [" ".join(f"w{d}x{i}" for i in range(30)) for d in range(8)]
    rows = [(d, body[d] + "\nShared  LINE here", "h") for d in range(6)]
    rows += [(10, "shared line HERE\n" * 7 + "but this is all that is left of it", "h")]  # seven lines of three, then nine
    rows += [(11, body[6] + "\nshared line here", None), (12, body[7], "other")]
    rows += [(20 + i, body[0] + "\nonly copies have this line", "h") for i in range(9)]  # one text, many rows
    df = spark.createDataFrame(rows * copies, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judged(df, max_docs=5, min_left=0.35).collect()}
    assert got[0].words_left == 30 and got[0].kept
    assert got[10].words_left == 9 and not got[10].kept
    assert got[11].words_left == 33 and got[12].words_left == 30
    assert got[20].words_left == 35 and got[20].kept
    left = quality.kept(df, max_docs=5, min_left=0.35)
    assert left.columns == df.columns and left.count() == copies * (len(rows) - 1)


def even(line):
    return re.sub(r"[\x20\x09\x0B-\x0D]+", " ", line).lower().strip(" ")


def test_kept_texts_lose_frequent_lines(spark):
    body = [" ".join(f"w{d}x{i}" for i in range(30)) for d in range(9)]
    rows = [(d, f"Shared  LINE\there\r\n\n {body[d]} \nshared line here\n", "h", 7) for d in range(7)]
    rows += [(7, body[7] + "\nshared line here", "other", 7), (8, body[8] + "\n\nend", None, 7)]
    rows += [(0, rows[0][1], "other", 7), rows[1]]  # the same id and text at another host, and a repeated row
    rows += [(20, "shared line here\n" * 20 + "and no more than this", "h", 7)]
    left = quality.kept(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int"), max_docs=5, min_left=0.35)
    want = []
    for k, text, source, n in rows[:-1]:
        new = "\n".join(x for x in text.split("\n") if source != "h" or even(x) != "shared line here")
        want.append((k, new, source, n if new == text else len(new)))
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)
    assert left.dtypes == [("doc_id", "bigint"), ("text", "string"), ("source", "string"), ("n_chars", "int")]


def test_empty(spark):
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    nulls = spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")
    assert [r.kept for r in quality.judged(nulls).collect()] == [False]
    assert quality.kept(nulls).count() == 0


def test_any_names_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, None, "a", 2, "b", "c"), (None, text, "s", "a", 2, "b", "c")] * 2, "doc_id long, text string, source string, lists string, `new.text` int, document string, frequent string")
    left = quality.kept(df)
    assert left.columns == df.columns and sorted(map(str, left.collect())) == sorted(map(str, df.collect()))
    assert quality.kept(df.limit(0)).count() == 0 and quality.judged(df.limit(0)).count() == 0
