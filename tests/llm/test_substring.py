import random

import numpy as np
import pytest

from tidemark.llm import substring


def slow_cuts(data):
    """Byte by byte, with the hash rolled on."""
    out, last, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(substring.GEAR[b])) & 0xFFFF
        if i + 1 - last > substring.MOST:
            at = last + substring.MOST
            while data[at] & 0xC0 == 0x80:
                at -= 1
            out.append(at)
            last = at
        boundary = i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80
        if h >> (16 - substring.CUT_BITS) == 0 and boundary and i + 1 - last >= substring.LEAST:
            out.append(i + 1)
            last = i + 1
    if last < len(data):
        out.append(len(data))
    return out


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgéh") for _ in range(r.randint(2, 9))) for _ in range(words))


@pytest.mark.parametrize("text", ["", "a", "é" * 2000, prose(1, 2000), "x" * 5000, prose(2, 30) + "漢字🙂" * 300])
def test_cuts_equal_brute_force(text):
    data = text.encode()
    assert substring.cuts(np.frombuffer(data, np.uint8)) == slow_cuts(data)


def test_cuts_resist_insertions():
    a = prose(3, 3000)
    b = a[:5000] + "inserted words" + a[5000:]
    split = lambda t: {t.encode()[i:j] for i, j in zip([0, *substring.cuts(np.frombuffer(t.encode(), np.uint8))], substring.cuts(np.frombuffer(t.encode(), np.uint8)), strict=False)}
    assert len(split(a) - split(b)) <= 3


def brute(rows, least):
    """Repeated runs of chunks, with dictionaries."""
    parts, first = {}, {}
    for k, text in rows:
        data, at = (text or "").encode(), 0
        for to in slow_cuts(data):
            place = (k, key_hash(text), len(data[:at].decode()))
            parts.setdefault((k, text), {})[place] = (len(data[:to].decode()), data[at:to])
            first[data[at:to]] = min(first.get(data[at:to], place), place)
            at = to
    out = set()
    for (k, _), own in parts.items():
        now = None
        for place in sorted(own):
            end, c = own[place]
            if first[c] == place:
                continue
            f = first[c][0]
            if now and now[1] == place[2]:
                now = [now[0], end, now[2] + 1, min(now[3], f)]
                continue
            if now and now[1] - now[0] >= least:
                out.add((k, now[0], now[1], now[1] - now[0], *now[2:]))
            now = [place[2], end, 1, f]
        if now and now[1] - now[0] >= least:
            out.add((k, now[0], now[1], now[1] - now[0], *now[2:]))
    return out


HASHES = {}


def key_hash(text):
    return HASHES[text or ""]


def test_passages(spark):
    shared = prose(10, 60)
    rows = [(i, prose(100 + i, 80) + " " + shared + " " + prose(200 + i, 80)) for i in range(6)]
    rows += [
        (50, prose(300, 200)),
        (51, None),
        (52, ""),
        (60, rows[0][1]),
        (61, "short " * 3),
        (62, "short " * 3),
        (70, prose(400, 60) * 3),
        (80, prose(500, 90)),
        (80, rows[2][1]),
    ]
    from pyspark.sql import functions as F

    HASHES.update({r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()})
    df = spark.createDataFrame([(*r, "x") for r in rows] * 2, "doc_id long, text string, start string")
    got = {tuple(r) for r in substring.passages(df).collect()}
    assert got == brute(rows, substring.PASSAGE)
    assert {r[0] for r in got} == {1, 2, 3, 4, 5, 60, 70, 80}
    assert all(r[5] == (r[0] if r[0] == 70 else 2 if r[0] == 80 and r[1] < 400 else 0) or r[0] == 80 for r in got)
    left = substring.deduplicated(df).collect()
    assert len(left) == 2 * len(rows) and sum(r.doc_id == 80 and r.text == rows[-2][1] for r in left) == 2
    out = {r.doc_id: r.text for r in left}
    assert len(rows[-3][1]) / 3 <= len(out[70]) < len(rows[-3][1]) / 2
    assert out[0] == rows[0][1] and out[50] == rows[6][1] and out[51] is None and out[60] == ""
    assert 160 * 4 < len(out[3]) < len(rows[3][1]) - substring.PASSAGE // 2


def test_other_texts_of_an_id_stay(spark):
    """What repeats in one text of a doc_id is not cut out of another."""
    shared = prose(20, 100)
    rows = [(0, shared), (5, prose(21, 50) + " " + shared), (5, prose(22, 300))]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, cut string, row_key int")
    got = substring.deduplicated(df).collect()
    assert got[0].cut == "x" and substring.deduplicated(df).columns == df.columns
    assert rows[2][1] in {r.text for r in got} and shared in {r.text for r in got}
    assert sorted(len(r.text) for r in got)[0] < len(rows[1][1]) - substring.PASSAGE


def test_very_long_text(spark):
    """Thousands of passages in one text are found and removed in time that follows its length."""
    block = prose(30, 40)
    text = "".join(prose(1000 + i, 3) + block for i in range(6000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert substring.passages(df).count() > 5000
    assert len(substring.deduplicated(df).first().text) < len(text) / 2


def test_empty(spark):
    assert substring.passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = spark.createDataFrame([(None, prose(1, 100)), (1, prose(1, 100))], "doc_id long, text string")
    assert [r.doc_id for r in substring.passages(nulls).collect()] == [1]
