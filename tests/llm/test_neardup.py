import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import neardup
from tidemark.llm import probminhash as pm
from tidemark.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def weights(text):
    w = WORDS.findall(text or "")
    out = {}
    for i in range(max(len(w) - 4, 1) if w else 0):
        s = tuple(w[i : i + 5])
        out[s] = out.get(s, 0) + 1
    return out


def exact(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def prose(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


def test_shingles_equal_brute_force():
    texts = ["a b c d e f a b c d e", "one two", None, "", " x\ty\nz w v u ", "w " * 100, "é\x1cf g h i j k"]
    hashes, ends = pm.words(pa.array(texts))
    doc, shingle, weight = pm.shingles(hashes, ends)
    for i, t in enumerate(texts):
        assert ends[i + 1] - ends[i] == len(WORDS.findall(t or ""))
        assert sorted(weight[doc == i].tolist()) == sorted(weights(t).values())
    same = pm.shingles(*pm.words(pa.array(["zz"] * 3 + texts)))
    assert (same[1][same[0] == 3] == shingle[doc == 0]).all()


def test_similarity_equals_definition():
    r = random.Random(5)
    for _ in range(200):
        x = {k: r.randint(1, 4) for k in r.sample(range(30), r.randint(1, 20))}
        y = {k: r.randint(1, 4) for k in r.sample(range(30), r.randint(1, 20))}
        sides = [np.array(sorted(s)) for s in (x, y)]
        got = pm.similarity(sides[0], np.array([x[k] for k in sides[0]]), sides[1], np.array([y[k] for k in sides[1]]))
        assert got == pytest.approx(exact(x, y))


def test_sketches_estimate_similarity_and_ignore_the_batch():
    r = random.Random(6)
    x = {k: r.randint(1, 3) for k in range(300)}
    y = {k + 60: r.randint(1, 3) for k in range(300)}
    rows = [(d, k, w) for d, s in enumerate((x, y)) for k, w in sorted(s.items())]
    doc, shingle, weight = (np.array(c) for c in zip(*rows, strict=True))
    got = pm.sketches(doc, shingle.astype(np.uint32), weight, 3, 4000)
    assert abs((got[0] == got[1]).mean() - exact(x, y)) < 0.03 and (got[2] == 0).all()
    alone = pm.sketches(doc[doc == 1] * 0, shingle[doc == 1].astype(np.uint32), weight[doc == 1], 1, 4000)
    assert (alone[0] == got[1]).all()
    share = np.array([(got[0] == k).mean() for k in x])
    assert np.abs(share - np.array(list(x.values())) / sum(x.values())).max() < 0.01


def slow_sketch(s, registers):
    """Arrival by arrival, without batches or bounds."""
    best, kept = [np.inf] * registers, [0] * registers
    for k, w in s.items():
        at = 0.0
        for n in range(1, 2000):
            draw, gap = pm._arrival(np.array([k], np.uint64), np.array([n], np.uint64))
            at += gap[0] / w
            g = int(pm.mixed(draw)[0] % np.uint64(registers))
            if at < best[g]:
                best[g], kept[g] = at, k
            if at > max(best):
                break
    return kept


def test_early_termination_changes_nothing():
    for s in ({7: 1}, {1: 5, 2: 1, 3: 1}, {k: 1 + k % 3 for k in range(1, 60)}):
        keys = np.array(sorted(s))
        got = pm.sketches(np.zeros(len(keys), np.int64), keys.astype(np.uint32), np.array([s[k] for k in keys]), 1, 20)
        assert got[0].tolist() == slow_sketch(s, 20)


def test_components(spark):
    links = [
        (1, 2),
        (2, 3),
        (9, 8),
        (8, 7),
        (7, 6),
        (6, 5),
        (4, 4),
        (3, 1),
    ] + [(100, 100 + i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(64)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5} | {100 + i: 100 for i in range(300)} | {1000 + i: 1000 for i in range(65)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows):
    """Classes by all pairs."""
    sets, at = [weights(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and (rows[i][0] == rows[j][0] and rows[i][1] == rows[j][1] or exact(sets[i], sets[j]) >= 0.8 - 1e-9):
                at[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    return [(k, low[find(i)]) for i, (k, _) in enumerate(rows)]


def test_classes_equal_brute_force(spark):
    r = random.Random(7)
    rows, k = [], 0
    for _ in range(12):
        base = prose(r, r.randint(40, 160))
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = "new" + str(r.randrange(10**6))
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [
        (500, None),
        (501, ""),
        (502, " \n"),
        (503, "two words"),
        (504, "two  words"),
        (505, "two"),
        (506, "la " * 500),
        (507, "la " * 700),
        (3, rows[3][1]),
    ]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, node string")
    got = neardup.classes(df).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    left = neardup.kept(df)
    assert left.columns == df.columns
    assert sorted(x.doc_id for x in left.collect()) == sorted({c for _, c in brute(rows)})


def test_hot_bucket_of_chained_copies(spark):
    """Copies that drift: each is near the next, the ends are far apart."""
    r = random.Random(8)
    text, rows = prose(r, 100), []
    for k in range(60):
        rows.append((k, " ".join(text)))
        text[(k * 7) % 100] = f"drift{k}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.class_id for x in neardup.classes(df).collect()} == {0}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(none).count() == 0 and neardup.kept(none).count() == 0


def block(rows):
    """A block of dicts as Spark hands it over."""
    kind = pa.struct([
        ("node", pa.binary()),
        ("root", pa.binary()),
        ("bands", pa.list_(pa.int64())),
        ("shingles", pa.binary()),
        ("weights", pa.binary()),
    ])
    return neardup.Block.of(pa.array(rows, kind))


def links(band, one, other, own):
    return neardup._block_links(band, block(one), block(other), own, 0.8)


def test_blocks_equal_all_pairs():
    r = random.Random(11)
    base = prose(r, 60)
    texts = []
    for _ in range(40):
        copy = list(base)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(60)] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(copy) + r.choice(["", " la" * 8]))
    h, e = pm.words(pa.array(texts))
    d, s, w = pm.shingles(h, e)
    at = np.searchsorted(d, np.arange(len(texts) + 1))
    load = lambda x: x.astype("<u4").tobytes() if (x > 1).any() else b""
    members = [{
        "node": bytes([i]),
        "root": bytes([i]),
        "bands": [7, 8],
        "shingles": s[at[i] : at[i + 1]].tobytes(),
        "weights": load(w[at[i] : at[i + 1]]),
    } for i in range(len(texts))]
    for one, other, own in ((members, members, True), (members[:15], members[15:], False)):
        got = links(0, one, other, own)
        group = {}

        def root(x, group=group):
            while x in group:
                x = group[x]
            return x

        def join(x, y, group=group, root=root):
            if root(x) != root(y):
                group[max(root(x), root(y))] = min(root(x), root(y))

        for x, y in got:
            join(x, y)
        mine = [root(bytes([i])) for i in range(len(texts))]
        group.clear()
        for x in one:
            for y in other:
                i, j = x["node"][0], y["node"][0]
                if i != j and exact(weights(texts[i]), weights(texts[j])) >= 0.8 - 1e-9:
                    join(x["node"], y["node"])
        assert mine == [root(bytes([i])) for i in range(len(texts))]
        assert links(1, one, other, own) == []


def members(sets):
    """Nodes of one bucket, of sets by shingle and weight."""
    out = []
    for i, s in enumerate(sets):
        keys = np.array(sorted(s), "<u4")
        weight = np.array([s[k] for k in keys.tolist()], "<u4")
        out.append({
            "node": bytes([i]),
            "root": bytes([i]),
            "bands": [7],
            "shingles": keys.tobytes(),
            "weights": weight.tobytes() if (weight > 1).any() else b"",
        })
    return out


def test_only_what_sets_share_decides():
    near = [{k: 1 for k in range(20)}, {k: 1 for k in range(1, 20)}, {k: 1 for k in range(4, 20)}]
    assert set(links(0, members(near), members(near), True)) == {(b"\0", b"\1"), (b"\1", b"\2")}


def test_common_weight_bounds_similarity(monkeypatch):
    monkeypatch.setattr(neardup, "SHINGLES_AT_ONCE", 7)
    r = random.Random(12)
    sets = [{k: r.choice([1, 1, 1, 4]) if i % 2 else 1 for k in r.sample(range(30), r.randint(1, 30))} for i in range(40)]
    sets.append({1000: 1})
    most = neardup._most(*(block(members(part)).sets for part in (sets[:20], sets[20:])))
    plain = lambda s: max(s.values()) == 1
    for i, x in enumerate(sets[:20]):
        for j, y in enumerate(sets[20:]):
            assert exact(x, y) <= most[i, j] + 1e-6
            assert not (plain(x) and plain(y)) or exact(x, y) == pytest.approx(most[i, j])
    assert (most[:, -1] == 0).all()
