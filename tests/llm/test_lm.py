import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from tidemark.llm import attention, lm  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


def base(rows, learn):
    c = Counter(t for r in rows if learn(r) for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    return {r[0]: (
        len(tokens(r[1])),
        sum(c[t] > 0 for t in tokens(r[1])),
        n,
        sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(r[1])),
    ) for r in rows}


def corpus():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
    rows = [(i, " ".join(r.choice(vocabulary[: 20 + 3 * i]) for _ in range(r.randint(1, 200)))) for i in range(60)]
    return rows + [
        (100, None),
        (101, ""),
        (102, "ÉCLAIR éclair THE The the\tx\x0by"),
        (103, "new words only here " * 4),
        (104, "z" * 5000),
        (104, "z" * 5000),
    ]


@pytest.mark.parametrize("most", [0, 40, 1 << 20])
def test_base_equals_brute_force(spark, most):
    rows = corpus()
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, words string")
    got = lm.scored(df, F.col("doc_id") % 3 != 0, sample=20, most=most).collect()
    want = base(rows, lambda r: r[0] % 3 != 0)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(score) and r.score < 0


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scored(empty, F.lit(True)).count() == 0
    got = lm.scored(spark.createDataFrame([(None, None), (1, "a b")], "doc_id long, text string"), F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def one_by_one(model, ids):
    """Each id from a window of its own, without batches."""
    stream = [model.end, *ids, model.end]
    total, w = 0.0, model.weights
    for t in range(len(stream) - 1):
        k = 0 if t < attention.WINDOW else -(-(t + 1 - attention.WINDOW) // attention.STEP)
        start = k * attention.STEP
        x = w.embed[stream[start : t + 1]] + w.place[: t + 1 - start]
        q, key, v = np.split(x @ w.qkv, 3, axis=1)
        a = np.exp(q[-1] @ key.T / math.sqrt(attention.DIM))
        h = x[-1] + (a @ v / a.sum()) @ w.out
        p = np.exp(h @ w.top + w.bias)
        total += math.log(p[model.kind[stream[t + 1]]] / p.sum()) + model.share[stream[t + 1]]
    return total


def test_windows_score_each_id_once():
    r = np.random.default_rng(0)
    model = attention.fit([r.integers(0, 50, 400) for _ in range(5)], 50, steps=20, batch=8)
    texts = [r.integers(0, 50, n) for n in (0, 1, 31, 32, 33, 55, 56, 57, 200, 0)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.log_probs(np.concatenate(texts), ends)
    assert np.allclose(got, [one_by_one(model, t.tolist()) for t in texts], rtol=1e-4)


def test_probabilities_add_up():
    r = np.random.default_rng(0)
    model = attention.fit([r.integers(0, 30, 300)], 30, steps=5, batch=4)
    ids = [3, 7]
    mass = 0.0
    before = one_by_one(model, ids) - one_by_one_last(model, ids)
    for nxt in range(31):
        mass += math.exp(one_by_one_prefix(model, [*ids, nxt]) - before)
    assert mass == pytest.approx(1, rel=1e-4)


def one_by_one_prefix(model, ids):
    """Log probability of ids without an end."""
    end = model.end
    return one_by_one(model, [i for i in ids]) - one_by_one_last(model, ids) if end not in ids else one_by_one(model, ids[:-1])


def one_by_one_last(model, ids):
    """Log probability of the end behind ids, for short texts."""
    stream, w = [model.end, *ids], model.weights
    x = w.embed[stream] + w.place[: len(stream)]
    q, key, v = np.split(x @ w.qkv, 3, axis=1)
    a = np.exp(q[-1] @ key.T / math.sqrt(attention.DIM))
    p = np.exp((x[-1] + (a @ v / a.sum()) @ w.out) @ w.top + w.bias)
    return math.log(p[model.kind[model.end]] / p.sum()) + model.share[model.end]


def test_gradients():
    r = np.random.default_rng(1)
    w = attention.fresh(20)
    for name in ("embed", "place", "qkv", "out", "top", "bias"):
        setattr(w, name, getattr(w, name).astype(np.float64))
    ids, kind = r.integers(0, 20, (3, attention.WINDOW)), r.integers(0, attention.CLASSES, (3, attention.WINDOW))
    _, grads, known, d_embed = attention.gradients(w, ids, kind)
    full = np.zeros_like(w.embed)
    full[known] = d_embed
    for p, g in zip(w.parts(), [full, *grads], strict=True):
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in p.shape)
            old = p[at]
            p[at] = old + 1e-4
            up = attention.gradients(w, ids, kind)[0]
            p[at] = old - 1e-4
            down = attention.gradients(w, ids, kind)[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-4, abs=2e-4)


def test_gradients_hold_few_windows_at_a_time():
    """What a step needs beside its inputs' rows doesn't grow with its windows, and fits a core's cache."""
    r = np.random.default_rng(1)
    w, n = attention.fresh(2000), 512
    ids, kind = r.integers(0, 2000, (n, attention.WINDOW)), r.integers(0, attention.CLASSES, (n, attention.WINDOW))
    rows = ids.size * attention.DIM * w.embed.itemsize
    tracemalloc.start()
    try:
        attention.gradients(w, ids, kind)
        assert tracemalloc.get_traced_memory()[1] < 5 * rows
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("times", [1, 12])
def test_gradients_add_up_over_windows(times):
    """Also where exponentials leave their range."""
    r = np.random.default_rng(5)
    w, n = attention.fresh(20), 70
    w.qkv *= np.float32(times)
    w.top *= np.float32(times * times)
    ids, kind = r.integers(0, 20, (n, attention.WINDOW)), r.integers(0, attention.CLASSES, (n, attention.WINDOW))
    loss, grads, known, d_embed = attention.gradients(w, ids, kind)
    wide = attention.Weights(*[p.astype(np.float64) for p in w.parts()])
    each = [attention.gradients(wide, ids[i : i + 1], kind[i : i + 1]) for i in range(n)]
    assert loss == pytest.approx(np.mean([x[0] for x in each]), rel=1e-4)
    for i, g in enumerate(grads):
        want = np.mean([x[1][i] for x in each], axis=0)
        assert np.allclose(g, want, atol=1e-4 * np.abs(want).max())
    full = np.zeros((len(w.embed), attention.DIM))
    for x in each:
        full[x[2]] += x[3] / n
    assert np.allclose(d_embed, full[known], atol=1e-4 * np.abs(full).max())


def test_sums_within_range_are_not_made_anew(monkeypatch):
    """Attention sums up to some 1e20 need no second pass, in training or in scoring."""
    r = np.random.default_rng(7)
    texts = [r.integers(0, 20, n) for n in (0, 31, 200, 900)]
    model = attention.fit(texts, 20, steps=20, batch=8)
    w = model.weights
    x = w.embed[:, None] + w.place
    q, k = (x.reshape(-1, attention.DIM) @ w.qkv[:, i * attention.DIM : (i + 1) * attention.DIM] for i in range(2))
    w.qkv *= np.float32(math.sqrt(45 / (np.abs(q @ k.T).max() / math.sqrt(attention.DIM))))
    monkeypatch.setattr(attention, "_mended", lambda *_: pytest.fail("rows were made anew"))
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.log_probs(np.concatenate(texts), ends)
    wide = attention.Weights(*[p.astype(np.float64) for p in w.parts()])
    assert np.allclose(got, [one_by_one(attention.Model(wide, model.kind, model.share), t.tolist()) for t in texts], rtol=1e-4)
    ids, kind = r.integers(0, 20, (40, attention.WINDOW)), r.integers(0, attention.CLASSES, (40, attention.WINDOW))
    narrow, want = attention.gradients(w, ids, kind), attention.gradients(wide, ids, kind)
    for g, h in zip([*narrow[1], narrow[3]], [*want[1], want[3]], strict=True):
        assert np.allclose(g, h, atol=1e-4 * np.abs(h).max())


def test_scores_where_exponentials_leave_their_range():
    r = np.random.default_rng(6)
    model = attention.fit([r.integers(0, 50, 400) for _ in range(5)], 50, steps=20, batch=8)
    model.weights.qkv *= np.float32(20)
    x = model.weights.embed[:-1] @ model.weights.qkv[:, : 2 * attention.DIM]
    assert np.abs(x[:, : attention.DIM] @ x[:, attention.DIM :].T).max() / math.sqrt(attention.DIM) > 100
    texts = [r.integers(0, 50, n) for n in (0, 1, 31, 56, 200)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.log_probs(np.concatenate(texts), ends)
    wide = attention.Model(attention.Weights(*[p.astype(np.float64) for p in model.weights.parts()]), model.kind, model.share)
    assert np.allclose(got, [one_by_one(wide, t.tolist()) for t in texts], rtol=1e-3)


def test_model_learns_order():
    """A held-out text of the same chain is likelier than by its ids' counts alone."""
    r = np.random.default_rng(2)

    def chain(n):
        out = [0]
        for _ in range(n):
            out.append((out[-1] * 3 + 1) % 40 if r.random() < 0.9 else int(r.integers(0, 40)))
        return np.array(out)

    model = attention.fit([chain(500) for _ in range(20)], 40, steps=300, batch=32)
    text = chain(400)
    counts = np.bincount(np.concatenate([chain(500) for _ in range(20)]), minlength=40) + 0.5
    alone = np.log(counts / counts.sum())[text].sum()
    assert model.log_probs(text, np.array([0, len(text)]))[0] > alone + 100


def test_words_leave_arrow_without_a_scalar_each():
    """Hashes of Arrow's words are those of their strings, in a slice as well."""
    texts = ["the", "", "ÉCLAIR", "a\x00b", "日本語", "z" * 5000, "the"]
    every = pa.array(texts)
    for part, want in ((every, texts), (every.slice(2, 3), texts[2:5]), (every.slice(0, 0), [])):
        assert lm.strings(part) == want
        assert lm.hashes(part).tolist() == [xxhash.xxh3_64_intdigest(w) for w in want]


def test_head_finds_words_in_any_order():
    r = np.random.default_rng(8)
    head = object.__new__(lm.Head)
    head.word = np.unique(r.integers(0, 2**63, 50, dtype=np.uint64) * 2)
    asked = r.permutation(np.concatenate([head.word[::3], head.word[::7] + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)]))
    at, found = head.find(asked)
    assert found.tolist() == np.isin(asked, head.word).tolist()
    assert (head.word[at[found]] == asked[found]).all()


def test_packed_and_unpacked():
    rows = [[1, 2, 3], [], [50_000], [7] * 100, []]
    till = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    column = lm.packed(np.concatenate(rows).astype(np.int32), till)
    for part, want in ((column, rows), (column.slice(1, 3), rows[1:4]), (column.slice(4), rows[4:]), (column.slice(0, 0), [])):
        ids, ends = lm.unpacked(part)
        assert [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:], strict=True)] == want
        assert len(ends) == len(want) + 1


def test_classes_rest_on_all_training_documents(spark):
    """Subword ids that only documents outside the first sample have are counted, too."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = lm.default_tokenizer()
    use = lm.subwords(path)
    want = np.zeros(use.size + 1, dtype=np.int64)
    for _, text in rows:
        for word in tokens(text)[:-1]:
            want += np.bincount(np.frombuffer(use.make(word), "<i4"), minlength=len(want))
    want[-1] = len(rows)
    got = lm.id_counts(lm.encoded(lm.word_counts(docs), path), len(rows), use.size)
    assert (got == want).all()
    model = lm.fit(docs, path, got, sample=2)
    assert (model.kind == attention.classes(want)[0]).all() and (model.share == attention.classes(want)[1]).all()


def test_scores_follow_documents_outside_the_sample(spark):
    """Texts like those that only the rest of the training documents holds become likelier."""
    common = [(i, "the cat sat on the mat and the dog lay by the door") for i in range(40)]
    rest = [(100 + i, "zebra quartz violin harbor " * 20) for i in range(40)]
    asked = [(1001, "zebra quartz violin harbor " * 10)]
    picked = {r.doc_id for r in lm.smallest(spark.createDataFrame(common + rest, "doc_id long, text string"), "doc_id", 3).collect()}
    rows = common + [r for r in rest if r[0] not in picked]

    def score(learn):
        df = spark.createDataFrame(learn + asked, "doc_id long, text string")
        return {r.doc_id: r.score for r in lm.scored(df, F.col("doc_id") < 1000, sample=3).collect()}[1001]

    first = [r for r in rows if r[0] in picked]
    assert score(rows) > score(first or common) + 20


def test_shards_predict_each_id_once_whatever_the_batches():
    r = np.random.default_rng(4)
    texts = [r.integers(0, 40, n) for n in (700, 0, 31, 500, 64, 1)]
    start = attention.fit(texts, 40, steps=3, batch=4)
    results = []
    for cut in ([6], [1, 5], [1] * 6):
        shard, at = attention.Shard(start, batch=4), 0
        for n in cut:
            part = texts[at : at + n]
            shard.add(np.concatenate(part), np.concatenate([[0], np.cumsum([len(t) for t in part])]))
            at += n
        results.append(shard.done())
    for other in results[1:]:
        assert all((a == b).all() for a, b in zip(results[0], other, strict=True))
    at, weight, values = results[0]
    n = sum(len(t) + 1 for t in texts)
    assert n <= shard.seen.sum() < n + attention.WINDOW
    made = attention.replaced(start, at, values)
    assert all((a == b).all() for a, b in zip(made.weights.parts(), shard.trainer.weights.parts(), strict=True))
    assert all((a != b).any() for a, b in zip(made.weights.parts(), start.weights.parts(), strict=True))
