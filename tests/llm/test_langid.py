import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid

TABLES = "/root/testdata/sf0.01"


def slow_grams(text):
    """N-grams by definition, as tuples of code points."""
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    low = " " + " ".join(low.split(" ")).strip() + " "
    while "  " in low:
        low = low.replace("  ", " ")
    return [low[i : i + n] for n in langid.SIZES for i in range(len(low) - n + 1) if low[i : i + n].strip()]


@pytest.mark.parametrize("text", ["", "A", "The cat, sat!", "né à l'été 12", "漢字 x🙂y", "a" * 1000])
def test_grams(text):
    got, want = langid.grams(langid.letters(text)), slow_grams(text)
    assert len(got) == len(want)
    if any(c.isalpha() for c in text):
        assert len(set(got.tolist())) == len(set(want))


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(3)
    sets = {k: rng.integers(0, 2**63, 20_000, dtype=np.uint64) for k in ("a", "b", "c")}
    model = langid.model_of(sets)
    assert (model.counts(sets["b"])[1]) == 20_000
    other = rng.integers(0, 2**63, 200_000, dtype=np.uint64)
    assert np.allclose(model.counts(other) / len(other), model.false, atol=2e-4)


def test_sliced_counts_equal_one_filter_each():
    rng = np.random.default_rng(4)
    sets = {k: rng.integers(0, 2**63, 5000, dtype=np.uint64) for k in ("a", "b")}
    both, probe = langid.model_of(sets), rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    probe[:5000] = sets["a"]
    for i, k in enumerate(("a", "b")):
        assert both.counts(probe)[i] == langid.model_of({k: sets[k]}).counts(probe)[0]


def prose(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(n))


def brute(rows, asked):
    """Language and exact shares by sets of n-grams, without hashes or filters."""
    seen = {}
    for text, lang in rows:
        for g in set(slow_grams(text)):
            seen.setdefault(g, {}).setdefault(lang, 0)
            seen[g][lang] += 1
    docs = {k: sum(x == k for _, x in rows) for _, k in rows}
    sets = {k: set() for k in docs}
    for g, by in seen.items():
        most = max(n / docs[k] for k, n in by.items())
        for k, n in by.items():
            if n >= langid.LEAST_DOCS and n / docs[k] >= langid.LEAST_SHARE and n / docs[k] >= langid.LEAST_OF_MOST * most:
                sets[k].add(g)
    out = []
    for text in asked:
        hits = {k: sum(g in own for g in slow_grams(text)) for k, own in sorted(sets.items())}
        top = max(hits.values())
        out.append(({k for k in hits if hits[k] == top}, top / sum(hits.values()) if top else 1 / len(hits)))
    return sets, out


@pytest.mark.parametrize("languages", [3, 70])
def test_fit_and_predict_equal_brute_force(spark, languages):
    """Also with more languages than a word of the filter has bits."""
    r = random.Random(languages)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    own = {f"l{i:02}": r.sample(alphabet, 9) for i in range(languages)}
    rows = [(prose(r, own[k], r.randint(3, 40)), k) for k in own for _ in range(8)]
    asked = [prose(r, own[r.choice(sorted(own))], r.randint(1, 60)) for _ in range(60)] + [prose(r, alphabet, 20) for _ in range(5)]
    model = langid.fit(spark.createDataFrame(
        [(i, t, k, "s") for i, (t, k) in enumerate(rows)],
        "doc_id long, text string, lang string, source string",
    ))
    sets, want = brute(rows, asked)
    assert model.languages == tuple(sorted(own))
    assert (model.false < 1e-6).all()
    got = langid.predicted(
        spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string"),
        model,
    ).orderBy("doc_id").collect()
    for x, (best, score) in zip(got, want, strict=True):
        assert x.lang_pred in best and x.score == pytest.approx(score, abs=2e-3)


def test_sample_is_of_smallest_hash(spark):
    rows = spark.createDataFrame([(i, f"t{i}", "ab"[i % 3 == 0]) for i in range(900)], "doc_id long, text string, lang string")
    picked, totals = langid.sampled(rows, 20)
    got = {(x.lang, x.text) for x in picked.collect()}
    order = rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h").collect()
    want = {(k, x.text) for k in "ab" for x in [y for y in order if y.lang == k][:20]}
    assert got == want and totals == {"a": 20, "b": 20}


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string"
    rows = [(i, t, k, "s") for i, (t, k) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)]
    model = langid.fit(spark.createDataFrame([*rows, (50, None, "en", "s"), (51, "x", None, "s")], schema))
    assert model.languages == ("de", "en")
    asked = spark.createDataFrame(
        [(None, "the cat", 1.0), (1, None, 1.0), (1, "", 1.0), (2, "12 !?", 1.0), (3, "und der hund " * 50_000, 1.0)],
        "doc_id long, text string, score double",
    )
    got = [(r.lang_pred, r.score) for r in langid.predicted(asked, model).collect()]
    assert [p for p, _ in got] == ["en", "und", "und", "und", "de"] and all(0 <= s <= 1 for _, s in got)
    none = langid.fit(spark.createDataFrame([], schema))
    assert [r.lang_pred for r in langid.predicted(asked, none).collect()] == ["und"] * 5
    assert langid.predicted(asked.limit(0), model).count() == 0


def test_remainder(spark):
    got = spark.createDataFrame([(k,) for k in (0, 1, 77, -5)], "k long").select("k", langid.remainder(F.col("k"), 5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.k).encode()) % 5 for r in got)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang")
    got = langid.op6_language(spark, TABLES).join(docs, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97
