import random

import pytest

from tidemark.llm import mixing


def test_targets_stop_at_twice_the_size():
    sizes = {"a": 10, "b": 1000, "c": 100, None: 0}
    got = {s.source: s.target for s in mixing.targets(sizes, mixing.cycle_weights(list(sizes)))}
    assert got["a"] == 20 and got[None] == 0 and sum(got.values()) == pytest.approx(1.5 * 1110)
    assert got["b"] == pytest.approx(2 * got["c"]) or got["c"] == 200


def rounds(sizes, weights, share=1.5, most=2.0):
    """Targets by sharing out again and again, as the contract says it."""
    caps, free = {s: most * n for s, n in sizes.items()}, set(sizes)
    while free:
        level = (share * sum(sizes.values()) - sum(caps[s] for s in sizes if s not in free)) / sum(weights[s] for s in free)
        above = {s for s in free if weights[s] * level > caps[s]}
        if not above:
            break
        free -= above
    return {s: weights[s] * level if s in free else caps[s] for s in sizes}


def test_targets_equal_rounds():
    r = random.Random(1)
    for n in (1, 2, 5, 40):
        for _ in range(50):
            sizes = {f"s{i}": r.choice([0, 1, 7, r.randrange(10**r.randint(1, 9))]) for i in range(n)}
            weights = mixing.cycle_weights(list(sizes))
            assert {s.source: s.target for s in mixing.targets(sizes, weights)} == pytest.approx(rounds(sizes, weights))


def test_targets_of_very_many_sources():
    sizes = {f"s{i}": i % 977 for i in range(200_000)}
    got = mixing.targets(sizes, mixing.cycle_weights(list(sizes)))
    assert sum(s.target for s in got) == pytest.approx(1.5 * sum(sizes.values()))


def test_weights_by_code_point_null_last():
    assert mixing.cycle_weights([None, "b", "é", "B", "a"]) == {"B": 5, "a": 2, "b": 1, "é": 5, None: 2}


def test_mix_comes_near_and_nests(spark):
    rows = [(i, "w " * (1 + i % 40), f"s{i % 3}" if i % 7 else None) for i in range(3000)] + [(5000 + i, None, "s0") for i in range(5)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size long")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(mixing.mix(docs).collect()) == sorted(got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.taken <= 2 * r.size for r in own)


def test_thresholds_equal_brute_force(spark):
    rows = spark.range(4000).selectExpr(
        "'k' as key",
        "cast(id as string) as d",
        "cast(id % 13 as long) as size",
    ).withColumn("hash", mixing.row_hash(mixing.F.col("d"))).select("key", "hash", "size")
    order = sorted((r.hash, r["size"]) for r in rows.collect())
    for budget in (1.0, 777.0, 12_345.5, 23_000.0):
        cut = mixing.thresholds(rows, {"k": budget}, {"k": sum(s for _, s in order)})["k"]
        taken = sum(s for h, s in order if h < cut)
        best = min(abs(sum(s for _, s in order[:i]) - budget) for i in range(len(order) + 1))
        assert abs(taken - budget) == pytest.approx(best)


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix(spark.createDataFrame([(None, None, None), (None, None, None)], schema)).collect()
    assert [(r["size"], r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


def test_mixed_repeats_rows(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i % 9), "a" if i % 4 else None, i) for i in range(200)] + [(7, None, None, 7)],
        "doc_id long, text string, source string, base long",
    )
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in want.items() if n}
