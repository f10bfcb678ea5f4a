"""Weighted shingles and ProbMinHash sketches in numpy.

Every shingle of weight w sends arrivals at rate w, each to a random register; a
register keeps the shingle of its earliest arrival. Two documents' registers then agree
with the probability Jaccard similarity of their shingle weights. Arrivals are drawn
for all documents of a batch at once and stop as soon as every register has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words of a shingle.
WORDS = 5

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value of each 64-bit value."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


def words(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of each text, and where each text's words begin and end.

    Words are parted by ASCII white space; null texts have none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(values, ""))
    flat, ends = lists.values, lists.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    ends = np.concatenate([[0], np.cumsum(full)])[ends]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    return known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64), ends


def shingles(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, 32-bit shingle and weight of each distinct shingle, by document and shingle.

    A text of fewer than five words has one shingle of all its words; one without words has none.
    """
    count = np.diff(ends)
    doc = np.repeat(np.arange(len(count)), count)
    with np.errstate(over="ignore"):
        h = np.zeros(max(len(hashes) - WORDS + 1, 0), dtype=np.uint64)
        for k in range(WORDS):
            h = mixed(h * _A + hashes[k : len(hashes) - WORDS + 1 + k]) if len(h) else h
        inside = doc[: len(h)] == doc[WORDS - 1 :]
        parts = [(doc[: len(h)][inside].astype(np.uint64) << np.uint64(32)) | (h[inside] >> np.uint64(32))]
        for d in np.flatnonzero((count > 0) & (count < WORDS)):
            one = np.full(1, count[d], dtype=np.uint64)
            for w in hashes[ends[d] : ends[d + 1]]:
                one = mixed(one * _A + w)
            parts.append((np.full(1, d, np.uint64) << np.uint64(32)) | (one >> np.uint64(32)))
    keys = np.sort(np.concatenate(parts))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32), weight


def sketches(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The shingle in each register of each of n documents; 0 where a document has none."""
    out = np.zeros((n, registers), dtype=np.uint32)
    total = np.bincount(doc, weights=weight, minlength=n)
    asked = np.flatnonzero(total)
    if not len(asked):
        return out
    # Registers are full after about log(registers) arrivals each; three more make most documents full at once.
    until = np.zeros(n)
    until[asked] = registers * (np.log(registers) + 3) / total[asked]
    best = np.full(n * registers, np.inf)
    kept = out.reshape(-1)
    seed, k = shingle.astype(np.uint64), np.ones(len(doc), dtype=np.uint64)
    draw, gap = _arrival(seed, k)
    at = gap / weight
    todo = np.arange(len(doc))
    while True:
        live = todo[at[todo] <= until[doc[todo]]]
        found = []
        while len(live):
            found.append((doc[live] * registers + (mixed(draw[live]) % np.uint64(registers)).astype(np.int64), at[live], shingle[live]))
            k[live] += np.uint64(1)
            draw[live], gap = _arrival(seed[live], k[live])
            at[live] += gap / weight[live]
            live = live[at[live] <= until[doc[live]]]
        if found:
            where, when, what = (np.concatenate(x) for x in zip(*found, strict=True))
            np.minimum.at(best, where, when)
            first = when == best[where]
            kept[where[first]] = what[first]
        short = np.isinf(best.reshape(n, registers)).any(axis=1) & (total > 0)
        if not short.any():
            return out
        until[short] *= 2
        todo = todo[short[doc[todo]]]


def _arrival(seed: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k-th random draw of each shingle, and the exponential gap before its k-th arrival."""
    with np.errstate(over="ignore"):
        draw = mixed(mixed(seed + _A) + k * _A)
    return draw, -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The probability Jaccard similarity of two weighted sets, each ascending.

    The sum over common i of 1 / sum_j max(a_j / a_i, b_j / b_i). With all weights
    equal in each set it is the Jaccard similarity.
    """
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    ca, cb = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    ratio = ca / cb
    order = np.argsort(ratio, kind="stable")
    r, ca, cb = ratio[order], ca[order], cb[order]
    # Elements of a alone have an infinite ratio, those of b alone 0.
    rest_a, rest_b = float(wa.sum()) - ca.sum(), float(wb.sum()) - cb.sum()
    lower = np.searchsorted(r, r, side="left")
    sum_a, sum_b = np.concatenate([[0], np.cumsum(ca)]), np.concatenate([[0], np.cumsum(cb)])
    above = sum_a[-1] - sum_a[lower] + rest_a
    below = sum_b[lower] + rest_b
    return float((1 / (above / ca + below / cb)).sum())
