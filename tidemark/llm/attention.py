"""A small causal self-attention model over subword ids, in numpy.

One attention layer reads a window of ids; a softmax over classes of ids, equal in the
square roots of their counts, predicts the next id's class, and counts give the id
within its class. Training is by Adam with gradients written out; scoring cuts id
streams into overlapping windows, in which each id is scored once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Width of the model, ids of a window, ids by which windows move on, and classes.
DIM, WINDOW, STEP, CLASSES = 16, 32, 24, 48

#: Windows that are scored, and trained, at a time: few, so that a core's cache holds what they need.
WINDOWS_AT_ONCE, BLOCK = 64, 32

_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, dtype=np.float32), 1)
_SEEN = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))
_NONE = np.zeros(0, dtype=np.int64)


@dataclass
class Weights:
    embed: np.ndarray
    place: np.ndarray
    qkv: np.ndarray
    out: np.ndarray
    top: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.place, self.qkv, self.out, self.top, self.bias]


@dataclass(frozen=True)
class Model:
    """Weights, each id's class, and the log of its share within the class. The last id ends a text."""

    weights: Weights
    kind: np.ndarray
    share: np.ndarray

    @property
    def end(self) -> int:
        return len(self.kind) - 1

    def log_probs(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log probability of each stream ids[ends[i]:ends[i + 1]], its end included."""
        length = np.diff(ends) + 1
        at = np.concatenate([[0], np.cumsum(length)])
        stream = np.full(at[-1] + 1, self.end, dtype=np.int64)  # an end before and behind each stream
        inside = np.arange(len(ids)) + np.repeat(np.arange(len(length)), length - 1) + 1
        stream[inside] = ids
        # Input t of a stream is stream[at + t]; it predicts stream[at + t + 1]. A stream's
        # first window scores all its ids, each later one its last STEP.
        more = np.maximum(0, -(-(length - WINDOW) // STEP))
        each = np.arange(len(length))
        which = np.repeat(each, more)
        k = np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more) + 1
        total = self._windows(stream, at[:-1], at[1:], 0, each, len(length))
        return total + self._windows(stream, at[which] + k * STEP, at[which + 1], WINDOW - STEP, which, len(length))

    def _windows(self, stream: np.ndarray, start: np.ndarray, till: np.ndarray, skip: int, which: np.ndarray, n: int) -> np.ndarray:
        """Sums by ``which`` of the log probabilities behind each window's inputs from ``skip`` on, up to ``till``."""
        w, total = self.weights, np.zeros(len(start))
        both, top = _folded(w), np.concatenate([w.top, w.bias[None]])
        outputs = np.arange(skip, WINDOW)
        for i in range(0, len(start), WINDOWS_AT_ONCE):
            s, t = start[i : i + WINDOWS_AT_ONCE, None], till[i : i + WINDOWS_AT_ONCE, None]
            ids = stream.take(np.minimum(s + np.arange(WINDOW + 1), len(stream) - 1))
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                found = self._found(ids, skip, both, top)
            found[s + outputs >= t] = 0
            total[i : i + WINDOWS_AT_ONCE] = found.sum(axis=1, dtype=np.float64)
        return np.bincount(which, weights=total, minlength=n)

    def _found(self, ids: np.ndarray, skip: int, both: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Log probabilities behind the inputs of a few windows."""
        w, ones = self.weights, np.ones(CLASSES, np.float32)
        x = w.embed.take(ids[:, :-1], axis=0)
        x += w.place
        uv = (x.reshape(-1, DIM) @ both).reshape(len(ids), WINDOW, 2 * DIM)
        u = uv[:, skip:, :DIM]
        a = np.matmul(u, x.transpose(0, 2, 1).copy())
        np.exp(a, out=a)
        a *= _SEEN[skip:]
        total = a.reshape(-1, WINDOW) @ ones[:WINDOW]
        if len(odd := _outside(total)):
            _mended(a.reshape(-1, WINDOW), total, odd, _asked(u, x, odd))
        y = np.matmul(a, uv[..., DIM:])
        y /= total.reshape(*y.shape[:2], 1)
        h = np.empty((len(total), DIM + 1), np.float32)
        h[:, DIM] = 1
        np.add(x[:, skip:], y, out=h[:, :DIM].reshape(y.shape))
        p = h @ top
        target = ids[:, skip + 1 :].reshape(-1)
        picked = p.take(np.arange(len(target)) * CLASSES + self.kind.take(target))
        np.exp(p, out=p)
        mass = p @ ones
        if len(odd := _outside(mass)):
            picked[odd] -= _mended(p, mass, odd, h[odd] @ top)
        return (picked - np.log(mass) + self.share.take(target)).reshape(len(ids), -1)


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id's class, of equal sums of square roots, and the log share within it, from counts + 0.5."""
    n = counts + 0.5
    order = np.argsort(-n, kind="stable")
    root = np.cumsum(np.sqrt(n[order]))
    kind = np.empty(len(n), dtype=np.int64)
    kind[order] = np.minimum((root / root[-1] * CLASSES).astype(np.int64), CLASSES - 1)
    return kind, (np.log(n) - np.log(np.bincount(kind, weights=n, minlength=CLASSES)[kind])).astype(np.float32)


def _outside(total: np.ndarray) -> np.ndarray:
    """Rows where sums of exponentials left the range in which they are shares but for the division."""
    if total.min() > 1e-25 and total.max() < 1e25:
        return _NONE
    return np.flatnonzero(~((total > 1e-25) & (total < 1e25)))


def _mended(raw: np.ndarray, total: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Exponentials and sums of some rows are made anew from scores less their maxima, which are returned."""
    most = scores.max(axis=1)
    raw[rows] = again = np.exp(scores - most[:, None])
    total[rows] = again.sum(axis=1)
    return most


def _asked(q: np.ndarray, k: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Attention scores of some rows of the last queries of windows, counted through."""
    which, place = np.divmod(rows, q.shape[1])
    return np.matmul(k[which], q[which, place][..., None])[..., 0] + _MASK[place + WINDOW - q.shape[1]]


def gradients(w: Weights, ids: np.ndarray, kind: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray, np.ndarray]:
    """Mean loss of windows, gradients of all weights but embed, and embed's by id of the windows."""
    found, *rest = _gradients(w, ids, kind)
    return float(-np.log(found + 1e-30).mean()), *rest


def _gradients(w: Weights, ids: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """The same, with the ids' probabilities instead of the loss."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        found, dx, sums = _passes(w, ids, kind)
    # Sorted with their places behind them, which is faster than an order of the places.
    flat_ids = ids.reshape(-1).astype(np.int64)
    place = max(1, (len(flat_ids) - 1).bit_length())
    both = np.sort(flat_ids << place | np.arange(len(flat_ids)))
    sorted_ids = both >> place
    first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
    d_embed = np.add.reduceat(dx.take(both & (1 << place) - 1, axis=0), first, axis=0)
    d_qkv, d_out, d_top = sums
    return found, [dx.reshape(ids.shape + (DIM,)).sum(axis=0), d_qkv, d_out, d_top[:-1], d_top[-1]], sorted_ids[first], d_embed


def _folded(w: Weights) -> np.ndarray:
    """The queries' and keys' product, scaled, beside the values' and outputs': attention by inputs alone."""
    q, k, v = w.qkv[:, :DIM], w.qkv[:, DIM : 2 * DIM], w.qkv[:, 2 * DIM :]
    return np.concatenate([q @ k.T * w.qkv.dtype.type(DIM**-0.5), v @ w.out], axis=1)


def _unfolded(w: Weights, d_both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of qkv and out from those of what ``_folded`` makes of them."""
    q, k, v = w.qkv[:, :DIM], w.qkv[:, DIM : 2 * DIM], w.qkv[:, 2 * DIM :]
    d_scores, d_values = d_both[:, :DIM] * w.qkv.dtype.type(DIM**-0.5), d_both[:, DIM:]
    return np.concatenate([d_scores @ k, d_scores.T @ q, d_values @ w.out.T], axis=1), v.T @ d_values


def _passes(w: Weights, ids: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The ids' probabilities, and gradients of inputs and weights.

    A few windows are passed at a time, so that what stands between the products stays in
    a core's cache. Neither attention shares nor probabilities are divided out: what stands
    beside them is scaled instead, which is as wide as the model and no wider. Maxima are
    taken off before exponentials only in rows whose sums left their range.
    """
    real, size = w.embed.dtype.type, ids.size
    both, top = _folded(w), np.concatenate([w.top, w.bias[None]])
    back, back_top = np.ascontiguousarray(both.T), np.ascontiguousarray(w.top.T)
    seen, ones = _SEEN.astype(real, copy=False), np.ones(CLASSES, real)
    every = w.embed.take(ids, axis=0)
    every += w.place
    dx, found = np.empty((size, DIM), real), np.empty(size, real)
    d_both, d_top = np.zeros_like(both), np.zeros_like(top)
    targets = np.arange(size) % (BLOCK * WINDOW) * CLASSES + kind.reshape(-1)
    for i in range(0, len(ids), BLOCK):
        x = every[i : i + BLOCK]
        here = slice(i * WINDOW, (i + len(x)) * WINDOW)
        flat_x, target, n = x.reshape(-1, DIM), targets[here], len(x) * WINDOW
        uv = (flat_x @ both).reshape(-1, WINDOW, 2 * DIM)
        u, v = uv[..., :DIM], uv[..., DIM:]
        a = np.matmul(u, x.transpose(0, 2, 1).copy())
        np.exp(a, out=a)
        a *= seen
        total = a.reshape(n, WINDOW) @ ones[:WINDOW]
        if len(odd := _outside(total)):
            _mended(a.reshape(n, WINDOW), total, odd, _asked(u, x, odd))
        total = total.reshape(-1, WINDOW, 1)
        y = np.matmul(a, v)
        y /= total
        flat_y = y.reshape(n, DIM)
        h = np.empty((n, DIM + 1), real)
        h[:, DIM] = 1
        np.add(flat_x, flat_y, out=h[:, :DIM])
        p = h @ top
        np.exp(p, out=p)
        mass = p @ ones
        if len(odd := _outside(mass)):
            _mended(p, mass, odd, h[odd] @ top)
        flat_p = p.reshape(-1)
        picked = flat_p.take(target)
        np.divide(picked, mass, out=found[here])
        picked -= mass
        flat_p[target] = picked
        share = (1 / (mass * real(size)))[:, None]
        h *= share
        d_top += h.T @ p
        dh = p @ back_top
        dh *= share
        dy = dh.reshape(y.shape) / total
        y *= dy
        ds = np.matmul(dy, v.transpose(0, 2, 1).copy())
        ds -= (flat_y @ ones[:DIM]).reshape(total.shape)
        ds *= a
        each = np.empty_like(uv)
        np.matmul(ds, x, out=each[..., :DIM])
        np.matmul(a.transpose(0, 2, 1), dy, out=each[..., DIM:])
        flat_each = each.reshape(n, 2 * DIM)
        d_both += flat_x.T @ flat_each
        dh += np.matmul(ds.transpose(0, 2, 1), u).reshape(n, DIM)
        np.add(flat_each @ back, dh, out=dx[here])
    d_qkv, d_out = _unfolded(w, d_both)
    return found, dx, [d_qkv, d_out, d_top]


def fresh(vocabulary: int, seed: int = 0) -> Weights:
    r = np.random.default_rng(seed)
    normal = lambda scale, *shape: (scale * r.standard_normal(shape)).astype(np.float32)
    return Weights(
        normal(0.3, vocabulary, DIM),
        normal(0.1, WINDOW, DIM),
        normal(DIM**-0.5, DIM, 3 * DIM),
        normal(0.1, DIM, DIM),
        normal(0.1, DIM, CLASSES),
        np.zeros(CLASSES, np.float32),
    )


class Trainer:
    """Adam on weights that it changes in place."""

    def __init__(self, weights: Weights, kind: np.ndarray):
        self.weights, self.kind, self.steps = weights, kind, 0
        # Moments of embed, and of all others one after another.
        self.first, self.second = ([np.zeros_like(weights.embed), np.zeros(sum(p.size for p in weights.parts()[1:]), weights.embed.dtype)] for _ in range(2))

    def step(self, window: np.ndarray, rate: float) -> None:
        """One step by windows of WINDOW + 1 ids."""
        self.steps += 1
        _, grads, known, d_embed = _gradients(self.weights, window[:, :-1], self.kind[window[:, 1:]])
        embed = self.weights.embed
        first, second = (x.take(known, axis=0) for x in (self.first[0], self.second[0]))
        moved = self._moved(first, second, d_embed, rate)
        self.first[0][known], self.second[0][known] = first, second
        embed[known] = embed.take(known, axis=0) - moved
        moved, at = self._moved(self.first[1], self.second[1], np.concatenate([g.reshape(-1) for g in grads]), rate), 0
        for p in self.weights.parts()[1:]:
            p -= moved[at : at + p.size].reshape(p.shape)
            at += p.size

    def _moved(self, first: np.ndarray, second: np.ndarray, grad: np.ndarray, rate: float) -> np.ndarray:
        """What is taken off weights, whose moments are changed in place."""
        first *= 0.9
        first += 0.1 * grad
        second *= 0.99
        second += 0.01 * grad * grad
        out = first * (rate / (1 - 0.9**self.steps))
        scale = second / (1 - 0.99**self.steps)
        np.sqrt(scale, out=scale)
        scale += 1e-8
        out /= scale
        return out


def fit(
    streams: list[np.ndarray],
    vocabulary: int,
    steps: int = 2000,
    batch: int = 128,
    rate: float = 0.02,
    seed: int = 0,
    counts: np.ndarray | None = None,
) -> Model:
    """Train on streams of ids below ``vocabulary``; the end is added as a further id.

    Classes, shares and the first bias are those of ``counts``, or else of the streams.
    """
    end = vocabulary
    joined = np.concatenate([np.append(s, end) for s in streams]) if streams else np.array([end])
    counts = np.bincount(joined, minlength=vocabulary + 1) if counts is None else counts
    kind, share = classes(counts)
    w = fresh(vocabulary + 1, seed)
    w.bias[:] = np.log(np.bincount(kind, weights=counts + 0.5, minlength=CLASSES) / (counts + 0.5).sum() + 1e-12)
    joined = np.concatenate([[end], joined, np.full(max(0, WINDOW + 1 - len(joined)), end)])
    r = np.random.default_rng(seed + 1)
    trainer = Trainer(w, kind)
    for step in range(1, steps + 1 if streams else 1):
        start = r.integers(0, len(joined) - WINDOW, batch)
        trainer.step(joined[start[:, None] + np.arange(WINDOW + 1)], rate * min(1.0, step / 50) * (1 - 0.9 * step / steps))
    return Model(w, kind, share)


class Shard:
    """A model trained further on a shard of the texts: each id is predicted once.

    Windows follow the ids alone, not the batches in which they come.
    """

    def __init__(self, model: Model, batch: int = 128, rate: float = 0.004):
        w = Weights(*[p.copy() for p in model.weights.parts()])
        self.trainer, self.end, self.batch, self.rate = Trainer(w, model.kind), model.end, batch, rate
        self.rest, self.seen = np.array([model.end]), np.zeros(model.end + 1)

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """The texts ids[ends[i]:ends[i + 1]], each with its end."""
        joined = np.concatenate([self.rest, np.insert(ids, ends[1:], self.end)])
        size = self.batch * WINDOW
        at = 0
        while len(joined) - at > size:
            self._step(self._windows(joined, at + WINDOW * np.arange(self.batch)))
            at += size
        self.seen += np.bincount(joined[:at], minlength=len(self.seen))
        self.rest = joined[at:].copy()

    @staticmethod
    def _windows(joined: np.ndarray, start: np.ndarray) -> np.ndarray:
        return joined[start[:, None] + np.arange(WINDOW + 1)]

    def _step(self, window: np.ndarray) -> None:
        self.trainer.step(window, self.rate / (1 + self.trainer.steps / 300))

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``flat`` that were trained, the weight of each in a mean of shards, and their values."""
        if len(self.rest) > 1:
            joined = np.concatenate([self.rest, np.full(max(0, WINDOW + 1 - len(self.rest)), self.end)])
            # The last window ends with the last id, so a few before it may be predicted again.
            window = self._windows(joined, np.minimum(np.arange(0, len(self.rest) - 1, WINDOW), len(joined) - WINDOW - 1))
            self._step(window)
            self.seen += np.bincount(window[:, :-1].reshape(-1), minlength=len(self.seen))
            self.rest = self.rest[-1:]
        values = flat(self.trainer.weights)
        weight = np.concatenate([self.seen, np.full(len(values) - len(self.seen), self.seen.sum())])
        rows = np.flatnonzero(weight)
        return rows, weight[rows], values[rows]


def flat(w: Weights) -> np.ndarray:
    """All weights as rows of DIM, those of the ids first."""
    return np.concatenate([p.reshape(-1, DIM) for p in w.parts()])


def replaced(model: Model, rows: np.ndarray, values: np.ndarray) -> Model:
    """The model with other values in some rows of ``flat``."""
    every = flat(model.weights)
    every[rows] = values
    sizes = np.cumsum([p.size // DIM for p in model.weights.parts()])[:-1]
    parts = [x.reshape(p.shape) for x, p in zip(np.split(every, sizes), model.weights.parts(), strict=True)]
    return Model(Weights(*parts), model.kind, model.share)
