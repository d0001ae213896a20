"""A causal self-attention model of subword ids, in numpy.

Inputs are embedded ids, each with a projection of the one before it added.
One attention layer looks back over the window, with a learned weight for each
distance; a hidden layer follows, and both add to the input's own embedding.
The next id is told in two steps, its class and its place in the class, each
by a softmax over products of the block's output with learned vectors.  Classes
have about the same mass each; a class of more than ``WIDE`` ids (of rare and
unseen ones) shares its mass by counts.

A text is cut into blocks of ``STRIDE`` inputs.  A block's window is the block
before it and itself, so windows overlap by ``STRIDE`` and each id is scored
once, in the window that ends with its block; every input looks back at
``STRIDE`` others at least, or at its text's beginning.  Embeddings of a block
are made once and read by both of its windows, as keys and as values: the
matrix of keys is taken into that of queries, and that of values is applied to
the sums, which gives the same numbers.
"""

from __future__ import annotations

import numpy as np

STRIDE = 16
SPAN = 2 * STRIDE
WIDTH, HIDDEN, CLASSES, WIDE = 16, 8, 24, 512
SMOOTHING = 0.1

Weights = dict[str, np.ndarray]


class Vocabulary:
    """Places of ids by frequency, and their classes, from training counts.

    ``place`` is an id's place in the embeddings: seen ids by falling count, all unseen ones share the last.
    Ids of class c are ``order[edge[c]:edge[c + 1]]``."""

    def __init__(self, counts: np.ndarray, classes: int | None = None):
        classes = classes or CLASSES
        self.order = np.lexsort((np.arange(len(counts)), -counts))
        rank = np.empty(len(counts), np.int64)
        rank[self.order] = np.arange(len(counts))
        self.seen = int((counts > 0).sum())
        self.place = np.minimum(rank, self.seen).astype(np.int32)
        mass = counts[self.order] + SMOOTHING
        whole = np.append(0.0, np.cumsum(mass))
        edge = [0]
        for c in range(classes):
            # Each class takes its part of what is left.
            part = whole[edge[-1]] + (whole[-1] - whole[edge[-1]]) / (classes - c)
            edge.append(min(len(mass), max(edge[-1] + 1, int(np.searchsorted(whole, part * (1 - 1e-12))))))
        edge[-1] = len(mass)
        self.edge = np.array(edge)
        self.rank = rank.astype(np.int32)
        self.sizes = np.diff(self.edge)
        self.classes = np.repeat(np.arange(classes), self.sizes)[rank].astype(np.int16)
        of_class = np.diff(whole[self.edge])
        self.prior = np.log(np.maximum(of_class, 1e-300) / whole[-1])
        self.share = np.log(mass / np.repeat(np.maximum(of_class, 1e-300), self.sizes))  # by rank
        #: Ids up to here have output vectors: their classes are narrow.
        self.narrow = int(self.edge[np.flatnonzero(self.sizes > WIDE)[0]]) if (self.sizes > WIDE).any() else len(mass)

    def shared_out(self) -> np.ndarray:
        """Classes whose ids are told apart by a softmax."""
        return np.flatnonzero((self.sizes > 1) & (self.sizes <= WIDE) & (self.edge[1:] <= self.narrow))


def first_weights(vocabulary: Vocabulary, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)

    def normal(*shape, scale=0.1):
        return (scale * rng.standard_normal(shape)).astype(np.float32)

    return {
        "E": normal(vocabulary.seen + 1, WIDTH, scale=0.3), "S": normal(WIDTH, WIDTH, scale=0.15), "Q": normal(WIDTH, WIDTH), "K": normal(WIDTH, WIDTH), "V": normal(WIDTH, WIDTH, scale=0.15),
        "R": (-0.7 * np.log1p(np.arange(SPAN))).astype(np.float32), "A": normal(WIDTH, HIDDEN, scale=0.2), "a": np.zeros(HIDDEN, np.float32), "B": normal(HIDDEN, WIDTH),
        "C": normal(WIDTH, CLASSES, scale=0.02), "c": vocabulary.prior.astype(np.float32), "U": normal(vocabulary.narrow, WIDTH, scale=0.02), "u": vocabulary.share[: vocabulary.narrow].astype(np.float32),
    }


def cut_blocks(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of a text's blocks, and which block is its first.  Targets after the text's end are -1."""
    n = len(ids) + 1
    count = -(-n // STRIDE)
    inputs, targets = np.full(count * STRIDE, end, np.int64), np.full(count * STRIDE, -1, np.int64)
    inputs[1:n], targets[: n - 1], targets[n - 1] = ids, ids, end
    return inputs.reshape(count, STRIDE), targets.reshape(count, STRIDE), np.arange(count) == 0


_DISTANCE = STRIDE + np.arange(STRIDE)[:, None] - np.arange(SPAN)[None, :]
_CAUSAL = (_DISTANCE >= 0).astype(np.float32)
_SCALE = np.float32(WIDTH**-0.5)
#: Logits are cut off here, far beyond what training reaches.
_LIMIT = np.float32(60)


def _windows(rows: np.ndarray, n: int) -> np.ndarray:
    """Each of n blocks after the block before it, as views of rows in which a block of zeros comes first."""
    row, each = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (n, SPAN, rows.shape[1]), (STRIDE * row, row, each), writeable=False)


def _across(rows: np.ndarray, n: int) -> np.ndarray:
    """The same windows transposed.  Products of small matrices take a third of the time if the right one isn't a
    transposed view, so the rows are laid across once."""
    rows = np.ascontiguousarray(rows.T)
    row, each = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (n, len(rows), SPAN), (STRIDE * each, row, each), writeable=False)


def _paired(w: Weights) -> np.ndarray:
    """The matrices of queries and keys in one: (e Q) (e K)' = (e Q K') e', so that embeddings serve as keys."""
    return w["Q"] @ w["K"].T * _SCALE


def _folded(windows: np.ndarray) -> np.ndarray:
    """The sum of what a block's two windows give it."""
    flat = windows.reshape(len(windows), -1)
    half = flat.shape[1] // 2
    out = flat[:, half:].copy()
    out[:-1] += flat[1:, :half]
    return out.reshape(-1, windows.shape[2])


def _total(a: np.ndarray) -> np.ndarray:
    """Sums of rows; a product is faster than a sum over short rows."""
    return a @ np.ones(a.shape[1], a.dtype)


#: Rows of one product of a sum of products.
_ROWS = 128


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of two tall arrays; stretches of rows that stay in the cache take half the time."""
    n = len(a) // _ROWS * _ROWS
    out = a[n:].T @ b[n:]
    if n:
        out += np.matmul(a[:n].reshape(-1, _ROWS, a.shape[1]).transpose(0, 2, 1), b[:n].reshape(-1, _ROWS, b.shape[1])).sum(0)
    return out


def _times(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """a @ b of a tall array and a small one, by such stretches; faster too."""
    n = len(a) // (4 * _ROWS) * 4 * _ROWS
    if out is None:
        out = np.empty((len(a), b.shape[1]), a.dtype)
    if n:
        np.matmul(a[:n].reshape(-1, 4 * _ROWS, a.shape[1]), b, out=out[:n].reshape(-1, 4 * _ROWS, b.shape[1]))
    if n < len(a):
        np.matmul(a[n:], b, out=out[n:])
    return out


def _turned(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a.T)


#: Row sums between these show that no logit went beyond the limit and that those below it count for nothing.
_LEAST, _MOST = np.exp(np.float32(-30)), np.exp(_LIMIT)


def _ordinary(sums: np.ndarray) -> bool:
    return not sums.size or bool(_LEAST <= sums.min() and sums.max() <= _MOST)


def _exps(rows: np.ndarray, columns: np.ndarray, limited: bool) -> np.ndarray:
    """exp(rows @ columns), with logits cut off at the limit where asked for: row sums of others tell if they should be."""
    out = rows @ columns
    if limited:
        np.clip(out, -_LIMIT, _LIMIT, out=out)
    return np.exp(out, out=out)


class Block:
    """The model on a batch of blocks in a row; keeps what the gradients need."""

    def __init__(self, w: Weights, vocabulary: Vocabulary, x: np.ndarray, first: np.ndarray, lead: int = -1):
        """x: places of the inputs; first: which blocks don't continue the one before.  If the batch's first block
        isn't the first of its text, it serves as context alone (its targets are -1), and ``lead`` is the place of
        the input before it."""
        self.w, self.vocabulary, self.x = w, vocabulary, x
        n, x = len(x), x.ravel()
        self.blank = np.flatnonzero(first)
        raw = w["E"].take(x, 0)
        self.before = np.empty_like(raw)
        self.before[1:] = raw[:-1]
        self.before[0] = w["E"][lead] if lead >= 0 else 0
        self.before[self.blank * STRIDE] = 0
        whole = np.empty((len(raw) + STRIDE, WIDTH), raw.dtype)
        whole[:STRIDE] = 0
        e = _times(self.before, w["S"], whole[STRIDE:])
        e += raw
        q = _times(e, _paired(w))
        self.e, self.q = e, q.reshape(n, STRIDE, WIDTH)
        self.windows, self.across = _windows(whole, n), _across(whole, n)
        far, hidden = np.exp(w["R"])[np.maximum(_DISTANCE, 0)] * _CAUSAL, np.union1d(self.blank, 0)
        for limited in (False, True):
            with np.errstate(over="ignore", invalid="ignore"):
                a = _exps(self.q, self.across, limited)
                a *= far
            # What lies before a text, or before the batch, isn't seen.
            a[hidden, :, :STRIDE] = 0
            total = _total(a.reshape(-1, SPAN))
            if _ordinary(total):
                break
        # Not normalized here: sums divide what is seen, which is narrower.
        self.a, self.part = a, (1 / total)[:, None]
        # Embeddings are summed and the sums projected, which is the same as sums of values.
        self.seen = (a @ self.windows).reshape(-1, WIDTH)
        self.seen *= self.part
        self.u = _times(self.seen, w["V"])
        self.u += e
        self.z = _times(self.u, w["A"])
        self.z += w["a"]
        np.maximum(self.z, 0, out=self.z)
        self.h = _times(self.z, w["B"])
        self.h += self.u

    def logs(self, y: np.ndarray, gradient: bool = False):
        """Log chance of each target (0 where it is -1); with ``gradient``, also the gradients of minus their mean."""
        vocabulary = self.vocabulary
        y = y.reshape(-1)
        at = np.flatnonzero(y >= 0)
        rank = vocabulary.rank.take(y.take(at)).astype(np.uint16)
        # By rank, so that the targets of a class lie together.
        by = np.argsort(rank, kind="stable")
        at, rank = at.take(by), rank.take(by)
        h = self.h.take(at, 0)
        for limited in (False, True):
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                found, ordinary, dh, g = self._told(h, rank, gradient, limited)
            if ordinary:
                break
        out = np.zeros(len(y), np.float64)
        out[at] = found
        if not gradient:
            return out
        place = np.full(len(y), len(at))
        place[at] = np.arange(len(at))
        self._back(dh.take(place, 0), g)
        return out, g

    def _told(self, h: np.ndarray, rank: np.ndarray, gradient: bool, limited: bool):
        """Log chances of targets in order of rank, if no limit was passed, and the gradients of h (a row of zeros
        follows) and of the outputs.  Biases are factors of the weights, so that no pass over the logits adds them."""
        w, vocabulary, dh, g = self.w, self.vocabulary, None, {}
        scale = h.dtype.type(1 / max(1, len(h)))
        edge = np.searchsorted(rank, vocabulary.edge).tolist()
        kind = np.repeat(np.arange(len(vocabulary.sizes)), np.diff(edge))
        chances, factor = _exps(h, w["C"], limited), np.exp(w["c"])
        picked = np.arange(0, chances.size, chances.shape[1]) + kind
        own, total = chances.ravel().take(picked), chances @ factor
        found = np.log(np.maximum(own, 1 / _MOST)) - np.log(total) + w["c"].take(kind)
        # Of ids with output vectors; a class of one id has nothing to tell apart.
        inner_end = int(np.searchsorted(rank, vocabulary.narrow))
        place, within, sums = rank[:inner_end].astype(np.int64), np.ones(inner_end, h.dtype), np.ones(inner_end, h.dtype)
        columns, factors, bias = _turned(w["U"]), np.exp(w["u"]), w["u"].take(place)
        parts = []
        for c in vocabulary.shared_out().tolist():
            start, end = edge[c], edge[c + 1]
            if start < end:
                a, b = vocabulary.edge[c], vocabulary.edge[c + 1]
                p, mine = _exps(h[start:end], columns[:, a:b], limited), place[start:end]
                mine = mine + np.arange(-a, p.size - a, b - a)
                within[start:end], sums[start:end] = p.ravel().take(mine), p @ factors[a:b]
                parts.append((start, end, a, b, p, mine))
        for c in np.flatnonzero(vocabulary.sizes == 1):
            bias[edge[c] : edge[c + 1]] = 0
        found[:inner_end] += np.log(np.maximum(within, 1 / _MOST)) - np.log(sums) + bias
        found[inner_end:] += vocabulary.share[rank[inner_end:]]
        ordinary = _ordinary(total) and _ordinary(sums)
        if not gradient or not (ordinary or limited):
            return found, ordinary, dh, g
        chances *= (scale / total)[:, None]
        chances.ravel()[picked] -= scale / factor.take(kind)
        g["C"], g["c"] = _inner(h, chances) * factor, np.ones(len(h), h.dtype) @ chances * factor
        dh = np.zeros((len(h) + 1, WIDTH), h.dtype)
        _times(chances, _turned(w["C"] * factor), dh[:-1])
        g["U"], g["u"] = np.zeros_like(w["U"]), np.zeros_like(w["u"])
        # Chances stay times their sums; what they are multiplied with is divided instead, and so are the products.
        each = (scale / sums)[:, None]
        less, divided, more, vectors = sums / factors.take(place), h[:inner_end] * each, np.zeros((inner_end, WIDTH), h.dtype), w["U"] * factors[:, None]
        for start, end, a, b, p, mine in parts:
            p.ravel()[mine] -= less[start:end]
            np.matmul(p.T, divided[start:end], out=g["U"][a:b])
            np.matmul(each[start:end].T, p, out=g["u"][None, a:b])
            np.matmul(p, vectors[a:b], out=more[start:end])
        g["U"] *= factors[:, None]
        g["u"] *= factors
        more *= each
        dh[:inner_end] += more
        return found, ordinary, dh, g

    def _back(self, dh: np.ndarray, g: Weights) -> None:
        w, n, ones = self.w, len(self.x), np.ones(len(dh), dh.dtype)
        g["B"] = _inner(self.z, dh)
        dz = _times(dh, _turned(w["B"]))
        dz *= self.z > 0
        g["A"], g["a"] = _inner(self.u, dz), ones @ dz
        du = _times(dz, _turned(w["A"]))
        du += dh
        g["V"] = _inner(self.seen, du)
        mean = _times(du, _turned(w["V"]))
        mean *= self.part
        # Of the softmax: a * (da - sum(a * da)), where the sum is the mean's gradient times what was seen.
        less = _total(mean * self.seen)
        mean = mean.reshape(n, STRIDE, WIDTH)
        da = mean @ self.across
        da -= less.reshape(n, STRIDE, 1)
        da *= self.a
        g["R"] = np.bincount(np.maximum(_DISTANCE, 0).ravel(), weights=np.ones(n, da.dtype) @ da.reshape(n, -1), minlength=SPAN).astype(np.float32)
        back = self.a.transpose(0, 2, 1) @ mean
        back += da.transpose(0, 2, 1) @ self.q
        dq = (da @ self.windows).reshape(-1, WIDTH)
        paired = _inner(self.e, dq) * _SCALE
        g["Q"], g["K"] = paired @ w["K"], paired.T @ w["Q"]
        de = du
        de += _folded(back)
        de += _times(dq, _turned(_paired(w)))
        g["S"] = _inner(self.before, de)
        before = _times(de, _turned(w["S"]))
        before[self.blank * STRIDE] = 0
        de[:-1] += before[1:]
        x = self.x.ravel()
        order = np.argsort(x.astype(np.uint16), kind="stable")
        x = x.take(order)
        new = np.append(0, 1 + np.flatnonzero(x[1:] != x[:-1]))
        # In pairs, as complex numbers: half as many sums.
        pairs = de.take(order, 0).view(np.result_type(de.dtype, np.complex64))
        g["rows"], g["E"] = x[new], np.add.reduceat(pairs, new, axis=0).view(de.dtype)


class Stream:
    """Deals the blocks of texts, in a row, to batches of ``size`` blocks; a text that a batch cuts goes on in the
    next one, after its last block as context."""

    def __init__(self, size: int):
        self.size, self.held, self.count, self.lead = size, [], 0, -1

    def add(self, owner: int, x: np.ndarray, y: np.ndarray, first: np.ndarray):
        """Full batches, as (owners, inputs, targets, firsts, lead)."""
        self.held.append((np.full(len(x), owner), x, y, first))
        self.count += len(x)
        if self.count > self.size:
            yield from self._full()

    def _full(self):
        owner, x, y, first = (np.concatenate(c) for c in zip(*self.held))
        at, context = 0, 0
        while len(x) - at > self.size:
            end = at + self.size
            yield owner[at - context : end], x[at - context : end], self._hidden(y[at - context : end], context), first[at - context : end], self.lead
            at, context = end, int(not first[end])
            start = at - context
            # The held blocks begin where a text does, or with a context block whose lead is known.
            self.lead = int(x[start - 1, -1]) if context and not first[start] else -1
        rest = slice(at - context, None)
        self.held, self.count = [(owner[rest], x[rest], self._hidden(y[rest], context), first[rest])], len(x) - at + context

    @staticmethod
    def _hidden(y: np.ndarray, context: int) -> np.ndarray:
        if context:
            y = y.copy()
            y[0] = -1
        return y

    def rest(self):
        if self.count:
            yield (*(np.concatenate(c) for c in zip(*self.held)), self.lead)
        self.held, self.count, self.lead = [], 0, -1


class Adam:
    """Steps of Adam; of the embeddings, only the rows of a batch are moved."""

    def __init__(self, w: Weights, rate: float, smooth: tuple[float, float] = (0.9, 0.98)):
        self.w, self.rate, self.smooth, self.steps = w, rate, smooth, 0
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.s = {k: np.zeros_like(v) for k, v in w.items()}

    def step(self, g: Weights) -> None:
        self.steps += 1
        one, two = self.smooth
        rate = float(self.rate * (1 - two**self.steps) ** 0.5 / (1 - one**self.steps))
        for k, w in self.w.items():
            m, s, own = self.m[k], self.s[k], g[k]
            if k != "E":
                self._move(w, m, s, own, rate)
                continue
            rows = g["rows"]
            parts = [t.take(rows, 0) for t in (w, m, s)]
            self._move(*parts, own, rate)
            for t, part in zip((w, m, s), parts):
                t[rows] = part

    def _move(self, w: np.ndarray, m: np.ndarray, s: np.ndarray, g: np.ndarray, rate: float) -> None:
        one, two = self.smooth
        m *= one
        m += (1 - one) * g
        s *= two
        g = g * g
        g *= 1 - two
        s += g
        size = np.sqrt(s)
        size += 1e-8
        np.divide(m, size, out=size)
        size *= rate
        w -= size
