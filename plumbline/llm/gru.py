"""A gated recurrent language model in numpy: trained by truncated backpropagation, with a class-factored softmax.

Symbols are numbered by frequency and cut into classes of equal size, so that a symbol's probability is that of its
class times its own within the class, each a softmax over a few dozen entries. Many documents run side by side in
lanes; the hidden state is carried from window to window, so that a document of any length is scored as a whole, and is
cleared where a document starts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

HIDDEN = 16
CLASS_SIZE = 64
WINDOW = 16
#: Lanes in training, where each window is a step of the parameters, and in scoring.
LANES, SCORE_LANES = 256, 512
RATE = 0.15
START = -1  # the symbol before the first; row -1 of the input table

Params = list[np.ndarray]


def fresh(symbols: int, seed: int = 0) -> Params:
    """[input table (symbols + 1, 3H), recurrent (H, 3H), class weights, class biases, word weights, word biases]."""
    rng, h, classes = np.random.default_rng(seed), HIDDEN, -(-symbols // CLASS_SIZE)
    sizes = [(symbols + 1, 3 * h), (h, 3 * h), (h, classes), (classes,), (classes, h, CLASS_SIZE), (classes, CLASS_SIZE)]
    return [(rng.normal(size=s) * (0.1 if len(s) > 1 else 0)).astype(np.float32) for s in sizes]


def set_biases(p: Params, counts: np.ndarray) -> None:
    """Starts the output at the symbols' frequencies; slots past the last symbol are closed."""
    classes = p[5].shape[0]
    c = np.zeros(classes * CLASS_SIZE)
    c[: len(counts)] = np.asarray(counts, float) + 1
    c = c.reshape(classes, CLASS_SIZE)
    p[3][:] = np.log(c.sum(1))
    p[5][:] = np.log(np.maximum(c, 1e-30))
    p[3] -= p[3].mean()
    p[5] -= p[5].max(1, keepdims=True)


class Lanes:
    """Documents laid end to end in lanes of like length, longest lane first; ``windows`` cuts them.

    Where a long document leaves few lanes running, windows grow longer, so that each has about as many tokens as the
    first: what a window costs beside its tokens is paid for tokens, not for the length of the longest document.
    """

    def __init__(self, docs: list[np.ndarray], most: int) -> None:
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        load = [(0, k) for k in range(min(most, len(docs)))]
        lanes: list[list[int]] = [[] for _ in load]
        for i in order:
            n, k = load[0]
            lanes[k].append(i)
            heapq.heapreplace(load, (n + len(docs[i]), k))
        lanes.sort(key=lambda x: -sum(len(docs[i]) for i in x))
        laid = [i for lane in lanes for i in lane]
        self.lengths = np.array([sum(len(docs[i]) for i in lane) for lane in lanes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.targets = np.concatenate([docs[i] for i in laid]) if laid else np.zeros(0, np.int64)
        self.owners = np.repeat(laid, [len(docs[i]) for i in laid]) if laid else np.zeros(0, np.int64)
        self.inputs = np.concatenate(([START], self.targets[:-1])) if laid else self.targets
        self.inputs[1:][self.owners[1:] != self.owners[:-1]] = START

    def windows(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(inputs, targets, owners, real) of shape (window, lanes still running); an input of START clears the state."""
        at, end = 0, int(self.lengths.max(initial=0))
        while at < end:
            n = int((self.lengths > at).sum())
            steps = np.arange(at, min(at + WINDOW * (len(self.lengths) // n), max(end, at + WINDOW)))[:, None]
            at += len(steps)
            real = steps < self.lengths[:n]
            index = np.where(real, self.starts[:n] + steps, 0)
            yield self.inputs[index], self.targets[index], self.owners[index], real


def _recur(p: Params, x: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(states (window, H + 1, lanes) with a row of ones, what backpropagation needs of each step).

    A state is a column, so that every operation runs along all lanes. Without ``keep`` all steps share one place.
    """
    n2, (steps, lanes), dtype = 2 * HIDDEN, x.shape, np.result_type(p[0], h)
    gathered, ut = np.ascontiguousarray(p[0][x].transpose(0, 2, 1)), np.ascontiguousarray(p[1].T)
    going, cleared = (x != START).astype(dtype), (x == START).any(axis=1).tolist()
    before, gates, fresh_part, hu = (np.empty((steps if keep else 1, k, lanes), dtype) for k in (HIDDEN, n2, HIDDEN, 3 * HIDDEN))
    out = np.empty((steps, HIDDEN + 1, lanes), dtype)
    out[:, HIDDEN] = 1
    for t in range(steps):
        k, g = t if keep else 0, gathered[t]
        if cleared[t]:
            h = np.multiply(h, going[t], out=before[k])
        elif keep:
            before[k] = h
        np.matmul(ut, h, out=hu[k])
        zr, c, new = gates[k], fresh_part[k], out[t, :HIDDEN]
        np.add(g[:n2], hu[k, :n2], out=zr)
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(zr[HIDDEN:], hu[k, n2:], out=c)
        c += g[n2:]
        np.tanh(c, out=c)
        np.subtract(h, c, out=new)
        new *= zr[:HIDDEN]
        new += c
        h = new
    return out, (before, gates, fresh_part, hu[:, n2:], going)


def _with_biases(p: Params) -> tuple[np.ndarray, np.ndarray, bool]:
    """(class weights, word weights, whether exp needs a shift), biases as a last row that meets a state of one.

    States lie within (-1, 1), so an entry is bounded by the weights; the usual shift by a row's largest entry is
    needed only where that bound is near what float32 holds.
    """
    top, own = np.concatenate((p[2], p[3][None])), np.concatenate((p[4], p[5][:, None]), axis=1)
    most = max(np.abs(p[2]).sum(axis=0).max() + np.abs(p[3].max()), (np.abs(p[4]).sum(axis=1).max(axis=1) + np.abs(p[5].max(axis=1))).max())
    return top, own, bool(most > 60)


def _softmax(x: np.ndarray, marks: np.ndarray, shift: bool, marked: bool) -> tuple[np.ndarray, np.ndarray]:
    """(the share of each row's mark, a place in flat x, in its row's exp; one over the row's sum); x becomes exp(x).

    With t the sum of a row's entries e and a mark m at its target, the gradient e / t - m is (e - t m) / t: ``marked``
    leaves e - t m in x, and what is divided are the few columns of the states and of the result, not the entries.
    """
    if shift:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    flat, total = x.reshape(-1), x @ np.ones(x.shape[1], x.dtype)
    hit = flat.take(marks)
    if marked:
        flat[marks] = hit - total
    return hit.astype(float) / total, 1 / total


def _output(p: Params, states: np.ndarray, y: np.ndarray, real: np.ndarray, grads: Params | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(places of the real tokens by class, natural log probability of their targets, the loss's gradient by state).

    Tokens are rows here, those of a class together: each class meets its run of them in one product, and all
    entries then go through exp at once.
    """
    at = np.flatnonzero(real)
    y = y.ravel()[at]
    order = np.argsort((y // CLASS_SIZE).astype(np.int16), kind="stable")
    at, y = at[order], y[order]
    kind, own, row = y // CLASS_SIZE, y % CLASS_SIZE, np.arange(len(y))
    held = np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, HIDDEN + 1).take(at, axis=0)
    top, inner, shift = _with_biases(p)
    runs, marked = list(zip(*_runs(kind), strict=True)), grads is not None
    outer, words = held @ top, np.empty((len(y), CLASS_SIZE), held.dtype)
    for k, a, b in runs:
        np.matmul(held[a:b], inner[k], out=words[a:b])
    odds, outer_part = _softmax(outer, row * outer.shape[1] + kind, shift, marked)
    more, words_part = _softmax(words, row * CLASS_SIZE + own, shift, marked)
    odds *= more  # the product of two may be less than float32 holds
    ds = None
    if grads is not None:
        both = (held * outer_part[:, None]).T @ outer
        grads[2] += both[:HIDDEN]
        grads[3] += both[HIDDEN]
        ds, back, held = outer @ p[2].T, np.empty((len(y), HIDDEN), held.dtype), held * words_part[:, None]
        ds *= outer_part[:, None]
        for k, a, b in runs:
            both = held[a:b].T @ words[a:b]
            grads[4][k] += both[:HIDDEN]
            grads[5][k] += both[HIDDEN]
            np.matmul(words[a:b], p[4][k].T, out=back[a:b])
        back *= words_part[:, None]
        ds += back
    return at, np.log(np.maximum(odds, 1e-300)), ds


def _runs(kind: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)] if len(kind) else [0]
    return kind[cuts[:-1]].tolist(), cuts[:-1], cuts[1:]


def score(p: Params, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document (an array of symbols), state carried through all of it."""
    total, lanes = np.zeros(len(docs)), Lanes(docs, SCORE_LANES)
    h = np.zeros((HIDDEN, len(lanes.lengths)), np.float32)
    for x, y, o, real in lanes.windows():
        states, _ = _recur(p, x, h[:, : x.shape[1]], False)
        h = states[-1, :HIDDEN]
        at, found, _ = _output(p, states, y, real, None)
        total += np.bincount(o.ravel()[at], found, len(docs))
    return total


def gradients(p: Params, x: np.ndarray, y: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[Params, np.ndarray, np.ndarray, float]:
    """(gradients of the window's loss, rows of the input table that have one, last state, loss).

    The table's gradient has only those rows. Truncation: none flows into the state that the window starts from.
    """
    states, (before, gates, c, hc, going) = _recur(p, x, h, True)
    grads = [np.zeros((0, 0), np.float32), *(np.zeros_like(a) for a in p[1:])]
    at, found, ds = _output(p, states, y, real, grads)
    d_states = np.zeros((x.size, HIDDEN), ds.dtype)
    d_states[at] = ds
    d_states = np.ascontiguousarray(d_states.reshape(*x.shape, HIDDEN).transpose(0, 2, 1))
    n2, u, last = 2 * HIDDEN, p[1], states[-1, :HIDDEN]
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    # what does not depend on the steps behind: dc = dh by_c, dz = dh by_z, dr = dc by_r
    rest = 1 - z
    by_c, by_z, by_r = rest * (1 - c * c), (before - c) * z * rest, hc * r * (1 - r)
    d, inside = (np.empty((len(x), 3 * HIDDEN, x.shape[1]), last.dtype) for _ in range(2))
    dh = np.zeros_like(last)
    for t in range(len(x) - 1, -1, -1):
        dh += d_states[t]
        dt, dc = d[t], d[t, n2:]
        np.multiply(dh, by_c[t], out=dc)
        np.multiply(dh, by_z[t], out=dt[:HIDDEN])
        np.multiply(dc, by_r[t], out=dt[HIDDEN:n2])
        inside[t, :n2] = dt[:n2]
        np.multiply(dc, r[t], out=inside[t, n2:])
        dh *= z[t]
        dh += u @ inside[t]
        dh *= going[t]
    grads[1] += np.matmul(before, inside.transpose(0, 2, 1)).sum(axis=0)
    at = np.flatnonzero(real)
    flat = x.ravel()[at]
    flat = np.where(flat == START, len(p[0]) - 1, flat)
    order = np.argsort(flat.astype(np.int16 if len(p[0]) < 1 << 15 else np.int64), kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else flat
    by_token = np.ascontiguousarray(d.transpose(0, 2, 1)).reshape(-1, 3 * HIDDEN).take(at[order], axis=0)
    grads[0] = np.add.reduceat(by_token, first, axis=0) if len(order) else np.zeros((0, 3 * HIDDEN), np.float32)
    return grads, flat[first], last, -float(found.sum())


def train(p: Params, seen: Params, docs: list[np.ndarray], rate: float = RATE) -> None:
    """One pass over the documents in place: Adagrad, a step a window. ``seen`` holds the sums of squares."""
    lanes = Lanes(docs, LANES)
    h = np.zeros((HIDDEN, len(lanes.lengths)), np.float32)
    for x, y, _, real in lanes.windows():
        grads, rows, h, _ = gradients(p, x, y, real, h[:, : x.shape[1]])
        scale = np.float32(1 / max(int(real.sum()), 1))
        for k, g in enumerate(grads):
            g = g * scale
            at = rows if k == 0 else slice(None)
            seen[k][at] += g * g
            p[k][at] -= rate * g / np.sqrt(seen[k][at] + 1e-10)


def packed(arrays: Params) -> bytes:
    return b"".join(a.astype("<f4").tobytes() for a in arrays)


def unpacked(data: bytes | np.ndarray, like: Params) -> Params:
    flat = np.frombuffer(data, "<f4") if isinstance(data, bytes) else data
    out, at = [], 0
    for a in like:
        out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
        at += a.size
    return out
