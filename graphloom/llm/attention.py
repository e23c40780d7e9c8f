"""A causal self-attention model over subword ids, in numpy.

Ids are the ``VOCAB`` commonest subwords, in classes of ``CLASS`` that behave alike; id 0 stands for all other subwords and id 1 for the
end of a text, which is also what a text begins after. A position attends to the ``STEP`` positions before its block of ``STEP``
and to those of its block up to itself; the blocks are the overlapping windows, of which each scores its second half. The
next subword is predicted in two steps, class and member: each is a softmax of the hidden state plus the logarithm of
the corpus-wide probability given the subword before, so an untrained network is the smoothed bigram model of the whole corpus
and training adds what the context says beyond that. The subword two back has a table of its own beside the attention.
"""

from __future__ import annotations

import numpy as np

CLASS = 32
VOCAB = CLASS * CLASS
OTHER, END = 0, 1
DIM, HIDDEN, STEP = 16, 32, 16
#: Weight of the unigram probabilities in the bigram table, in tokens.
PRIOR = 4.0
#: Smallest weight of a subword that was not seen.
LEAST = 0.5


def classes(bigrams: np.ndarray) -> np.ndarray:
    """The class of each id: eight strips along the first singular direction of the scaled table, each cut in four along the second."""
    scaled = np.sqrt(bigrams / bigrams.sum(1, keepdims=True))
    _, _, right = np.linalg.svd(scaled - scaled.mean(0), full_matrices=False)
    out, strip = np.empty(VOCAB, np.int64), VOCAB // 8
    first = np.argsort(right[0], kind="stable")
    for i in range(8):
        own = first[i * strip : (i + 1) * strip]
        own = own[np.argsort(right[1][own], kind="stable")]
        for j in range(strip // CLASS):
            out[own[j * CLASS : (j + 1) * CLASS]] = i * (strip // CLASS) + j
    return out


class Tables:
    """What the counts of the whole corpus say: the number of each id within the classes, and the logarithms of the class given the
    id before, and of the member given that and the class. Rows and columns go by (class, member) numbers."""

    def __init__(self, within: np.ndarray, first: np.ndarray, last: np.ndarray):
        """``within[a, b]``: b follows a inside a word; ``first`` and ``last``: how often an id begins and ends a word (``first[END]``: texts)."""
        start = (first + LEAST / VOCAB) / (first.sum() + LEAST)
        unigram = within.sum(0) + first + LEAST
        unigram = unigram / unigram.sum()
        seen = within + last[:, None] * start[None, :]
        seen[END] = (first.sum() + 1) * start
        table = (seen + PRIOR * unigram) / (seen.sum(1, keepdims=True) + PRIOR)
        cls = classes(table)
        order = np.argsort(cls, kind="stable")
        #: The number (class * CLASS + member) of each id.
        self.number = np.empty(VOCAB, np.int32)
        self.number[order] = np.arange(VOCAB)
        table = table[np.ix_(order, order)].reshape(VOCAB, CLASS, CLASS)
        mass = table.sum(2)
        self.of_class = np.log(mass).astype(np.float32)
        self.of_member = np.log(table / mass[:, :, None]).astype(np.float32).reshape(VOCAB * CLASS, CLASS)


def start(seed: int = 0) -> dict[str, np.ndarray]:
    """Weights before training. The output weights are zero."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    return {"e": draw(VOCAB, DIM), "p": zero(VOCAB, DIM), "q": draw(DIM, DIM), "k": draw(DIM, DIM), "v": draw(DIM, DIM), "near": zero(2 * STEP), "w1": draw(DIM, HIDDEN), "b1": zero(HIDDEN), "w2": draw(HIDDEN, DIM), "u1": zero(DIM, CLASS), "u2": zero(CLASS, DIM, CLASS)}


def flat(weights: dict) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def shaped(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    like = start()
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


_BACK = np.clip(np.arange(STEP)[:, None] + STEP - np.arange(2 * STEP)[None, :], 0, None)
_AHEAD = np.arange(2 * STEP)[None, :] > np.arange(STEP)[:, None] + STEP


def _blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of sequences of so many inputs: (place of each input among the slots, the block before each scored block, blocks)."""
    n = -(-sizes // STEP)
    first = np.cumsum(n) - n
    begin = np.cumsum(sizes) - sizes
    place = np.repeat(first * STEP - begin, sizes) + np.arange(sizes.sum())
    before = np.arange(n.sum()) - 1
    before[first[n > 0]] = -1
    return place, before, n


def windows(inputs: np.ndarray, targets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of inputs (n, 2 STEP), of targets (n, STEP), context block or not) of sequences; empty slots are -1."""
    place, before, n = _blocks(sizes)
    x, y = np.full(n.sum() * STEP, -1, np.int32), np.full(n.sum() * STEP, -1, np.int32)
    x[place], y[place] = inputs, targets
    x, y = x.reshape(-1, STEP), y.reshape(-1, STEP)
    ahead = np.where((before >= 0)[:, None], x[before], -1)
    return np.concatenate([ahead, x], axis=1), y, before


_ONES = np.ones(2 * STEP, np.float32)


def _add_rows(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows summed by number (size, columns)."""
    wide = rows.shape[1]
    place = (at[:, None] * wide + np.arange(wide)).ravel()
    return np.bincount(place, rows.ravel(), size * wide).astype(np.float32).reshape(size, wide)


def _softmax(s: np.ndarray) -> np.ndarray:
    """Of rows of 2 STEP values. The largest value of a row is taken off only if some row needs it."""
    if s.max(initial=0) < 60:
        out = np.exp(s)
        sums = out.reshape(-1, 2 * STEP) @ _ONES
        if sums.min(initial=1) > 1e-25:
            out /= sums.reshape(*s.shape[:-1], 1)
            return out
    s -= s.max(-1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(-1, keepdims=True)
    return s


def gradients(w: dict, t: Tables, x: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
    """Gradients and sum of the loss (negative logarithms) of windows; the gradients are of the mean."""
    n = len(x)
    have = y >= 0
    xi, yi = np.maximum(x, 0), np.maximum(y, 0)
    # products of all windows are made in one, as far as they share a matrix
    ex = w["e"][xi]
    both, own = ex.reshape(-1, DIM), ex[:, STEP:].reshape(-1, DIM)
    key_value = np.concatenate([w["k"], w["v"]], axis=1)
    kv = (both @ key_value).reshape(n, -1, 2 * DIM)
    k, v = kv[:, :, :DIM], kv[:, :, DIM:]
    q = (own @ w["q"]).reshape(n, STEP, DIM)
    scale = np.float32(DIM**-0.5)
    s = q @ k.transpose(0, 2, 1)
    s *= scale
    s += np.where(_AHEAD, np.float32(-1e9), w["near"][_BACK])
    gone = x < 0
    rows = np.flatnonzero(gone.any(1))
    if len(rows):
        s[rows] = np.where(gone[rows][:, None, :], np.float32(-1e9), s[rows])
    a = _softmax(s)
    ahead = x[:, STEP - 1 : -1].ravel()
    prior = w["p"][np.maximum(ahead, 0)]
    prior[ahead < 0] = 0
    h = (a @ v).reshape(-1, DIM)
    h += own
    h += prior
    r = h @ w["w1"]
    r += w["b1"]
    np.maximum(r, 0, out=r)
    g = h + r @ w["w2"]
    # positions in the order of their target's class: the members of a class share a matrix
    by = np.argsort((yi.ravel() // CLASS).astype(np.int16), kind="stable")
    g, before, yf, live = g[by], xi[:, STEP:].ravel()[by], yi.ravel()[by], have.ravel()[by]
    cls, member, row = yf // CLASS, yf % CLASS, np.arange(len(yf))
    ends = np.searchsorted(cls, np.arange(CLASS + 1)).tolist()
    groups = [(c, slice(ends[c], ends[c + 1])) for c in range(CLASS) if ends[c] < ends[c + 1]]
    p1 = g @ w["u1"]
    p1 += t.of_class[before]
    p1 = _softmax(p1)
    p2 = t.of_member[before * CLASS + cls].astype(g.dtype, copy=False)
    more = np.empty_like(p2)
    for c, at in groups:
        np.matmul(g[at], w["u2"][c], out=more[at])
    p2 += more
    p2 = _softmax(p2)
    loss = -float((np.log(np.maximum(p1[row, cls], 1e-30)) + np.log(np.maximum(p2[row, member], 1e-30)))[live].sum())
    share = (live / max(1, live.sum())).astype(np.float32)[:, None]
    p1[row, cls] -= 1
    p2[row, member] -= 1
    p1 *= share
    p2 *= share
    d = {"u1": g.T @ p1, "u2": np.zeros_like(w["u2"])}
    dg = p1 @ w["u1"].T
    back = np.empty_like(dg)
    for c, at in groups:
        one = p2[at]
        np.matmul(g[at].T, one, out=d["u2"][c])
        np.matmul(one, w["u2"][c].T, out=back[at])
    dg += back
    back[by] = dg
    dg = back
    d["w2"] = r.T @ dg
    dr = dg @ w["w2"].T
    dr *= r > 0
    d["w1"], d["b1"] = h.T @ dr, dr.sum(0)
    dh = dg + dr @ w["w1"].T
    by_window = dh.reshape(n, STEP, DIM)
    ds = by_window @ v.transpose(0, 2, 1)
    dkv = np.empty_like(kv)
    np.matmul(a.transpose(0, 2, 1), by_window, out=dkv[:, :, DIM:])
    ds *= a
    ds -= a * (ds.reshape(-1, 2 * STEP) @ _ONES).reshape(n, STEP, 1)
    d["near"] = np.bincount(_BACK.ravel(), ds.sum(0).ravel(), minlength=2 * STEP).astype(np.float32)
    ds *= scale
    dq = (ds @ k).reshape(-1, DIM)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :DIM])
    dkv = dkv.reshape(-1, 2 * DIM)
    d["q"] = own.T @ dq
    of_both = both.T @ dkv
    d["k"], d["v"] = of_both[:, :DIM], of_both[:, DIM:]
    dx = dkv @ key_value.T
    dx.reshape(n, 2 * STEP, DIM)[:, STEP:] += (dh + dq @ w["q"].T).reshape(n, STEP, DIM)
    d["e"] = _add_rows(np.where(x >= 0, x, VOCAB).ravel(), dx, VOCAB + 1)[:VOCAB]
    d["p"] = _add_rows(np.where(ahead >= 0, ahead, VOCAB), dh, VOCAB + 1)[:VOCAB]
    return d, loss


def train(w: dict, t: Tables, x: np.ndarray, y: np.ndarray, rate: float, batch: int = 64, seed: int = 0) -> tuple[dict, float, int]:
    """One pass of Adam over windows in a seeded order: (weights, sum of losses, scored tokens)."""
    # the weights are parts of one row of numbers, which a step changes at once
    row, names, w, at = flat(w), sorted(w), dict(w), 0
    for k in names:
        w[k] = row[at : at + w[k].size].reshape(w[k].shape)
        at += w[k].size
    m, s, grad, step = (np.zeros_like(row) for _ in range(4))
    order, loss = np.random.default_rng(seed).permutation(len(x)), 0.0
    for i, lo in enumerate(range(0, len(x), batch)):
        at = order[lo : lo + batch]
        d, one = gradients(w, t, x[at], y[at])
        loss += one
        np.concatenate([d[k].ravel() for k in names], out=grad)
        # m += 0.1 (grad - m), s += 0.01 (grad^2 - s), in place
        m *= np.float32(0.9)
        np.multiply(grad, np.float32(0.1), out=step)
        m += step
        s *= np.float32(0.99)
        grad *= step
        grad *= np.float32(0.1)
        s += grad
        np.sqrt(s, out=step)
        step *= np.float32((1 - 0.99 ** (i + 1)) ** -0.5)
        step += np.float32(1e-6)
        np.divide(m, step, out=step)
        step *= np.float32(rate / (1 - 0.9 ** (i + 1)))
        row -= step
    return w, loss, int((y >= 0).sum())


def _log_sums(z: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exponentials by row. The largest value of a row is taken off only if some row needs it."""
    if z.max(initial=0) < 60:
        sums = np.exp(z) @ _ONES
        if sums.min(initial=1) > 1e-30:
            return np.log(sums)
    top = z.max(1)
    return np.log(np.exp(z - top[:, None]) @ _ONES) + top


class Scorer:
    """Scores sequences with fixed weights: queries, keys and values of one layer depend on the id alone, so they are looked up."""

    def __init__(self, w: dict, t: Tables):
        self.t, self.w = t, w
        pad = lambda a: np.concatenate([a, np.zeros((1, a.shape[1]), np.float32)])
        e, q, k = w["e"], (w["e"] @ w["q"]) * np.float32(DIM**-0.5), w["e"] @ w["k"]
        self.own, self.before, self.key, self.value = pad(np.concatenate([q, e], axis=1)), pad(w["p"]), pad(k), pad(e @ w["v"])
        self.bias = np.where(_AHEAD, np.float32(-1e9), w["near"][_BACK]).astype(np.float32)

    def score(self, inputs: np.ndarray, targets: np.ndarray, sizes: np.ndarray, windows_at_once: int = 256) -> np.ndarray:
        """Natural logarithm of the probability of every target, in order."""
        x, y, before = windows(inputs, targets, sizes)
        out = np.empty(y.shape, np.float64)
        for lo in range(0, len(x), windows_at_once):
            out[lo : lo + windows_at_once] = self._part(x[lo : lo + windows_at_once], y[lo : lo + windows_at_once])
        return out[y >= 0]

    def _part(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        t, w, n = self.t, self.w, len(x)
        own = self.own[x[:, STEP:]]
        s = own[:, :, :DIM] @ self.key[x].transpose(0, 2, 1)
        s += self.bias
        gone = x < 0
        if gone.any():
            rows = np.flatnonzero(gone.any(1))
            s[rows] = np.where(gone[rows][:, None, :], np.float32(-1e9), s[rows])
        if s.max(initial=0) > 60:
            s -= s.max(-1, keepdims=True)
        a = np.exp(s)
        sums = a.reshape(-1, 2 * STEP) @ _ONES
        if (sums[y.ravel() >= 0] < 1e-25).any():  # a row of very low values: its largest is taken off first
            a = np.exp(s - s.max(-1, keepdims=True))
            sums = a.reshape(-1, 2 * STEP) @ _ONES
        h = (a @ self.value[x]).reshape(-1, DIM)
        h /= (sums + np.float32(1e-30))[:, None]
        h += own[:, :, DIM:].reshape(-1, DIM)
        h += self.before[x[:, STEP - 1 : -1].reshape(-1)]
        r = h @ w["w1"]
        r += w["b1"]
        np.maximum(r, 0, out=r)
        h += r @ w["w2"]
        # members of one class are scored together
        yf, before = np.maximum(y, 0).ravel(), np.maximum(x[:, STEP:], 0).ravel()
        order = np.argsort((yf >> 5).astype(np.int16), kind="stable")
        h, before, yf = h[order], before[order], yf[order]
        cls, row = yf >> 5, np.arange(len(order))
        one = h @ w["u1"]
        one += t.of_class[before]
        total = one[row, cls] - _log_sums(one)
        two = t.of_member[before * CLASS + cls]
        ends = np.searchsorted(cls, np.arange(CLASS + 1)).tolist()
        for c in range(CLASS):
            if ends[c] < ends[c + 1]:
                two[ends[c] : ends[c + 1]] += h[ends[c] : ends[c + 1]] @ w["u2"][c]
        total += two[row, yf & 31]
        total -= _log_sums(two)
        out = np.empty(len(order), np.float32)
        out[order] = total
        return out.reshape(n, STEP)
