"""Character-level bidirectional LSTM with CRF transitions, in numpy.

The gates are piecewise linear (clipped to 0..1, the candidate to -1..1), so
that a step is a few table lookups, one small product and clips over a whole
batch of windows. Training is maximum likelihood of the label paths: the CRF's
forward-backward recursion gives the gradient of the emissions, which runs
back through time in both directions.

Label 0 is "outside"; label k > 0 is the k-th kind. A path may not step from
one kind straight to another.

Texts are scored in overlapping windows. The windows' scores are reconciled
globally: each position takes its scores from the window in which it lies
deepest, and the labels are the best path over the whole document's scores, not
over each window's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN = 8
SLACK = 0.05  # beyond its range, a gate still learns
FLOOR = np.float32(1e-3)  # of the gates; keeps the cells out of denormal numbers, which are slow
BARRED = np.float32(-1e4)
# The characters the tagger tells apart; all others share classes by kind.
ALPHABET = "0123456789@._%+-()[]{}<>=:;,/\\'\"#*&|$!?~^ \n\t"
SPAN_TABLE = 0x2000


def _class_table() -> tuple[np.ndarray, int]:
    """Class of each code point below SPAN_TABLE (those above share the last class)."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    table = np.zeros(SPAN_TABLE + 1, dtype=np.uint8)
    upper = len(ALPHABET) + len(letters)
    for cp in range(SPAN_TABLE):
        ch = chr(cp)
        if ch in ALPHABET:
            table[cp] = ALPHABET.index(ch)
        elif ch in letters:
            table[cp] = len(ALPHABET) + letters.index(ch)
        elif ch.isupper():
            table[cp] = upper
        elif ch.isalpha():
            table[cp] = upper + 1
        else:
            table[cp] = upper + 2
    table[SPAN_TABLE] = upper + 1
    return table, upper + 4  # the last class pads


CLASS_OF, CLASSES = _class_table()
PAD = CLASSES - 1


def classes(text: str) -> np.ndarray:
    """Class of each code point of ``text``."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return CLASS_OF[np.minimum(cps, SPAN_TABLE)]


@dataclass
class Model:
    """Weights. table: (2, 4, CLASSES, H) input lookups with bias; rec: (2, 4, H, H);
    out: (2, K-1, H) and bias: (K-1,) score the kinds against "outside", whose score is
    zero; trans: (K, K) from, to. Gates: in, forget, out, candidate."""

    table: np.ndarray
    rec: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.table, self.rec, self.out, self.bias, self.trans]


def initial(labels: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    f4 = np.float32
    table = (rng.standard_normal((2, 4, CLASSES, HIDDEN)) * 0.3 + 0.5).astype(f4)
    table[:, 1] += 0.3
    return Model(
        table,
        (rng.standard_normal((2, 4, HIDDEN, HIDDEN)) * 0.15).astype(f4),
        (rng.standard_normal((2, labels - 1, HIDDEN)) * 0.3).astype(f4),
        np.full(labels - 1, -1.0, f4),
        np.zeros((labels, labels), f4),
    )


def _legal(trans: np.ndarray) -> np.ndarray:
    k = len(trans)
    bar = np.ones((k, k), bool)
    bar[0, :] = bar[:, 0] = False
    np.fill_diagonal(bar, False)
    return np.where(bar, BARRED, trans).astype(np.float32)


def emissions(model: Model, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Scores of the kinds (T, K-1, B) of windows x (T, B) of classes; keep gathers each step's state."""
    steps, batch = x.shape
    scores = np.empty((steps, len(model.bias), batch), np.float32)
    scores[:] = model.bias[:, None]
    for d in (0, 1):
        h = np.zeros((batch, HIDDEN), np.float32)
        c = np.zeros_like(h)
        gates = np.empty((4, batch, HIDDEN), np.float32)
        drive = np.empty_like(gates)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            np.take(model.table[d], x[t], axis=1, out=gates, mode="clip")
            np.matmul(h, model.rec[d], out=drive)
            gates += drive
            raw = gates.copy() if keep is not None else None
            np.clip(gates, FLOOR, 1, out=gates)
            i, f, o, g = gates
            before = (h.copy(), c.copy()) if keep is not None else None
            g *= 2
            g -= 1
            c *= f
            c += i * g
            np.clip(c, -1, 1, out=h)
            h *= o
            if keep is not None:
                keep.append((d, t, raw, gates.copy(), before, c.copy(), h.copy()))
            scores[t] += model.out[d] @ h.T
    return scores


def decode(model: Model, scores: np.ndarray) -> np.ndarray:
    """Viterbi labels (T, B) of the scores (T, K-1, B)."""
    trans = _legal(model.trans)
    steps, kinds, batch = scores.shape
    k = kinds + 1
    s = np.zeros((steps, k, batch), np.float32)
    s[:, 1:] = scores
    labels = np.zeros((steps, batch), np.uint8)
    best = s[0].copy()
    back_out = np.zeros((steps, batch), np.uint8)
    stays = np.zeros((steps, k - 1, batch), bool)
    for t in range(1, steps):
        to_out = best + trans[:, 0][:, None]
        back_out[t] = to_out.argmax(0)
        enter = best[0] + trans[0, 1:][:, None]
        stay = best[1:] + np.diag(trans)[1:][:, None]
        stays[t] = stay >= enter
        best = np.concatenate([to_out.max(0)[None], np.maximum(stay, enter)]) + s[t]
    at = best.argmax(0)
    col = np.arange(batch)
    for t in range(steps - 1, -1, -1):
        labels[t] = at
        if t:
            at = np.where(at == 0, back_out[t], np.where(stays[t, np.maximum(at, 1) - 1, col], at, 0))
    return labels


def _crf_gradient(model: Model, s: np.ndarray, y: np.ndarray):
    """Negative log likelihood with its gradient by emissions and transitions."""
    trans = _legal(model.trans)
    steps, batch, k = s.shape

    def lse(a, axis):
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    alpha = np.empty_like(s)
    beta = np.zeros_like(s)
    alpha[0] = s[0]
    for t in range(1, steps):
        alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + s[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = lse(trans + (s[t + 1] + beta[t + 1])[:, None, :], 2)
    z = lse(alpha[-1], 1)
    row = np.arange(batch)
    marginal = np.exp(alpha + beta - z[None, :, None])
    path = np.zeros(batch, np.float32)
    grad_t = np.zeros_like(trans)
    for t in range(steps):
        path += s[t, row, y[t]]
        marginal[t, row, y[t]] -= 1
        if t:
            pair = np.exp(alpha[t - 1][:, :, None] + trans + (s[t] + beta[t])[:, None, :] - z[:, None, None])
            grad_t += pair.sum(0)
            np.subtract.at(grad_t, (y[t - 1], y[t]), 1)
            path += trans[y[t - 1], y[t]]
    return float((z - path).mean()), marginal, np.where(trans == BARRED, 0, grad_t)


def gradients(model: Model, x: np.ndarray, y: np.ndarray):
    """Loss and gradients of all weights on windows x, y (T, B)."""
    keep: list = []
    kinds = emissions(model, x, keep).transpose(0, 2, 1)
    scores = np.concatenate([np.zeros_like(kinds[:, :, :1]), kinds], axis=2)
    loss, ds, d_trans = _crf_gradient(model, scores, y)
    ds = np.ascontiguousarray(ds[:, :, 1:] / x.shape[1])
    seen = np.eye(CLASSES, dtype=np.float32)
    out = [np.zeros_like(a) for a in model.arrays()]
    d_table, d_rec, d_out, d_bias, _ = out
    d_bias += ds.sum((0, 1))
    out[4] = (d_trans / x.shape[1]).astype(np.float32)
    dh = dc = None
    last = None
    for d, t, raw, (i, f, o, g), (h0, c0), c, h in reversed(keep):
        if d != last:
            dh = np.zeros_like(h)
            dc = np.zeros_like(c)
            last = d
        d_out[d] += ds[t].T @ h
        dh = dh + ds[t] @ model.out[d]
        flat = np.clip(c, -1, 1)
        do = dh * flat
        dc = dc + dh * o * (np.abs(c) < 1)
        da = np.stack([dc * g, dc * c0, do, 2 * dc * i])
        da *= (raw > -SLACK) & (raw < 1 + SLACK)  # a little slack keeps gates from dying
        dc = dc * f
        dh = np.matmul(da, model.rec[d].transpose(0, 2, 1)).sum(0)
        d_rec[d] += np.matmul(h0.T, da)
        d_table[d] += np.matmul(seen[x[t]].T, da)
    return loss, out


def train(x: np.ndarray, y: np.ndarray, labels: int, *, seed: int = 7, epochs: int = 8, batch: int = 128, rate: float = 0.02) -> Model:
    """Adam over windows x, y (N, T); deterministic for given data and seed."""
    model = initial(labels, seed)
    rng = np.random.default_rng(seed)
    m = [np.zeros_like(a) for a in model.arrays()]
    v = [np.zeros_like(a) for a in model.arrays()]
    step, total = 0, epochs * (len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for b in range(0, len(x) - batch + 1, batch):
            pick = order[b : b + batch]
            _, grads = gradients(model, x[pick].T, y[pick].T)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            lr = rate * (1 - step / (total + 1))
            for a, g, p, q in zip(model.arrays(), grads, m, v):
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                p += 0.1 * (g - p)
                q += 0.01 * (g * g - q)
                a -= (lr * (p / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    model.trans[:] = _legal(model.trans)
    return model


def islands(model: Model, scores: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of a document's scores (K-1, L) outside of which some best path is "outside".

    A run of a kind gains its summed scores plus at most a toll. No run through
    a position gains if the best sum through it, from running sums and their
    extremes, plus the toll is not positive.
    """
    trans = _legal(model.trans).astype(np.float64)
    into, out, inside, idle = trans[0, 1:], trans[1:, 0], np.diag(trans)[1:], trans[0, 0]
    toll = np.max([into + out - idle - inside, out - inside, into - inside, idle - inside], axis=0)
    step = scores + (inside - idle)[:, None]
    total = np.cumsum(step, axis=1)
    before = total - step
    reach = np.maximum.accumulate(total[:, ::-1], axis=1)[:, ::-1] - np.minimum.accumulate(before, axis=1)
    open_ = np.concatenate([[False], (reach + toll[:, None] > 0).any(axis=0), [False]])
    edges = np.flatnonzero(open_[1:] != open_[:-1]).tolist()
    return list(zip(edges[::2], edges[1::2]))


def best_paths(model: Model, texts: list[np.ndarray]) -> list[np.ndarray]:
    """Viterbi labels of whole documents, each given by its scores (K-1, L).

    Islands are decoded in batches; around each the path is "outside", so their
    paths together are the document's best path.
    """
    result = [np.zeros(x.shape[1], np.uint8) for x in texts]
    groups: dict[tuple[int, bool], list[tuple[int, int, int]]] = {}
    for n, x in enumerate(texts):
        for a, b in islands(model, x):
            ends = b == x.shape[1]
            lead = int(a > 0)
            groups.setdefault((lead + b - a if ends else -(-(lead + b - a + 1) // 16) * 16, ends), []).append((n, a, b))
    for (length, _), jobs in groups.items():
        for c in range(0, len(jobs), 4096):
            part = jobs[c : c + 4096]
            s = np.full((length, len(model.bias), len(part)), BARRED, np.float32)  # barred where the path is outside for certain
            for r, (n, a, b) in enumerate(part):
                s[int(a > 0) : int(a > 0) + b - a, :, r] = texts[n][:, a:b].T
            y = decode(model, s)
            for r, (n, a, b) in enumerate(part):
                result[n][a:b] = y[int(a > 0) : int(a > 0) + b - a, r]
    return result


def text_scores(model: Model, texts: list[str], *, window: int = 512, halo: int = 32, lanes: int = 2048) -> list[np.ndarray]:
    """Scores (K-1, length) of every code point of every text, from windows that overlap by twice the halo."""
    coded = [classes(t) for t in texts]
    result = [np.empty((len(model.bias), len(x)), np.float32) for x in coded]
    stride = window - 2 * halo
    groups: dict[int, list[tuple[int, int, int]]] = {}
    for n, x in enumerate(coded):
        for start in range(0, max(len(x) - 2 * halo, 1), stride):
            size = min(window, len(x) - start)
            if size:
                groups.setdefault(-(-size // 64) * 64, []).append((n, start, size))
    for length, jobs in groups.items():
        for b in range(0, len(jobs), lanes):
            part = jobs[b : b + lanes]
            x = np.full((len(part), length), PAD, np.uint8)
            for r, (n, start, size) in enumerate(part):
                x[r, :size] = coded[n][start : start + size]
            scores = np.ascontiguousarray(emissions(model, np.ascontiguousarray(x.T)).transpose(2, 1, 0))
            for r, (n, start, size) in enumerate(part):
                lo = 0 if start == 0 else halo
                hi = size if start + size == len(coded[n]) else window - halo
                result[n][:, start + lo : start + hi] = scores[r, :, lo:hi]
    return result


def label_texts(model: Model, texts: list[str], **how: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labels and scores of every code point of every text."""
    scores = text_scores(model, texts, **how)
    return list(zip(best_paths(model, scores), scores))


def gain(model: Model, scores: np.ndarray, kind: int, a: int, b: int) -> float:
    """By how much the path that is ``kind`` (from 0) from a to b, between outsides, beats "outside" there."""
    trans = _legal(model.trans)
    idle = float(trans[0, 0])
    inside = (b - a - 1) * float(trans[kind + 1, kind + 1])
    return float(scores[kind, a:b].sum(dtype=np.float64)) + float(trans[0, kind + 1] + trans[kind + 1, 0]) + inside - (b - a + 1) * idle
