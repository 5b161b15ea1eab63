"""A character-level bidirectional LSTM with CRF transitions in plain numpy: training, and decoding of windows.

Arrays are laid out (features, windows), so that every gate is one contiguous block. Sigmoids are written with
tanh, and the input projection is a table lookup, as an input is one of CLASSES characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
F32 = np.float32


def _classes() -> tuple[np.ndarray, int]:
    """A class for each code point under 128, and one for all others at 128: digits share one, letters two by
    case but for those of "at", "dot" and "com", punctuation and spaces have one each."""
    table, n = np.zeros(129, np.uint8), 0
    for group in ("0123456789", "bfghijklnpqrsuvwxyze", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", *"atdocm", *"\n\t !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        n += 1
        for c in group:
            table[ord(c)] = n
    table[128] = n + 1  # control characters keep class 0
    return table, n + 3


_TABLE, CLASSES = _classes()
PAD = CLASSES - 1


def classes_of(codes: np.ndarray) -> np.ndarray:
    return _TABLE[np.minimum(codes, 128)]


def allowed_transitions() -> tuple[np.ndarray, np.ndarray]:
    """Which tag may follow which, and which may come first: I only after B or I of its kind."""
    ok = np.ones((TAGS, TAGS), dtype=bool)
    first = np.ones(TAGS, dtype=bool)
    for k in range(len(KINDS)):
        i = 2 + 2 * k
        ok[:, i] = False
        ok[[i - 1, i], i] = True
        first[i] = False
    return ok, first


@dataclass
class Model:
    table: np.ndarray  # (2, 4H, CLASSES)
    inner: np.ndarray  # (2, 4H, H)
    out: np.ndarray  # (TAGS, 2H)
    bias: np.ndarray  # (TAGS,)
    move: np.ndarray  # (TAGS, TAGS) from, to

    @property
    def hidden(self) -> int:
        return self.inner.shape[2]

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.out, self.bias, self.move]

    @classmethod
    def fresh(cls, hidden: int, rng: np.random.Generator) -> "Model":
        table = rng.normal(0, 0.3, (2, 4 * hidden, CLASSES)).astype(F32)
        table[:, hidden : 2 * hidden] += 1  # forget gates start open
        inner = rng.normal(0, 1 / np.sqrt(hidden), (2, 4 * hidden, hidden)).astype(F32)
        out = rng.normal(0, 0.3, (TAGS, 2 * hidden)).astype(F32)
        return cls(table, inner, out, np.zeros(TAGS, F32), np.zeros((TAGS, TAGS), F32))

    def run(self, x: np.ndarray, keep: bool = False):
        """Emissions (T, TAGS, N) for classes x (T, N); with keep also what training needs."""
        steps, n = x.shape
        h_all = np.empty((2, steps, self.hidden, n), F32)
        kept = []
        live = x != PAD
        for d in range(2):
            size = self.hidden
            h, c = np.zeros((size, n), F32), np.zeros((size, n), F32)
            states = []
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                z = np.take(self.table[d], x[t], axis=1)
                z += self.inner[d] @ h
                z[: 3 * size] *= F32(0.5)
                np.tanh(z, out=z)
                z[: 3 * size] += 1
                z[: 3 * size] *= F32(0.5)
                before = (h, c)
                c = z[size : 2 * size] * c + z[:size] * z[3 * size :]
                tc = np.tanh(c)
                h = z[2 * size : 3 * size] * tc
                if not live[t].all():
                    h *= live[t]
                    c *= live[t]
                h_all[d, t] = h
                if keep:
                    states.append((t, z, before, tc))
            kept.append(states)
        both = np.concatenate([h_all[0], h_all[1]], axis=1)
        emissions = self.out @ both + self.bias[:, None]
        return (emissions, both, kept, live) if keep else emissions

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag path (T, N) by Viterbi; padding is O."""
        ok, first = allowed_transitions()
        move = np.where(ok, self.move, F32(-1e4))
        e = self.run(x)
        e[:, 1:][np.broadcast_to((x == PAD)[:, None], e[:, 1:].shape)] = -1e4
        steps, _, n = e.shape
        score = e[0] + np.where(first, 0, F32(-1e4))[:, None]
        back = np.zeros((steps, TAGS, n), np.uint8)
        for t in range(1, steps):
            best, arg = np.full((TAGS, n), -np.inf, F32), back[t]
            for a in range(TAGS):
                s = score[a] + move[a][:, None]
                better = s > best
                np.copyto(best, s, where=better)
                arg[better] = a
            score = best + e[t]
        path = np.empty((steps, n), np.uint8)
        path[-1] = score.argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = np.take_along_axis(back[t], path[t][None].astype(np.int64), axis=0)[0]
        return path


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradients(model: Model, x: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log likelihood of the tag paths and its gradients."""
    e, both, kept, live = model.run(x, keep=True)
    steps, n = x.shape
    ok, first = allowed_transitions()
    move = np.where(ok, model.move, F32(-1e4)).astype(np.float64)
    e64 = np.where(live[:, None], e, 0.0)
    alpha = np.empty((steps, TAGS, n))
    alpha[0] = e64[0] + np.where(first, 0, -1e4)[:, None]
    for t in range(1, steps):
        new = _logsum(alpha[t - 1][:, None] + move[:, :, None], 0) + e64[t]
        alpha[t] = np.where(live[t], new, alpha[t - 1])
    beta = np.zeros((steps, TAGS, n))
    for t in range(steps - 2, -1, -1):
        new = _logsum(move[:, :, None] + (e64[t + 1] + beta[t + 1])[None], 1)
        beta[t] = np.where(live[t + 1], new, beta[t + 1])
    z = _logsum(alpha[-1], 0)
    column = np.arange(n)
    loss = z.sum()
    de = np.exp(alpha + beta - z) * live[:, None]
    dmove = np.zeros((TAGS, TAGS))
    for t in range(steps):
        w = live[t]
        loss -= (e64[t, tags[t], column] * w).sum()
        de[t, tags[t], column] -= w
        if t:
            loss -= (move[tags[t - 1], tags[t]] * w).sum()
            pair = np.exp(alpha[t - 1][:, None] + move[:, :, None] + (e64[t] + beta[t])[None] - z) * w
            dmove += pair.sum(axis=2)
            np.add.at(dmove, (tags[t - 1][w], tags[t][w]), -1)
    de = (de / n).astype(F32)
    size = model.hidden
    dout = np.einsum("tan,thn->ah", de, both, optimize=True)
    dboth = np.einsum("ah,tan->thn", model.out, de, optimize=True)
    dtable, dinner = np.zeros_like(model.table), np.zeros_like(model.inner)
    hot = np.arange(CLASSES)[None, :]
    for d in range(2):
        dh, dc = np.zeros((size, n), F32), np.zeros((size, n), F32)
        for t, g, (h0, c0), tc in reversed(kept[d]):
            dh = (dh + dboth[t, d * size : (d + 1) * size]) * live[t]
            i, f, o, u = g[:size], g[size : 2 * size], g[2 * size : 3 * size], g[3 * size :]
            dc = (dc + dh * o * (1 - tc * tc)) * live[t]
            dz = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)])
            dinner[d] += dz @ h0.T
            dtable[d] += dz @ (x[t][:, None] == hot).astype(F32)
            dh = model.inner[d].T @ dz
            dc = dc * f
    return loss / n, [dtable, dinner, dout, de.sum(axis=(0, 2)), np.where(ok, dmove / n, 0).astype(F32)]


def train(windows: np.ndarray, tags: np.ndarray, hidden: int = 12, epochs: int = 3, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on windows (count, T) of classes and their tags."""
    rng = np.random.default_rng(seed)
    model = Model.fresh(hidden, rng)
    m = [np.zeros_like(p) for p in model.parameters()]
    v = [np.zeros_like(p) for p in model.parameters()]
    step, total = 0, epochs * (len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order) - batch + 1, batch):
            own = order[at : at + batch]
            _, grads = gradients(model, np.ascontiguousarray(windows[own].T), np.ascontiguousarray(tags[own].T).astype(np.int64))
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            now = rate * min(1.0, 2 * (1 - step / (total + 1)))
            for p, g, a, b in zip(model.parameters(), grads, m, v, strict=True):
                g = g * min(1.0, 5 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(F32)
    return model
