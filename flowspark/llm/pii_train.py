"""Trains the tagger and writes its weights beside this file: python -m flowspark.llm.pii_train [PATH]."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np

from .pii_labels import sample
from .pii_model import F32, Model, train

WEIGHTS = Path(__file__).with_name("pii_weights.npz")
WINDOWS, LENGTH, HIDDEN, EPOCHS, BATCH, RATE = 20000, 64, 20, 14, 32, 0.02


def save(model: Model, path: Path = WEIGHTS) -> None:
    np.savez_compressed(path, **{k: getattr(model, k).astype(np.float16) for k in ("table", "inner", "out", "bias", "move")})


def stored(path: Path = WEIGHTS) -> Model:
    with np.load(path) as f:
        return Model(*(f[k].astype(F32) for k in ("table", "inner", "out", "bias", "move")))


def held_out(model: Model, seed: int = 99, count: int = 600) -> tuple[float, float]:
    """Precision and recall of whole spans inside windows that training never saw."""
    x, y, _ = sample(seed, count, LENGTH)
    found = model.decode(np.ascontiguousarray(x.T)).T
    hits = made = there = 0
    for a, b in zip(found, y, strict=True):
        a, b = ({s for s in spans_of(t) if s[1] > 0 and s[2] < LENGTH} for t in (a, b))
        hits, made, there = hits + len(a & b), made + len(a), there + len(b)
    return hits / max(1, made), hits / max(1, there)


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans that a tag path holds."""
    begin = np.flatnonzero(tags % 2 == 1)
    out = []
    for s in begin:
        e = s + 1
        while e < len(tags) and tags[e] == tags[s] + 1:
            e += 1
        out.append((int(tags[s]) // 2, int(s), int(e)))
    return out


if __name__ == "__main__":
    x, y, _ = sample(1, WINDOWS, LENGTH)
    trained = train(x, y, hidden=HIDDEN, epochs=EPOCHS, batch=BATCH, rate=RATE)
    save(trained, Path(sys.argv[1]) if len(sys.argv) > 1 else WEIGHTS)
    print(held_out(trained))
