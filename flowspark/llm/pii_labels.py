"""Labelled spans to learn from: invented prose with invented personal data in many spellings, and look-alikes that are none."""

from __future__ import annotations

import random

import numpy as np

from .pii_model import KINDS, classes_of

_SYLLABLES = "an ti on er ing the sh ea or st ou re ha le que oi eau ment la de ch ein der un sch ung ber ción ado ra ña os mi ga ta el und é ö".split()


def _word(r: random.Random) -> str:
    w = "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))
    return w.capitalize() if r.random() < 0.12 else w


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _luhn(r: random.Random, n: int) -> str:
    body = r.choice("3456") + _digits(r, n - 2)
    total = sum(x if i % 2 else (2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(body))))
    return body + str(-total % 10)


def _email(r: random.Random) -> str:
    name = r.choice((_word(r).lower(), f"{_word(r).lower()}.{_word(r).lower()}", f"{_word(r).lower()}{_digits(r, 2)}", f"{_word(r).lower()}.{_digits(r, 2)}"))
    name = "".join(c for c in name if c.isascii()) or "ana"
    host = f"{r.choice(('mail', 'mx', 'post', 'example'))}{r.choice(('', _digits(r, 1)))}"
    end = r.choice(("com", "org", "net", "co.uk", "de", "fr"))
    host = r.choice((host, f"{host}.example"))
    style = r.random()
    if style < 0.5:
        return f"{name}@{host}.{end}"
    at = r.choice((" (at) ", " [at] ", "(at)", "[at]", " @ ", " {at} "))
    dot = r.choice((".", " (dot) ", "[.]", " [dot] ", "."))
    return f"{name}{at}{host.replace('.', dot)}{dot}{end.replace('.', dot)}"


def _ip(r: random.Random) -> str:
    dot = r.choice((".", ".", "[.]", "(.)"))
    return dot.join(str(r.randint(1, 254)) for _ in range(4))


def _card(r: random.Random) -> str:
    n = _luhn(r, r.choice((16, 16, 16, 15, 14)))
    sep = r.choice(("", "", " ", "-", ".", "/"))
    return sep.join(n[i : i + 4] for i in range(0, len(n), 4)) if sep else n


def _phone(r: random.Random) -> str:
    a, b, c = _digits(r, 3), r.choice(("555", _digits(r, 3))), _digits(r, 4)
    return r.choice((f"+1 ({a}) {b}-{c}", f"+{r.randint(20, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"00{r.randint(30, 49)} {a} {b}{c}", f"+1{a}{b}{c}", f"+1-{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"{a}-{b}-{c}"))


def _other(r: random.Random) -> str:
    """What looks like personal data and is none."""
    return r.choice((
        lambda: _digits(r, r.randint(1, 6)),
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        lambda: f"{r.randint(0, 23)}:{r.randint(10, 59)}",
        lambda: f"{r.randint(0, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}",
        lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}",
        lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"',
        lambda: f"{r.randint(1, 999)},{_digits(r, 3)}.{_digits(r, 2)}",
        lambda: f"#{_digits(r, r.randint(5, 9))}",
        lambda: f"id {_digits(r, r.randint(7, 12))}",
        lambda: f"{_digits(r, 4)}-{_digits(r, 4)}",
        lambda: f"@{_word(r)}",
        lambda: f"{_word(r)} (see {_word(r)}) at {_word(r)}.",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}",
        lambda: f"{r.randint(300, 999)}.{r.randint(300, 999)}.{r.randint(0, 255)}.{r.randint(0, 255)}",
        lambda: r.choice(("###", "%%%", "&&&", "***", "$$$", "|", "<b>")),
    ))()


_MAKERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}


def sample(seed: int, count: int, length: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """count windows of length characters: classes, tags, texts."""
    r = random.Random(seed)
    x, y, texts = np.empty((count, length), np.uint8), np.zeros((count, length), np.uint8), []
    for k in range(count):
        out, spans, at = [], [], 0
        while at < length + 40:
            p = r.random()
            if p < 0.09:
                kind = r.randrange(len(KINDS))
                piece = _MAKERS[KINDS[kind]](r)
                spans.append((kind, at, at + len(piece)))
            else:
                piece = _other(r) if p < 0.24 else _word(r)
            end = r.choice((" ", " ", " ", " ", ", ", ". ", "\n", ".\n", "*** ", "### "))
            out.append(piece + end)
            at += len(piece) + len(end)
        cut = r.randrange(20)
        text = "".join(out)[cut : cut + length]
        texts.append(text)
        x[k] = classes_of(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        for kind, a, b in spans:
            a, b = a - cut, min(b - cut, length)
            if 0 <= a < length:
                y[k, a] = 1 + 2 * kind
                y[k, a + 1 : b] = 2 + 2 * kind
            elif b > 0:
                y[k, 0] = 1 + 2 * kind
                y[k, 1:b] = 2 + 2 * kind
    return x, y, texts
