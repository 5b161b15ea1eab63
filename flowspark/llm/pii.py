"""Personal data (operator 10): rule-found spans, and spans added by a character-level BiLSTM-CRF.

The tagger (pii_model, trained by pii_train on labelled spans) reads a text in windows of WINDOW characters, each
beginning WINDOW - OVERLAP after the one before. Every window is decoded by itself; a text's spans are then
reconciled as a whole: of spans that overlap, the one farther from the cut edges of its window stays, so a span at
the rim of one window yields to the same span seen whole by its neighbour.

An added span must say something a person could be reached or charged by: its kind's ``ACCEPT`` test. Every one of
these needs a digit, an at sign or a bracketed "at". So windows with none of these cannot add a span whatever the
tagger says, and are not decoded; this changes no result. A base span always stays; added ones that touch one go.

Defined results: null text is empty, with no spans; offsets count code points; texts are read whole; repeated rows
are tagged each; an empty table gives an empty result; columns named like the operator's own (OWN) are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, without
from .pii_model import KINDS, PAD, Model, classes_of
from .pii_train import spans_of, stored

WINDOW, OVERLAP = 384, 96
BATCH = 1024
OWN = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")

Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As a search for local@domain would find them, but from each @ outwards, in linear time for any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += (2 * d - 9 * (d > 4)) if i % 2 else d
    return total % 10 == 0


def _number(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _octets(text: str) -> bool:
    parts = re.findall("[0-9]+", text)
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """By start, then kind."""
    out: list[Span] = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(n := _number(m[0])) <= 19 and luhn(n):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_number(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


_AT = r"(?:@| ?[\[({] ?at ?[\])}] ?)"
_DOT = r"(?:\.| ?[\[({] ?(?:dot|\.) ?[\])}] ?)"
_ACCEPT_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]+ ?{_AT} ?[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_ACCEPT_IP = re.compile(rf"[0-9]+(?:{_DOT}[0-9]+){{3}}")
_ACCEPT_CARD = re.compile(r"[0-9](?:[ ./-]?[0-9])+")
_ACCEPT_PHONE = re.compile(r"(?:\+|00|1[-. ])?[0-9]{0,3}[-. ]?\(?[0-9]{2,4}\)?[-. ][0-9]{2,4}[-. ]?[0-9]{2,7}|00[0-9]{8,13}")
#: By kind: whether a span's text can be what the tagger takes it for.
ACCEPT = (
    lambda s: bool(_ACCEPT_EMAIL.fullmatch(s)),
    lambda s: bool(_ACCEPT_IP.fullmatch(s)) and _octets(s),
    lambda s: bool(_ACCEPT_CARD.fullmatch(s)) and 14 <= len(n := _number(s)) <= 19 and luhn(n),
    lambda s: bool(_ACCEPT_PHONE.fullmatch(s)) and 10 <= len(_number(s)) <= 15,
)


def window_starts(length: int) -> range:
    return range(0, max(1, length - OVERLAP), WINDOW - OVERLAP)


def tagged_spans(model: Model, texts: list[str], skip: bool = True) -> list[list[Span]]:
    """The tagger's spans in each text, reconciled; skip leaves out windows that cannot add any."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    windows: list[tuple[int, int]] = []
    for i, c in enumerate(codes):
        starts = np.array(window_starts(len(c)))
        if skip:
            text = texts[i]
            if not (_DIGIT.search(text) or "@" in text or "at" in text.lower()):
                continue
            mark = np.flatnonzero(((c >= 48) & (c <= 57)) | (c == 64) | (c == 40) | (c == 91) | (c == 123))
            starts = starts[np.searchsorted(mark, starts + WINDOW) > np.searchsorted(mark, starts)]
        windows += [(i, int(s)) for s in starts]
    found: list[list[tuple[int, Span]]] = [[] for _ in texts]
    windows.sort(key=lambda w: min(WINDOW, len(codes[w[0]]) - w[1]))
    for at in range(0, len(windows), BATCH):
        own = windows[at : at + BATCH]
        width = max(1, max(min(WINDOW, len(codes[i]) - s) for i, s in own))
        x = np.full((len(own), width), PAD, np.uint8)
        for k, (i, s) in enumerate(own):
            part = codes[i][s : s + WINDOW]
            x[k, : len(part)] = classes_of(part)
        tags = model.decode(np.ascontiguousarray(x.T)).T
        for k in np.flatnonzero(tags.any(axis=1)):
            i, s = own[k]
            end = min(s + WINDOW, len(codes[i]))
            for kind, a, b in spans_of(tags[k]):
                a, b = a + s, b + s
                room = min(a - s if s else WINDOW, end - b if end < len(codes[i]) else WINDOW)
                found[i].append((room, (kind, a, b)))
    return [reconcile(f) for f in found]


def reconcile(found: list[tuple[int, Span]]) -> list[Span]:
    """Spans that do not overlap: those with more room to their window's cut edges first, then longer, then earlier."""
    out: list[Span] = []
    for _, (kind, a, b) in sorted(set(found), key=lambda f: (-f[0], f[1][1] - f[1][2], f[1][1], f[1][0])):
        if all(b <= x or a >= y for _, x, y in out):
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (s[1], s[0]))


def trim(text: str, span: Span) -> Span:
    """A span less the spaces and stops at its ends."""
    kind, a, b = span
    while a < b and text[a] in " \n\t.,;:*#%&$":
        a += 1
    while b > a and text[b - 1] in " \n\t.,;:*#%&$-":
        b -= 1
    return kind, a, b


def added_spans(text: str, tagged: list[Span], base: list[Span]) -> list[Span]:
    out = []
    for span in tagged:
        kind, a, b = trim(text, span)
        word = lambda c: c.isalnum() or c == "_"
        whole = not (a and word(text[a - 1]) and word(text[a])) and not (b < len(text) and word(text[b]) and word(text[b - 1]))
        if b > a and whole and ACCEPT[kind](text[a:b]) and all(b <= x or a >= y for _, x, y in base):
            out.append((kind, a, b))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(model: Model, texts: list[str], skip: bool = True) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans."""
    base = [base_spans(t) for t in texts]
    tagged = tagged_spans(model, texts, skip)
    return [(b, sorted(b + added_spans(t, s, b), key=lambda x: (x[1], x[0], x[2]))) for t, s, b in zip(texts, tagged, base, strict=True)]


def _fields(docs: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)


def tag(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all, as kind:start:end) and n_added."""
    docs = without(docs, OWN)
    kept = [c for c in docs.columns if keep_text or c != text]
    shared = docs.sparkSession.sparkContext.broadcast(stored())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                texts = part.column(text).fill_null("").to_pylist()
                rows = []
                for base, every in find(shared.value, texts):
                    counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                    rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every) - len(base)))
                types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
                own = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *own], names=[*kept, *OWN])

    return docs.mapInArrow(run, f"{_fields(docs, kept)}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask_text(text: str, spans: list[Span]) -> str:
    """text with each span (overlapping ones together) as its kind in brackets."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in its texts replaced by its kind."""
    shared = docs.sparkSession.sparkContext.broadcast(stored())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                texts = part.column(text).to_pylist()
                found = find(shared.value, [t or "" for t in texts])
                new = [t if t is None else mask_text(t, every) for t, (_, every) in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else part.column(c) for c in names], names=names)

    return docs.mapInArrow(run, _fields(docs, names))
