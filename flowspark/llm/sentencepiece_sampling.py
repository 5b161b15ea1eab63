"""SentencePiece encoding and decoding (operator 8): sampled segmentations by forward filtering and backward sampling.

A text is a lattice whose edges are the vocabulary's pieces. Spaces are written as U+2581, which pieces hold only at
their start, so the lattice falls apart into segments (spaces, then other characters) that are sampled on their own
with the same result. Distinct segments of a batch get their edges and forward sums once, by numpy over all of them;
then every occurrence walks back from its end, choosing among the edges that arrive there by their share of the
forward sum. The random number at a position depends on the seed, the row's key and the position alone, so a row's
pieces are the same in any batch, partition or run.

Nothing is added or normalised: a character without a piece of its own is written as its bytes, and so is a U+2581 of
the text itself; decoding gives back every text, byte for byte.

A piece weighs (1 + |score|) ** -alpha if scores are merge ranks, as in BPE vocabularies, and exp(alpha * score) if they
are log probabilities.

Defined results: null text has null pieces; empty text has none; a null key counts as a key of its own; texts of any
length are encoded whole; repeated rows are encoded alike; an empty table gives an empty result; columns of the input
named n_pieces or pieces are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _R, U64, Texts, mix, pieces, range_hash, without

SPACE = 0x2581
_FOREIGN = 0x110000  # a U+2581 of the text itself: no piece has it
_FILTER = 1 << 16


class Vocabulary:
    """Pieces by length, their weights, and the bytes that each id stands for."""

    def __init__(self, named: list[tuple[str, float, str]], alpha: float, ranked: bool):
        """named: piece, score and kind ("text", "byte" or "other") by id."""
        self.bytes: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int32)
        by_length: dict[int, list[tuple[int, int, float]]] = {}
        weight = lambda score: -alpha * float(np.log1p(abs(score))) if ranked else alpha * score
        self.fallback = weight(len(named)) if ranked else weight(min((s for _, s, k in named if k == "text"), default=0.0) - 10)
        for i, (piece, score, kind) in enumerate(named):
            if kind == "byte":
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif kind == "text":
                self.bytes.append(piece.replace(chr(SPACE), " ").encode())
                codes = np.array([ord(c) for c in piece], np.uint32)
                key = int(_hashes(codes, np.array([0]), np.array([len(codes)]))[0])
                by_length.setdefault(len(codes), []).append((key, i, weight(score)))
            else:
                self.bytes.append(b"")
        self.tables = {}
        for n, rows in sorted(by_length.items()):
            rows.sort()
            keys = np.array([r[0] for r in rows], U64)
            # by lower bits: 0 for no key, the place of the only one from 1 on, or -1 for several
            low = (keys & U64(_FILTER - 1)).astype(np.int64)
            slots = np.zeros(_FILTER, np.int32)
            slots[low] = np.arange(1, len(keys) + 1)
            slots[np.bincount(low, minlength=_FILTER) > 1] = -1
            self.tables[n] = (keys, np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows]), slots)

    @classmethod
    @functools.lru_cache(maxsize=4)
    def load(cls, path: str, alpha: float = 1.0, ranked: bool = True) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "text"
        return cls([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())], alpha, ranked)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()


def _values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(U64) + U64(1))


def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(_values(codes), starts, ends)


def _segments(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of segments: a text's start, and every space after another character."""
    begin = np.zeros(len(codes) + 1, bool)
    begin[1:-1] = (codes[1:] == SPACE) & (codes[:-1] != SPACE)
    begin[offsets] = True
    begin[-1] = False
    return np.flatnonzero(begin)


class Lattice:
    """Edges of some segments laid end to end, with the chance of each edge given the position where it ends."""

    def __init__(self, vocabulary: Vocabulary, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """The segments are codes[start:end], adjoining from 0 on."""
        n, size = len(codes), ends - starts
        until = np.repeat(ends, size)
        at, to, piece, weight = [], [], [], []
        single = np.zeros(n, bool)
        place = np.arange(n)
        open_ = place  # where a piece of this length fits
        for length, sums in _sliding(_values(codes), max(vocabulary.tables, default=0)):
            open_ = open_[open_ + length <= until[open_]]
            if not len(open_):
                break
            if length not in vocabulary.tables:
                continue
            keys, ids, weights, slots = vocabulary.tables[length]
            h = mix(sums[open_] + U64(length * 0x9E3779B97F4A7C15 % (1 << 64)))
            k = slots[h & U64(_FILTER - 1)]
            may = np.flatnonzero(k)
            begin, h, k = open_[may], h[may], k[may] - 1
            several = np.flatnonzero(k < 0)
            k[several] = np.minimum(np.searchsorted(keys, h[several]), len(keys) - 1)
            hit = keys[k] == h
            begin, k = begin[hit], k[hit]
            at.append(begin)
            to.append(begin + length)
            piece.append(ids[k])
            weight.append(weights[k])
            if length == 1:
                single[begin] = True
        rest = np.flatnonzero(~single)
        at.append(rest)
        to.append(rest + 1)
        piece.append(np.full(len(rest), -1, np.int32))
        weight.append(np.full(len(rest), vocabulary.fallback))
        at, to, piece, weight = map(np.concatenate, (at, to, piece, weight))
        # a state is a position after which a segment goes on or ends: position p of the segment that holds p - 1. Edges lie by the
        # depth of the state that they reach (characters before it in its segment), then by state, so each depth is one slice
        depth = place + 1 - np.repeat(starts, size)
        by = np.argsort(depth, kind="stable") + 1
        bounds = np.searchsorted(depth[by - 1], np.arange(1, int(size.max(initial=0)) + 2))
        rank = np.empty(n + 1, np.int64)
        rank[by] = np.arange(n)
        longest = int((to - at).max(initial=0)) + 1
        order = np.argsort(rank[to] * longest + (longest - 1 - (to - at)))
        self.at, self.piece, weight = at[order], piece[order], weight[order]
        count = np.bincount(to, minlength=n + 1)[by]
        stop = np.cumsum(count)
        self.first, self.last = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.first[by], self.last[by] = stop - count, stop - 1
        begins = np.zeros(n + 1, bool)
        begins[starts] = True
        source = np.where(begins[self.at], n + 1, self.at)  # a segment's start is a state of its own, with weight 0
        log = np.zeros(n + 2)
        self.chance = np.empty(len(self.at))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if lo == hi:
                continue
            a, b = stop[lo] - count[lo], stop[hi - 1]
            group, own = stop[lo:hi] - count[lo:hi] - a, count[lo:hi]
            x = log[source[a:b]] + weight[a:b]
            top = np.maximum.reduceat(x, group)
            e = np.exp(x - np.repeat(top, own))
            total = np.add.reduceat(e, group)
            log[by[lo:hi]] = top + np.log(total)
            self.chance[a:b] = e / np.repeat(total, own)

    def arrive(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge into each state that u chooses: states have few edges, so they are walked side by side."""
        edge, last = self.first[state], self.last[state]
        left = u - self.chance[edge]
        go = np.flatnonzero((left >= 0) & (edge < last))
        while len(go):
            edge[go] += 1
            left[go] -= self.chance[edge[go]]
            go = go[(left[go] >= 0) & (edge[go] < last[go])]
        return edge


def _sliding(values: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length from 1 the sums that range_hash forms of values[b : b + length], at every b with so many values left."""
    sums = np.zeros(len(values), U64)
    power = 1
    with np.errstate(over="ignore"):
        for length in range(1, min(longest, len(values)) + 1):
            sums[: len(values) - length + 1] += values[length - 1 :] * U64(power)
            power = power * _R % (1 << 64)
            yield length, sums


def _draw(seeds: np.ndarray, positions: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(seeds + positions.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(11)).astype(np.float64) * 2.0**-53


def _utf8(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of characters as (n, 4) bytes, and how many of them count."""
    c = np.where(codes == _FOREIGN, SPACE, codes).astype(np.uint32)
    n = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
    out = np.zeros((len(c), 4), np.uint32)
    for k in range(4):
        for size in range(k + 1, 5):
            own = n == size
            part = c[own] >> np.uint32(6 * (size - 1 - k))
            if k:
                part = 0x80 | (part & 0x3F)
            elif size > 1:
                part = part | (0xF00 >> size & 0xFF)
            out[own, k] = part
    return out, n


def sample(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Sampled piece ids of each text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return [np.zeros(0, np.int32) for _ in texts]
    codes = np.where(codes == SPACE, _FOREIGN, np.where(codes == 32, SPACE, codes))
    starts = _segments(codes, offsets)
    ends = np.append(starts[1:], len(codes))
    _, pick, which = np.unique(_hashes(codes, starts, ends), return_index=True, return_inverse=True)
    size = (ends - starts)[pick]
    base = np.concatenate([[0], np.cumsum(size)])
    own = np.arange(base[-1]) + np.repeat(starts[pick] - base[:-1], size)
    order = np.argsort(size, kind="stable")  # long segments last, in lattices of their own
    short = np.ones(len(size), bool)
    short[order[size[order] > 256]] = False
    ids = np.full(len(codes), -2, np.int32)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    with np.errstate(over="ignore"):
        seeds = mix(mix(keys + U64(seed) * U64(0xD1B54A32D192ED03)))[owner]
    groups = [np.flatnonzero(short)] + [np.array([k]) for k in np.flatnonzero(~short)]
    for group in groups:
        if not len(group):
            continue
        g_size = size[group]
        g_end = np.cumsum(g_size)
        g_start = g_end - g_size
        inner = np.concatenate([own[base[k] : base[k + 1]] for k in group]) if len(group) == 1 else own[np.repeat(short, size)]
        lattice = Lattice(vocabulary, codes[inner], g_start, g_end)
        place = np.full(len(size), -1)
        place[group] = np.arange(len(group))
        occ = np.flatnonzero(place[which] >= 0) if len(groups) > 1 else np.arange(len(which))
        kind = place[which[occ]]
        shift = starts[occ] - g_start[kind]  # from a place in the lattice to the text
        state, stop = g_end[kind].copy(), g_start[kind]
        origin = offsets[owner[occ]]
        live = np.arange(len(occ))
        while len(live):
            s = state[live]
            here = s + shift[live] - origin[live]
            e = lattice.arrive(s, _draw(seeds[occ[live]], here))
            state[live] = lattice.at[e]
            ids[lattice.at[e] + shift[live]] = lattice.piece[e]
            live = live[lattice.at[e] > stop[live]]
    taken = np.flatnonzero(ids != -2)
    out, text_of = ids[taken], np.searchsorted(offsets, taken, side="right") - 1
    raw = np.flatnonzero(out == -1)
    if len(raw):
        data, n = _utf8(codes[taken[raw]])
        times = np.ones(len(out), np.int64)
        times[raw] = n
        out, text_of = np.repeat(out, times), np.repeat(text_of, times)
        out[out == -1] = vocabulary.byte_ids[data[np.arange(4) < n[:, None]]]
    return np.split(out, np.searchsorted(text_of, np.arange(1, len(texts))))


def key_hashes(column: pa.Array) -> np.ndarray:
    return np.where(np.asarray(column.is_null()), U64(3), Texts.of(column.cast(pa.string())).hashes())


def encode(docs: DataFrame, path: str, alpha: float = 1.0, seed: int = 0, text: str = "text", key: str = "doc_id", ranked: bool = True, verify: bool = False) -> DataFrame:
    """docs with pieces (sampled ids) and n_pieces, and with verify also lossless: whether they decode to the text.

    The vocabulary is read by the driver and broadcast; its file bounds it.
    """
    docs = without(docs, ("pieces", "n_pieces", "lossless") if verify else ("pieces", "n_pieces"))
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path, alpha, ranked))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                null = np.asarray(part.column(text).is_null())
                found = sample(shared.value, part.column(text).fill_null("").to_pylist(), key_hashes(part.column(key)), seed)
                sizes = np.array([len(f) for f in found], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(null, False))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32()))
                cols, own = [*(part.column(c) for c in names), ids, pa.array(sizes, mask=null)], [*names, "pieces", "n_pieces"]
                if verify:
                    same = [shared.value.decode(f.tolist()) == (t or "") for f, t in zip(found, part.column(text).to_pylist(), strict=True)]
                    cols, own = [*cols, pa.array(same)], [*own, "lossless"]
                yield pa.RecordBatch.from_arrays(cols, names=own)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, pieces array<int>, n_pieces long{', lossless boolean' * verify}")


def decode(encoded: DataFrame, path: str, column: str = "decoded") -> DataFrame:
    """encoded with the text that its pieces stand for."""
    encoded = without(encoded, (column,))
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [None if x is None else shared.value.decode(x) for x in part.column("pieces").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, `{column}` string")
