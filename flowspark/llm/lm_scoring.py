"""LM scoring (operator 4): a log-frequency Bloom filter of quantised n-gram counts, probed for every distinct bigram.

Counts are gathered in two passes over the training texts, summed within tasks first: words, then bigrams, each packed
by hash bucket. A bigram is dealt by its context, so that a bucket has all of a context's bigrams and knows its count and
discounted mass; the bigrams of contexts with over 1 / (spread * buckets) of all tokens (at most spread * buckets of them)
are dealt by the pair, and their contexts' sums added up after. Every bigram enters the filter, at any corpus size, as its
levels 1..q of the logarithm of its count; a probe asks for level after level until one is missing. The filter also
holds each context's count and mass.

A model of up to ``broadcast`` bytes is broadcast to the workers. A larger one stays in its buckets: workers tokenise ``chunk``
tokens at a time and send the distinct keys that these need to the buckets, whose answers come back to the chunk (its
words travel along in packed form). So no memory grows with the corpus. Both ways give the same scores.

p(w | v) = SHARE * (c(v w) - DISCOUNT) / c(v) + (1 - SHARE * mass(v) / c(v)) * p(w), where p(w) is the add-0.1 unigram
estimate of the base score, from exact counts of all words, c(v w) is rounded down to its level, and c(v) and mass(v) are
rounded up, so the sum over w stays at most 1 but for the filter's false positives (about 1 %). The formula is the
same for every word, context and corpus size.

Defined results: null text is empty and has the end token alone; a null doc_id counts as held out; rows that repeat
count each; without training rows N is 0 and scores come from the add-0.1 estimate with V = 0; an empty table gives
an empty result; other columns are not read; a very long text is a chunk of its own, so memory is bounded by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Texts, chain, cut, mix, pieces, signed

BASE = 1.5
SHARE, DISCOUNT, ADD = 0.5, 0.5, 0.1
#: The least count of a bigram, and the least mass of a context.
LEAST, LEAST_MASS = 1.0, 1.0 - DISCOUNT
HASHES = 4
END = np.uint64(0x45D9F3B3335B369)
BEGIN = np.uint64(0x27D4EB2F165667C5)
MASS_TAG, COUNT_TAG = U64(1 << 32), U64(2 << 32)
PAIRS, CONTEXTS, WORDS, ASK_PAIRS, ASK_CONTEXTS, ASK_WORDS, CHUNK_ROW = range(7)
_TOP = U64(32)
_LOW = U64(0xFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    """broadcast: models of up to so many bytes are broadcast; chunk: tokens counted or scored at a time; spread: contexts
    with 1 / (spread * buckets) of the tokens are spread over buckets; bits: of the filter for each level of an item."""

    broadcast: int = 1 << 25
    chunk: int = 1 << 21
    spread: float = 4
    bits: int = 10


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens (words, then the end), of the token before each, and the offset of each text's first."""
    words = texts.words(fold=True)
    n = len(texts)
    own = np.empty(len(words.hashes) + n, U64)
    ends = words.first[1:] + np.arange(n)
    inner = np.ones(len(own), bool)
    inner[ends] = False
    own[inner], own[ends] = words.hashes, END
    first = words.first + np.arange(n + 1)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[first[:-1]] = BEGIN
    return own, before, first


def context_key(v: np.ndarray) -> np.ndarray:
    """The upper half of a bigram's key: 32 bits of its context."""
    return mix(v) & ~_LOW


def bigram_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return context_key(v) | (chain([v, w]) >> _TOP)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper half, so sorted keys have sorted buckets."""
    return ((keys >> _TOP) * U64(buckets)) >> _TOP


def bigram_bucket(keys: np.ndarray, buckets: int, spread: np.ndarray) -> np.ndarray:
    """By the context, or by the whole pair for contexts in spread (sorted context keys)."""
    contexts = keys & ~_LOW
    out = bucket_of(contexts, buckets)
    if len(spread):
        at = np.flatnonzero(spread[np.minimum(np.searchsorted(spread, contexts), len(spread) - 1)] == contexts)
        out[at] = bucket_of(mix(keys[at]), buckets)
    return out


def add_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values (or the number of each)."""
    if not values:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *(np.add.reduceat(x[order], at) if len(at) else x for x in values)


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second, and so on: high bytes are mostly zero and compress well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplaned(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys (gaps of upper halves in planes, lower halves) and counts or levels under 2**32, or under 2**64 if there are two of them."""
    gaps = np.diff(keys >> _TOP, prepend=U64(0)).astype(np.uint32)
    return b"".join([planes(gaps), (keys & _LOW).astype(np.uint32).tobytes(), *(planes(x.astype(np.uint64 if len(values) > 1 else np.uint32)) for x in values)])


def unpack(data: bytes, values: int = 1) -> tuple[np.ndarray, ...]:
    width = 8 if values > 1 else 4
    n = len(data) // (8 + width * values)
    upper = np.cumsum(unplaned(data[: 4 * n], np.uint32).astype(U64), dtype=U64)
    keys = upper << _TOP | np.frombuffer(data, np.uint32, n, 4 * n).astype(U64)
    parts = [data[(8 + width * k) * n : (8 + width * (k + 1)) * n] for k in range(values)]
    return keys, *(unplaned(x, f"u{width}").astype(np.int64) for x in parts)


def _dealt(own: np.ndarray, buckets: int, packed) -> tuple[list[int], list[bytes]]:
    """For sorted buckets own: those that occur, and packed(start, end) of each."""
    cuts = np.searchsorted(own, np.arange(buckets + 1).astype(U64))
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    return some.tolist(), [packed(cuts[b], cuts[b + 1]) for b in some]


def _blob_rows(some: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "data"])


def _counted(buckets: int, spread: np.ndarray | None, most: int):
    """Counts of words, or (with spread) of bigrams, in one row a bucket for each most tokens."""

    def rows(keys: list[np.ndarray]) -> pa.RecordBatch:
        k, c = add_up(np.concatenate(keys))
        own = bucket_of(k, buckets) if spread is None else bigram_bucket(k, buckets, spread)
        if spread is not None and len(spread):
            order = np.argsort(own, kind="stable")
            own, k, c = own[order], k[order], c[order]
        return _blob_rows(*_dealt(own, buckets, lambda a, b: pack(k[a:b], c[a:b])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], 0
        for batch in batches:
            for part in pieces(batch):
                own, before, _ = tokens(Texts.of(part.column("text")))
                keys.append(own if spread is None else bigram_key(before, own))
                held += len(own)
                if held > most:
                    yield rows(keys)
                    keys, held = [], 0
        if held:
            yield rows(keys)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    blobs: dict[int, list[bytes]] = {}
    for batch in batches:
        for b, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
            blobs.setdefault(b, []).append(data)
    for b in list(blobs):
        yield b, blobs.pop(b)


def _summed(blobs: list[bytes], values: int = 1) -> tuple[np.ndarray, ...]:
    parts = [unpack(x, values) for x in blobs]
    return add_up(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return pack(keys) + planes(counts.astype(U64))


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 16
    return unpack(data[: 8 * n], 0)[0], unplaned(data[8 * n :], U64).astype(np.int64)


def _word_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, blobs in _by_bucket(batches):
        keys, counts = _summed(blobs)
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([int(counts.sum())]), pa.array([len(keys)]), pa.array([pack_counts(keys, counts)], pa.binary())], names=["bucket", "n", "v", "data"])


def _frequent(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                keys, counts = unpack_counts(data)
                some = (counts >= least) | (keys == END)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys[some])), pa.array(counts[some])], names=["h", "c"])

    return run


def level_of(x: np.ndarray, least: float) -> np.ndarray:
    """1 + floor(log_BASE(x / least)) for x >= least."""
    return 1 + np.floor(np.log(x / least) / math.log(BASE) + 1e-9).astype(np.int64)


def value_of(level: np.ndarray, least: float) -> np.ndarray:
    """The least value at a level."""
    return least * BASE ** (level - 1.0)


def _places(keys: np.ndarray, level, bits, k: int) -> np.ndarray:
    """The k-th bit of items (key, level) in a shard of so many bits."""
    with np.errstate(over="ignore"):
        h = mix(keys + U64(0x9E3779B97F4A7C15) * np.asarray(level).astype(U64))
        x = ((h >> _TOP) + U64(k) * (h | U64(1))) & _LOW
    return (x * bits) >> _TOP


def shard(keys: np.ndarray, levels: np.ndarray, size: int) -> np.ndarray:
    """size bits, one byte for eight, that hold levels 1..q of each key."""
    keys, level, size = np.repeat(keys, levels), _ramps(levels), U64(size)
    out = np.zeros(int(size), bool)
    for k in range(HASHES):
        out[_places(keys, level, size, k)] = True
    return np.packbits(out, bitorder="little")


def shard_row(bucket: int, keys: np.ndarray, levels: np.ndarray, bits: int) -> list[pa.Array]:
    size = max(64, bits * int(levels.sum()))
    return [pa.array([bucket], pa.int32()), pa.array([size], pa.int64()), pa.array([shard(keys, levels, size).tobytes()], pa.binary())]


def _ramps(levels: np.ndarray) -> np.ndarray:
    """1..q for each q."""
    start = np.repeat(np.cumsum(levels) - levels, levels)
    return np.arange(int(levels.sum())) - start + 1


class LogBloom:
    """Shards side by side, by bucket."""

    def __init__(self, shards: dict[int, tuple[int, bytes]], buckets: int):
        sizes = np.zeros(buckets + 1, np.int64)
        self.bits = np.zeros(buckets, U64)
        for b, (bits, data) in shards.items():
            sizes[b + 1], self.bits[b] = len(data), bits
        self.offsets = np.cumsum(sizes)
        self.data = np.zeros(int(self.offsets[-1]), np.uint8)
        for b, (_, data) in shards.items():
            self.data[self.offsets[b] : self.offsets[b + 1]] = np.frombuffer(data, np.uint8)
        self.buckets = buckets

    def levels(self, keys: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """For each key, looked for in bucket own, the levels found before the first that is missing."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.data):
            return out
        own = (bucket_of(keys, self.buckets) if own is None else own).astype(np.int64)
        left = np.flatnonzero(self.bits[own] > 0)
        level = 0
        while len(left):
            level += 1
            for k in range(HASHES):
                b = own[left]
                at = _places(keys[left], level, self.bits[b], k).astype(np.int64)
                left = left[(self.data[self.offsets[b] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0]
            out[left] = level
        return out


def _filter_rows(spread: np.ndarray, bits: int):
    """Sums a bucket's bigrams; gives its shard, its contexts' counts and numbers of bigrams, and the same of the contexts that are spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in _by_bucket(batches):
            keys, counts = _summed(blobs)
            levels = level_of(counts, LEAST)
            contexts, order = np.unique(keys & ~_LOW, return_inverse=True)
            sums = np.bincount(order, weights=counts).astype(np.int64)
            kinds = np.bincount(order)
            wide = np.isin(contexts, spread)
            own = pack(contexts[~wide], sums[~wide], kinds[~wide])
            part = [{"context": int(c), "n": int(n), "kinds": int(k)} for c, n, k in zip(signed(contexts[wide]), sums[wide], kinds[wide], strict=True)]
            yield pa.RecordBatch.from_arrays([*shard_row(b, keys, levels, bits), pa.array([own], pa.binary()), pa.array([part], _SPREAD_TYPE)], names=["bucket", "bits", "data", "contexts", "spread"])

    return run


_SPREAD_TYPE = pa.list_(pa.struct([("context", pa.int64()), ("n", pa.int64()), ("kinds", pa.int64())]))


def _context_blobs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.asarray(batch.column("context")).astype(np.int64).view(U64)
                order = np.argsort(keys)
                keys, n, kinds = keys[order], np.asarray(batch.column("n"))[order], np.asarray(batch.column("kinds"))[order]
                yield _blob_rows(*_dealt(bucket_of(keys, buckets), buckets, lambda a, b: pack(keys[a:b], n[a:b], kinds[a:b])))

    return run


def _context_shards(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in _by_bucket(batches):
            contexts, n, kinds = _summed(blobs, 2)
            keys = np.concatenate([context_items(contexts, MASS_TAG), context_items(contexts, COUNT_TAG)])
            levels = np.concatenate([level_of(n - DISCOUNT * kinds, LEAST_MASS), level_of(n, LEAST_MASS)])
            yield pa.RecordBatch.from_arrays(shard_row(b, keys, levels, bits), names=["bucket", "bits", "data"])

    return run


def context_items(contexts: np.ndarray, tag: np.uint64) -> np.ndarray:
    return mix(contexts >> _TOP | tag)


class Chunk:
    """Some texts' tokens: distinct words in order, each token's place among them, and what these ask of a model."""

    def __init__(self, ids: pa.Array, words: np.ndarray, which: np.ndarray, first: np.ndarray):
        self.ids, self.words, self.which, self.first = ids, words, which, first
        before = np.empty_like(which)
        before[1:] = which[:-1]
        before[first[:-1]] = len(words)
        self.before = before
        contexts = np.concatenate([words, [BEGIN]])
        self.contexts = context_key(contexts)
        keys = self.contexts[before] | (chain([contexts[before], words[which]]) >> _TOP)
        self.pairs, self.pair = np.unique(keys, return_inverse=True)

    @classmethod
    def of(cls, ids: list[pa.Array], own: list[np.ndarray], sizes: list[np.ndarray]) -> "Chunk":
        words, which = np.unique(np.concatenate(own), return_inverse=True)
        return cls(pa.concat_arrays(ids), words, which, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))

    def packed(self) -> bytes:
        """All but what follows from the words: commoner words have lower numbers, which compress better."""
        ranks = np.argsort(-np.bincount(self.which, minlength=len(self.words)), kind="stable")
        number = np.empty(len(ranks), np.uint32)
        number[ranks] = np.arange(len(ranks), dtype=np.uint32)
        valid = np.asarray(self.ids.is_valid()).astype(np.uint8)
        head = np.array([len(self.first) - 1, len(self.words), len(self.which)], np.int64)
        body = [signed(self.words[ranks]), np.asarray(self.ids.fill_null(0)).astype(np.int64), np.diff(self.first).astype(np.int64)]
        return b"".join([head.tobytes(), *(x.tobytes() for x in body), valid.tobytes(), pa.compress(planes(number[self.which]), codec="zstd", asbytes=True)])

    @classmethod
    def unpacked(cls, data: bytes) -> "Chunk":
        texts, n, total = np.frombuffer(data, np.int64, 3)
        ranked, ids, sizes = (np.frombuffer(data, np.int64, k, 24 + 8 * at) for k, at in ((n, 0), (texts, n), (texts, n + texts)))
        at = 24 + 8 * (n + 2 * texts)
        valid = np.frombuffer(data, np.uint8, texts, at)
        number = unplaned(pa.decompress(data[at + texts :], decompressed_size=4 * total, codec="zstd", asbytes=True), np.uint32)
        order = np.argsort(ranked.view(U64))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        return cls(pa.array(ids, mask=valid == 0), ranked.view(U64)[order], place[number], np.concatenate([[0], np.cumsum(sizes)]))

    def asks(self, buckets: int, spread: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Kind, keys, their buckets in order, and where among the pairs, contexts or words they stand."""
        out = []
        for kind, keys, own in ((ASK_PAIRS, self.pairs, bigram_bucket(self.pairs, buckets, spread)), (ASK_CONTEXTS, self.contexts, bucket_of(self.contexts, buckets)), (ASK_WORDS, self.words, bucket_of(self.words, buckets))):
            order = np.lexsort((keys, own)) if kind == ASK_CONTEXTS else np.argsort(own, kind="stable")
            out.append((kind, keys[order], own[order], order))
        return out

    def scores(self, answers: dict[int, np.ndarray], total: int, distinct: int, texts: int) -> pa.RecordBatch:
        """answers: levels of pairs, (mass and count) levels of contexts, counts of words."""
        floor = math.log10(total + ADD * (distinct + 1))
        start = self.first[:-1]
        sums = lambda x: np.add.reduceat(x, start) if len(start) else x[:0]
        mass_level, count_level = answers[ASK_CONTEXTS]
        n = np.where(count_level > 0, value_of(count_level + 1, LEAST_MASS), 0.0)
        n[-1] = texts
        known = (n > 0) & (mass_level > 0)
        mass = np.where(known, value_of(mass_level + 1, LEAST_MASS), 0)
        rest = 1 - np.where(known, SHARE * np.minimum(mass, n) / np.maximum(n, 1), 0)
        level = answers[ASK_PAIRS][self.pair]
        n = np.where(known, n, 0)[self.before]
        c = answers[ASK_WORDS][self.which]
        seen = (level > 0) & (n > 0)
        pair = np.where(seen, SHARE * (value_of(level, LEAST) - DISCOUNT) / np.maximum(n, 1), 0)
        p = pair + rest[self.before] * (c + ADD) / 10**floor
        base = sums(np.log10(c + ADD)) - np.diff(self.first) * floor
        cols = [self.ids, pa.array(np.diff(self.first)), pa.array(sums((c > 0).astype(np.int64))), pa.array(base), pa.array(sums(np.log10(p)))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


def _chunks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[Chunk]:
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for part in pieces(batch):
            own, _, first = tokens(Texts.of(part.column("text")))
            held.append((part.column("doc_id"), own, np.diff(first)))
            size += len(own)
            if size >= least:
                yield Chunk.of(*map(list, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield Chunk.of(*map(list, zip(*held, strict=True)))


class Model:
    """Numbers of tokens, distinct tokens and texts; the spread contexts; and rows (bucket, kind, bits, data) of the buckets' shards and word counts."""

    def __init__(self, total: int, distinct: int, texts: int, buckets: int, spread: np.ndarray, rows: DataFrame, settings: Settings):
        self.total, self.distinct, self.texts, self.buckets, self.spread, self.rows, self.settings = total, distinct, texts, buckets, spread, rows, settings
        self.size = int(rows.agg(F.sum(F.length("data"))).first()[0] or 0)


class _Local:
    """A whole model in a worker."""

    def __init__(self, rows: list[dict], buckets: int, spread: np.ndarray):
        blooms = [LogBloom({r["bucket"]: (r["bits"], r["data"]) for r in rows if r["kind"] == kind}, buckets) for kind in (PAIRS, CONTEXTS)]
        words = [unpack_counts(r["data"]) for r in sorted(rows, key=lambda r: r["bucket"]) if r["kind"] == WORDS]
        self.pairs, self.contexts = blooms
        self.words, self.counts = (np.concatenate([w[k] for w in words]) if words else np.zeros(0, (U64, np.int64)[k]) for k in (0, 1))
        self.buckets, self.spread = buckets, spread

    def answers(self, chunk: Chunk) -> dict[int, np.ndarray]:
        own = bucket_of(chunk.contexts, self.buckets)
        return {
            ASK_PAIRS: self.pairs.levels(chunk.pairs, bigram_bucket(chunk.pairs, self.buckets, self.spread)),
            ASK_CONTEXTS: np.stack([self.contexts.levels(context_items(chunk.contexts, tag), own) for tag in (MASS_TAG, COUNT_TAG)]),
            ASK_WORDS: _counts_of(self.words, self.counts, chunk.words),
        }


def _counts_of(words: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
    return np.where(words[at] == asked, counts[at], 0)


def _score(shared, total: int, distinct: int, texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: _Local = shared.value
        for chunk in _chunks(batches, 0):
            yield chunk.scores(model.answers(chunk), total, distinct, texts)

    return run


_ROW = "bucket int, kind int, chunk long, bits long, data binary"


def _rows(buckets, kind: int, chunk: int, blobs: list[bytes]) -> pa.RecordBatch:
    n = len(blobs)
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "chunk", "bits", "data"]
    )


def _ask(buckets: int, spread: np.ndarray, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, chunk in enumerate(_chunks(batches, least)):
            number = task << 32 | k
            for kind, keys, own, _ in chunk.asks(buckets, spread):
                some, blobs = _dealt(own, buckets, lambda a, b, keys=keys: pack(keys[a:b]))
                yield _rows(some, kind, number, blobs)
            yield _rows([(task + k) % buckets], CHUNK_ROW, number, [chunk.packed()])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and kind: a bucket's shards and word counts, what is asked of them, and chunks that pass through."""
    bucket, nothing = None, LogBloom({}, 1)
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != bucket:
                bucket, blooms, words = r["bucket"], {PAIRS: nothing, CONTEXTS: nothing}, (np.zeros(0, U64), np.zeros(0, np.int64))
            kind, data = r["kind"], r["data"]
            if kind in blooms:
                blooms[kind] = LogBloom({0: (r["bits"], data)}, 1)
                continue
            if kind == WORDS:
                words = unpack_counts(data)
                continue
            if kind != CHUNK_ROW:
                keys = unpack(data, 0)[0]
                own = np.zeros(len(keys), np.int64)
                if kind == ASK_PAIRS:
                    data = blooms[PAIRS].levels(keys, own).astype(np.uint8).tobytes()
                elif kind == ASK_CONTEXTS:
                    data = b"".join(blooms[CONTEXTS].levels(context_items(keys, tag), own).astype(np.uint8).tobytes() for tag in (MASS_TAG, COUNT_TAG))
                else:
                    data = planes(_counts_of(*words, keys).astype(U64))
            yield _rows([bucket], kind, r["chunk"], [data])


def _finish(buckets: int, spread: np.ndarray, total: int, distinct: int, texts: int):
    """Rows come sorted by chunk, kind and bucket."""

    def finished(rows: list[dict]) -> pa.RecordBatch:
        chunk = Chunk.unpacked(rows[-1]["data"])
        answers = {}
        for kind, keys, _, order in chunk.asks(buckets, spread):
            own = [r["data"] for r in rows if r["kind"] == kind]
            if kind == ASK_WORDS:
                got = np.concatenate([unplaned(x, U64) for x in own])[None].astype(np.int64)
            else:
                halves = 1 if kind == ASK_PAIRS else 2
                got = np.concatenate([np.frombuffer(x, np.uint8).reshape(halves, -1) for x in own], axis=1).astype(np.int64)
            if got.shape[1] != len(keys):
                raise RuntimeError("a chunk's answers do not fit it: its input changed when a task was run again")
            placed = np.empty_like(got)
            placed[:, order] = got
            answers[kind] = placed if kind == ASK_CONTEXTS else placed[0]
        return chunk.scores(answers, total, distinct, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["chunk"] != r["chunk"]:
                    yield finished(held)
                    held = []
                held.append(r)
        if held:
            yield finished(held)

    return run


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 10 == 0


def fit(train: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of the texts (column text)."""
    train = train.select("text")
    buckets = max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), train.rdd.getNumPartitions())
    dealt = lambda rows: rows.repartitionById(buckets, F.col("bucket"))
    words = cut(dealt(train.mapInArrow(_counted(buckets, None, settings.chunk), "bucket int, data binary")).mapInArrow(_word_tables, "bucket int, n long, v long, data binary"))
    whole = words.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total = int(whole.n or 0)
    frequent = words.mapInArrow(_frequent(max(1, total / (settings.spread * buckets))), "h long, c long").collect()
    texts = sum(r.c for r in frequent if U64(r.h % 2**64) == END)
    spread = np.unique(context_key(np.array([int(BEGIN), *(r.h % 2**64 for r in frequent)], U64)))
    found = cut(dealt(train.mapInArrow(_counted(buckets, spread, settings.chunk), "bucket int, data binary")).mapInArrow(_filter_rows(spread, settings.bits), "bucket int, bits long, data binary, contexts binary, spread array<struct<context long, n long, kinds long>>"))
    wide = found.select(F.explode("spread").alias("x")).groupBy("x.context").agg(F.sum("x.n").alias("n"), F.sum("x.kinds").alias("kinds"))
    contexts = found.select("bucket", F.col("contexts").alias("data")).unionAll(wide.mapInArrow(_context_blobs(buckets), "bucket int, data binary"))
    contexts = cut(dealt(contexts).mapInArrow(_context_shards(settings.bits), "bucket int, bits long, data binary"))
    rows = None
    for kind, part in ((PAIRS, found), (CONTEXTS, contexts), (WORDS, words.withColumn("bits", F.lit(0).cast("long")))):
        part = part.select("bucket", F.lit(kind).alias("kind"), "bits", "data")
        rows = part if rows is None else rows.unionAll(part)
    return Model(total, int(whole.v or 0), texts, buckets, spread, rows, settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    numbers, result = (model.total, model.distinct, model.texts), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    if model.size <= model.settings.broadcast:
        local = _Local(model.rows.toArrow().to_pylist(), model.buckets, model.spread)
        out = docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(local), *numbers), result)
    else:
        stored = model.rows.select("bucket", "kind", F.lit(None).cast("long").alias("chunk"), "bits", "data")
        asked = stored.unionAll(docs.mapInArrow(_ask(model.buckets, model.spread, model.settings.chunk), _ROW))
        answered = asked.repartitionById(model.buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(_answer, _ROW)
        place = F.pmod(F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(0xFFFFFFFF), F.lit(model.buckets)).cast("int")
        out = answered.repartitionById(model.buckets, place).sortWithinPartitions("chunk", "kind", "bucket").mapInArrow(_finish(model.buckets, model.spread, *numbers), result)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
