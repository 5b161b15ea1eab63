"""Token counts (operator 5) for a byte-level BPE vocabulary, with a whole-token shortcut.

Offline, before any text is read, every string of the vocabulary is encoded by the merges alone; those that
end as one token are *whole*. A pre-token that is whole counts 1 without a merge, and merges run only for
the others, once for each distinct one that a worker still remembers. The vocabulary file is read by the
driver and sent to the workers, so its size bounds what is broadcast.

Special strings inside a text are found first and count as one token each, as the library does by default.

Defined results: null text is empty, with 0 bytes and 0 tokens; texts are never cut; repeated rows are counted
each; an empty table gives an empty result; other columns pass through, except n_bytes, n_tokens and
over_limit, which are replaced.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import pieces, without

#: Fixed value: the pre-token pattern of this kind of vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next free code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges over numbered parts (a byte is its value, the result of merge i is 256 + i), the whole tokens, the special strings."""

    def __init__(self, merges: dict[int, int], strings: list[bytes], special: list[str]):
        self.merges, self.special = merges, special
        self.whole = frozenset(s for s in strings if self.merge(s) == 1)

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        special = [a["content"] for a in spec.get("added_tokens", []) if a.get("special")]
        number = {bytes([b]): b for b in range(256)}
        merges = {}
        for i, m in enumerate(spec["model"]["merges"]):
            left, right = map(raw, m.split(" ") if isinstance(m, str) else m)
            merges[number[left] << 20 | number[right]] = i
            number.setdefault(left + right, 256 + i)
        return cls(merges, [raw(s) for s in spec["model"]["vocab"] if s not in special], special)

    def merge(self, word: bytes) -> int:
        """The number of tokens that the merges leave of one pre-token."""
        if len(word) > 400:
            return _merge_long(word, self.merges)
        find, parts = self.merges.get, [*word]
        ranks = [find(a << 20 | b, _NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            at = ranks.index(best)
            new = parts[at] = 256 + best
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = find(parts[at - 1] << 20 | new, _NEVER)
            if at < len(ranks):
                ranks[at] = find(new << 20 | parts[at + 1], _NEVER)
        return len(parts)


_NEVER = 1 << 30


def _merge_long(word: bytes, merges: dict[int, int]) -> int:
    """The same with a heap over a linked list, for pre-tokens of any length in n log n steps."""
    n, part = len(word), [*word]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = lambda i, j: merges.get(part[i] << 20 | part[j]) if i >= 0 and j < n else None
    heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        r, i, j = heapq.heappop(heap)
        if part[i] is None or after[i] != j or part[j] is None or rank(i, j) != r:
            continue
        part[i], part[j] = 256 + r, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        left -= 1
        for x, y in ((before[i], i), (i, after[i])):
            if (q := rank(x, y)) is not None:
                heapq.heappush(heap, (q, x, y))
    return left


class _Counts(dict):
    """Tokens of a pre-token; whole ones stay, others are forgotten together when there are too many."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.more = vocabulary, 0
        self.reset()

    def reset(self) -> None:
        self.clear()
        for s in self.vocabulary.whole:
            try:
                self[s.decode()] = 1
            except UnicodeDecodeError:
                pass
        self.more = 0

    def __missing__(self, word: str) -> int:
        n = self.vocabulary.merge(word.encode())
        if len(word) <= 64:
            self.more += 1
            self[word] = n
        return n


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.counts = _Counts(vocabulary)
        self.find = regex.compile(PATTERN).findall
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, special))).split if special else None
        self.special = special

    def __call__(self, text: str) -> int:
        if self.special and any(s in text for s in self.special):
            texts = self.split(text)
        else:
            texts = (text,)
        get = self.counts.__getitem__
        n = len(texts) - 1 + sum(sum(map(get, self.find(t))) for t in texts)
        if self.counts.more > REMEMBERED:
            self.counts.reset()
        return n


@functools.lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary.load(path)


_counter: tuple[int, Counter] | None = None


def _of(shared) -> Counter:
    """One counter in each worker process, kept from task to task."""
    global _counter
    if _counter is None or _counter[0] != id(shared.value):
        _counter = (id(shared.value), Counter(shared.value))
    return _counter[1]


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512, keep_text: bool = True) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    docs = without(docs, ("n_bytes", "n_tokens", "over_limit"))
    kept = [c for c in docs.columns if keep_text or c != text]
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _of(shared)
        for batch in batches:
            for part in pieces(batch, text):
                texts = part.column(text).fill_null("")
                n = np.fromiter((count(t) for t in texts.to_pylist()), dtype=np.int64, count=len(texts))
                size = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), size, pa.array(n), pa.array(n > limit)], names=[*kept, "n_bytes", "n_tokens", "over_limit"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept)
    return docs.mapInArrow(run, f"{fields}, n_bytes long, n_tokens long, over_limit boolean")
