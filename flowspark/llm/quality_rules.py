"""Quality rules (operator 6): rules on one document, and line frequency across the documents of a host.

Two passes over the texts. The first hashes every document's distinct normalised lines (ASCII lower case,
words joined by one space); Spark counts the distinct documents of each (host, line), first within tasks and
then by all three keys, so that neither a hot host nor a very common line meets in one task. Documents with
equal texts are one document here, else a large group of exact copies would condemn its own text. Lines in
more documents than the limit (``min_docs``, or ``share`` of the host's documents if that is more) are
removed in the second pass; a document that loses more than ``max_removed`` of its words is depleted.

The lines above the limit are broadcast only if they are at most ``broadcast_rows``; beyond that they are
joined to the documents' lines by a shuffle, with the same result.

Defined results: null text has no words and fails; a null host is a host of its own; repeated rows get the
same verdict each and count as one document; an empty table gives an empty result; other columns pass
through, except those named like the operator's own (OWN), which are dropped; a very long text is judged whole, in memory
bounded by that one text; a line that is exactly at the limit stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64, Texts, chain, cut, join_counted, mix, pieces, signed, without

SYMBOLS = b"#*$%&|<>"
#: Columns the operator makes; columns of these names in the input are dropped first.
OWN = ("q_words", "q_word_chars", "q_symbols", "q_dup_lines", "q_repeat_words", "q_removed_words", "q_base_failed", "q_kept", "__host", "__doc", "lost", "lines")
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    min_docs: int = 10
    share: float = 0.01
    max_removed_percent: int = 50
    broadcast_rows: int = 2_000_000


@dataclass
class Lines:
    """Lines with a word, in order: offsets in the bytes, owner (row), words, exact and normalised hashes."""

    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    n_words: np.ndarray
    exact: np.ndarray
    normal: np.ndarray


def lines_of(texts: Texts) -> Lines:
    starts, ends, first = texts.runs(texts.buf != 10)
    words = texts.words(fold=True)
    at = np.searchsorted(words.starts, starts)
    to = np.searchsorted(words.starts, ends)
    keep = to > at
    starts, ends, at, to = starts[keep], ends[keep], at[keep], to[keep]
    owner = np.searchsorted(texts.offsets, starts, side="right") - 1
    return Lines(starts, ends, owner, to - at, common.range_hash(common._EXACT[texts.buf], starts, ends), common.range_hash(words.hashes, at, to))


def host_keys(column: pa.Array) -> np.ndarray:
    """A hash of each host; null and empty differ."""
    null = np.asarray(column.is_null())
    out = Texts.of(column).hashes()
    return np.where(null, U64(1), out)


def distinct(*keys: np.ndarray) -> np.ndarray:
    """Positions of the first of each distinct combination."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.sort(np.unique(chain([k.view(U64) if k.dtype.itemsize == 8 else k.astype(U64) for k in keys]), return_index=True)[1])


def _repeat_words(words: common.Words) -> np.ndarray:
    at, h = words.windows(3)
    marked = np.zeros(len(words.hashes), dtype=bool)
    if len(at):
        owner = words.owner()[at]
        h = mix(h + owner.astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(h)
        s = h[order]
        same = np.zeros(len(s) + 1, dtype=bool)
        same[1:-1] = s[1:] == s[:-1]
        twice = at[order[same[:-1] | same[1:]]]
        for k in range(3):
            marked[twice + k] = True
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[words.first[1:]] - total[words.first[:-1]]


def _line_rows(text: str, host: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                texts = Texts.of(part.column(text))
                lines = lines_of(texts)
                hosts, docs = host_keys(part.column(host)), texts.hashes()
                one = distinct(hosts, docs)
                rows = [(hosts[one], np.zeros(len(one), U64), docs[one])]
                at = distinct(hosts[lines.owner], docs[lines.owner], lines.normal)
                rows.append((hosts[lines.owner[at]], lines.normal[at], docs[lines.owner[at]]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(x))) for x in zip(*rows, strict=True)], names=["host", "line", "doc"])

    return run


def frequent_lines(docs: DataFrame, limits: Limits = Limits(), text: str = "text", host: str = "source") -> DataFrame:
    """(host, line, n): hashes of the lines above the limit, and in how many documents they are. Line 0 stands for the host's documents themselves."""
    rows = docs.select(F.col(text).alias("text"), F.col(host).cast("string").alias("host")).mapInArrow(_line_rows("text", "host"), "host long, line long, doc long")
    counts = rows.distinct().groupBy("host", "line").agg(F.count("*").alias("docs")).where((F.col("docs") > limits.min_docs) | (F.col("line") == 0))
    total = counts.where("line = 0").select("host", F.col("docs").alias("of"))
    return counts.where("line <> 0").join(total, "host").where(F.col("docs") > F.greatest(F.lit(limits.min_docs), F.col("of") * F.lit(limits.share))).select("host", "line", F.col("docs").alias("n"))


_STATS = "q_words long, q_word_chars long, q_symbols long, q_dup_lines long, q_repeat_words long, q_removed_words long"


_FIGURES = [x.split()[0] for x in _STATS.split(", ")]


def _figures(texts: Texts, lines, hit: np.ndarray) -> list[np.ndarray]:
    """The figures of each text, in the order of _STATS; hit: whether a line is above the limit."""
    words = texts.words()
    inside = ~common.IS_SPACE[texts.buf]
    n_lines = np.bincount(lines.owner, minlength=len(texts))
    fresh = np.bincount(lines.owner[distinct(lines.owner, lines.exact)], minlength=len(texts))
    lost = np.bincount(lines.owner, weights=lines.n_words * hit, minlength=len(texts))
    out = [words.counts(), texts.sums(inside & ((texts.buf & 0xC0) != 0x80)), texts.sums(_SYMBOL[texts.buf]), n_lines - fresh, _repeat_words(words), lost]
    return [np.asarray(x).astype(np.int64) for x in out]


def _stats(text: str, host: str, names: list[str], removed):
    """removed(hosts, lines) -> bool for each line; _none if that is decided later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = removed()
        for batch in batches:
            for part in pieces(batch, text):
                texts = Texts.of(part.column(text))
                lines = lines_of(texts)
                figures = _figures(texts, lines, gone(host_keys(part.column(host))[lines.owner], lines.normal))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(x) for x in figures], names=[*names, *_FIGURES])

    return run


def _cleaned(text: str, host: str, names: list[str], removed, limits: Limits):
    """The rows that pass, with their texts less the removed lines; nothing else of a text changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = removed()
        for batch in batches:
            for part in pieces(batch, text):
                texts = Texts.of(part.column(text))
                lines = lines_of(texts)
                hit = gone(host_keys(part.column(host))[lines.owner], lines.normal)
                figures = dict(zip(_FIGURES, _figures(texts, lines, hit), strict=True))
                yield _stripped(part, text, names, texts, lines, hit).filter(pa.array(_passes(limits, figures)))

    return run


def _strip_listed(text: str, names: list[str]):
    """The same for rows that carry their lines to remove (column lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                texts, listed = Texts.of(part.column(text)), part.column("lines")
                lines = lines_of(texts)
                sizes = np.asarray(pc.fill_null(pc.list_value_length(listed), 0)).astype(np.int64)
                wanted = chain([np.repeat(np.arange(len(sizes)), sizes).astype(U64), np.asarray(listed.flatten()).astype(np.int64).view(U64)])
                yield _stripped(part, text, names, texts, lines, np.isin(chain([lines.owner.astype(U64), lines.normal]), wanted))

    return run


def _stripped(part: pa.RecordBatch, text: str, names: list[str], texts: Texts, lines, hit: np.ndarray) -> pa.RecordBatch:
    keep = np.ones(len(texts.buf), dtype=bool)
    stop = texts.offsets[lines.owner + 1]
    for i in np.flatnonzero(hit):
        keep[lines.starts[i] : min(lines.ends[i] + 1, stop[i])] = False  # with its line feed
    data = texts.buf[keep]
    offs = np.concatenate([[0], np.cumsum(keep)])[texts.offsets]
    new = pa.Array.from_buffers(pa.large_utf8(), len(texts), [None, pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())
    new = pc.if_else(part.column(text).is_null(), pa.scalar(None, pa.string()), new)
    return pa.RecordBatch.from_arrays([new if c == text else part.column(c) for c in names], names=names)


class _Lookup:
    """Membership in a broadcast list of (host, line) pairs."""

    def __init__(self, keys):
        self.keys = keys

    def __call__(self):
        keys = self.keys.value
        def hit(hosts: np.ndarray, lines: np.ndarray) -> np.ndarray:
            if not len(keys) or not len(lines):
                return np.zeros(len(lines), dtype=bool)
            x = chain([hosts, lines])
            return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x
        return hit


def _none():
    return lambda hosts, lines: np.zeros(len(lines), dtype=bool)


def _pair_rows(text: str, host: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                texts = Texts.of(part.column(text))
                lines = lines_of(texts)
                hosts, docs = host_keys(part.column(host)), texts.hashes()
                at = distinct(lines.owner, lines.normal)
                key = chain([lines.owner.astype(U64), lines.normal])
                where = np.searchsorted(np.sort(key[at]), key)
                total = np.bincount(where, weights=lines.n_words, minlength=len(at)).astype(np.int64)
                at = at[np.argsort(key[at])]
                own = lines.owner[at]
                yield pa.RecordBatch.from_arrays([pa.array(signed(hosts[own])), pa.array(signed(docs[own])), pa.array(signed(lines.normal[at])), pa.array(total)], names=["host", "doc", "line", "n"])

    return run


def _small(frequent: DataFrame, limits: Limits) -> np.ndarray | None:
    """The lines above the limit as keys, if they are few enough to broadcast."""
    rows = frequent.limit(limits.broadcast_rows + 1).toArrow()
    if rows.num_rows > limits.broadcast_rows:
        return None
    return np.sort(chain([np.asarray(rows.column(c)).astype(np.int64).view(U64) for c in ("host", "line")]))


def _joined_losses(docs: DataFrame, frequent: DataFrame, text: str, host: str) -> DataFrame:
    """(host, doc) hashes with the words in removed lines and the lines' hashes, by a shuffled join."""
    pairs = docs.select(F.col(text).alias("text"), F.col(host).cast("string").alias("host")).mapInArrow(_pair_rows("text", "host"), "host long, doc long, line long, n long")
    total = frequent.agg(F.sum("n")).first()[0] or 0
    return join_counted(pairs.distinct(), frequent, ["host", "line"], total).groupBy("host", "doc").agg(F.sum("n").alias("lost"), F.collect_set("line").alias("lines"))


def _keys(text: str, host: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                keys = [pa.array(signed(host_keys(part.column(host)))), pa.array(signed(Texts.of(part.column(text)).hashes()))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + keys, names=[*names, "__host", "__doc"])

    return run


def judge(docs: DataFrame, limits: Limits = Limits(), text: str = "text", host: str = "source", keep_text: bool = True) -> DataFrame:
    """docs (without text if keep_text is false) with q_ figures, q_base_failed and q_kept."""
    docs = without(docs, OWN)
    frequent = cut(frequent_lines(docs, limits, text, host))
    names = list(docs.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    small = _small(frequent, limits)
    if small is not None:
        out = docs.mapInArrow(_stats(text, host, names, _Lookup(docs.sparkSession.sparkContext.broadcast(small))), f"{fields}, {_STATS}")
    else:
        out = docs.mapInArrow(_stats(text, host, names, _none), f"{fields}, {_STATS}")
        out = out.mapInArrow(_keys(text, host, out.columns), f"{fields}, {_STATS}, __host long, __doc long")
        lost = _joined_losses(docs, frequent, text, host)
        out = out.join(lost.drop("lines").withColumnsRenamed({"host": "__host", "doc": "__doc"}), ["__host", "__doc"], "left").withColumn("q_removed_words", F.coalesce("lost", F.lit(0)).cast("long")).drop("__host", "__doc", "lost")
    failed = (F.col("q_words") < limits.min_words) | (100 * F.col("q_repeat_words") > limits.max_repeat_percent * F.col("q_words"))
    out = out.withColumn("q_base_failed", failed).withColumn("q_kept", ~failed & (100 * F.col("q_removed_words") <= limits.max_removed_percent * F.col("q_words")))
    return out if keep_text else out.drop(text)


def clean(docs: DataFrame, limits: Limits = Limits(), text: str = "text", host: str = "source") -> DataFrame:
    """The kept rows of docs with their own columns; lines above the limit are gone from the texts."""
    docs = without(docs, OWN)
    frequent = cut(frequent_lines(docs, limits, text, host))
    small = _small(frequent, limits)
    names, fields = list(docs.columns), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    if small is not None:
        removed = _Lookup(docs.sparkSession.sparkContext.broadcast(small))
        return docs.mapInArrow(_cleaned(text, host, names, removed, limits), fields)
    lost = _joined_losses(docs, frequent, text, host).withColumnsRenamed({"host": "__host", "doc": "__doc"})
    out = docs.mapInArrow(_stats(text, host, names, _none), f"{fields}, {_STATS}")
    out = out.mapInArrow(_keys(text, host, out.columns), f"{fields}, {_STATS}, __host long, __doc long").join(lost, ["__host", "__doc"], "left")
    out = out.withColumn("q_removed_words", F.coalesce("lost", F.lit(0)).cast("long")).where(_passes(limits, {n: F.col(n) for n in _FIGURES})).select(*names, "lines")
    return out.mapInArrow(_strip_listed(text, names), fields)


def _passes(limits: Limits, x):
    """Of figures by name: columns, or arrays."""
    return (x["q_words"] >= limits.min_words) & (100 * x["q_repeat_words"] <= limits.max_repeat_percent * x["q_words"]) & (100 * x["q_removed_words"] <= limits.max_removed_percent * x["q_words"])
