"""Quality classifier (operator 9): perplexity under an interpolated modified Kneser-Ney model of trusted text.

Trigram counts of the trusted texts are summed by key over shards (partial sums first); continuation counts and the
counts of each context come from those by further grouping, and joins of the count tables give every n-gram's
discounted share and every context's weight for the lower order. Discounts are estimated for each language and order.

Trusted documents are split by a hash of their keys at every size: one in HELD_OUT (and of each language with two or more
the one that hashes highest) is held out, and only sets the threshold. The training sample is bounded: of the others the
``max_train_docs`` whose keys hash lowest, and of each language at least its lowest max_train_docs / 8 (or all it has), so
every language with trusted text has a model, whatever the others hold. Scoring joins documents' n-grams to it: by
broadcast if the model has at most ``broadcast_rows`` rows, else by a shuffle of the n-grams; both give the same
figures. A language's threshold is a quantile of the perplexities of its held-out documents (of all its documents, if it has
none), from exact counts by steps of 0.001 in log10.

Defined results: null text is empty and has its end token alone; a null language is a language of its own; a language
without training text has null perplexity and its documents are kept; a document trusted twice trains once in its language,
and of a key's different texts in one language the least trains; repeated rows are scored each; an empty table gives an
empty result; columns named like the operator's own (OWN) are replaced; a very long text is scored whole, in memory
bounded by that one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Texts, chain, cut, pieces, release, signed, small, without
from .lm_scoring import BEGIN, tokens

OWN = ("n_tokens", "log10_prob", "perplexity", "threshold", "kept", "__lang", "__row", "__step", "__trusted", "__sampled")
ALPHA3, GAMMA3, ALPHA2, GAMMA2, UNIGRAM, UNKNOWN = (U64(k) for k in range(1, 7))
#: One trusted document in so many sets thresholds.
HELD_OUT = 5


@dataclass(frozen=True)
class Settings:
    max_train_docs: int = 2000
    quantile: float = 0.99
    broadcast_rows: int = 8_000_000


def languages(column: pa.Array) -> np.ndarray:
    return np.where(np.asarray(column.is_null()), U64(9), Texts.of(column).hashes())


def key(kind: np.uint64, lang: np.ndarray, *words: np.ndarray) -> np.ndarray:
    return chain([np.full(len(lang), kind, U64), lang, *words])


def trigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token it and the two before (BEGIN before the first), and the offset of each text's first token."""
    w, v, first = tokens(texts)
    u = np.empty_like(v)
    u[1:] = v[:-1]
    u[first[:-1]] = BEGIN
    return u, v, w, first


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            u, v, w, first = trigrams(Texts.of(part.column("text")))
            lang = np.repeat(languages(part.column("lang")), np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(signed(x)) for x in (lang, u, v, w)], names=["lang", "u", "v", "w"])


def _discounts(counts: DataFrame, name: str) -> DataFrame:
    """lang with discounts for counts 1, 2 and 3 or more, from the counts of counts 1 to 4; kept off 0 and the count itself."""
    n = [F.count_if(F.col("c") == k).cast("double") for k in (1, 2, 3, 4)]
    y = n[0] / F.greatest(n[0] + 2 * n[1], F.lit(1.0))
    out = [F.when((n[k] > 0) & (n[k + 1] > 0), F.greatest(F.lit(0.1), F.least((k + 1) - (k + 2) * y * n[k + 1] / n[k], F.lit(k + 0.9)))).otherwise(F.lit(0.5 * (k + 1))) for k in range(3)]
    return counts.groupBy("lang").agg(*[x.alias(f"{name}{k + 1}") for k, x in enumerate(out)])


def _level(grams: DataFrame, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """grams (lang, words, c): each one's discounted share of its context, and each context's weight for the lower order."""
    by = ["lang", *context]
    d = small(_discounts(grams, "d"))
    sums = grams.groupBy(*by).agg(F.sum("c").alias("total"), *[F.count_if(x).alias(f"n{k}") for k, x in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") > 2))])
    off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    # a language alone is a hot key with one sum: it is attached, not gathered
    whole = grams.withColumn("total", F.sum("c").over(Window.partitionBy(*by))) if context else grams.join(small(sums.select("lang", "total")), "lang")
    shares = whole.join(d, "lang").withColumn("x", (F.col("c") - off) / F.col("total"))
    weights = sums.join(d, "lang").withColumn("x", (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total"))
    return shares, weights


def _keyed(kind: np.uint64, words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [np.asarray(batch.column(c)).view(U64) for c in ("lang", *words)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(key(kind, *cols))), batch.column("x")], names=["key", "x"])

    return run


def fit(train: DataFrame) -> DataFrame:
    """(key, x): the model of texts (columns lang, text)."""
    g3 = cut(train.select("lang", "text").mapInArrow(_train_rows, "lang long, u long, v long, w long").groupBy("lang", "u", "v", "w").agg(F.count("*").alias("c")))
    g2 = cut(g3.groupBy("lang", "v", "w").agg(F.count("*").alias("c")))
    g1 = cut(g2.groupBy("lang", "w").agg(F.count("*").alias("c")))
    a3, w3 = _level(g3, ["u", "v"])
    a2, w2 = _level(g2, ["v"])
    a1, w1 = _level(g1, [])
    words = g1.groupBy("lang").agg(F.count("*").alias("types"))
    unknown = small(w1.join(words, "lang").select("lang", (F.col("x") / (F.col("types") + 1)).alias("x")))
    one = a1.join(unknown.withColumnRenamed("x", "rest"), "lang").select("lang", "w", (F.col("x") + F.col("rest")).alias("x"))
    parts = [(ALPHA3, a3, ["u", "v", "w"]), (GAMMA3, w3, ["u", "v"]), (ALPHA2, a2, ["v", "w"]), (GAMMA2, w2, ["v"]), (UNIGRAM, one, ["w"]), (UNKNOWN, unknown, [])]
    out = None
    for kind, rows, names in parts:
        part = rows.select("lang", *names, "x").mapInArrow(_keyed(kind, names), "key long, x double")
        out = part if out is None else out.unionAll(part)
    model = cut(out)
    release(g3, g2, g1)
    return model


def _asked(texts: Texts, lang: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    u, v, w, first = trigrams(texts)
    own = np.repeat(lang, np.diff(first))
    return [key(ALPHA3, own, u, v, w), key(GAMMA3, own, u, v), key(ALPHA2, own, v, w), key(GAMMA2, own, v), key(UNIGRAM, own, w), key(UNKNOWN, own)], first


def _probability(x: list[np.ndarray]) -> np.ndarray:
    """From what the model has for the six keys, NaN where it has nothing."""
    a3, g3, a2, g2, one, unknown = x
    p = np.where(np.isnan(one), unknown, one)
    p = np.where(np.isnan(g2), p, np.nan_to_num(a2) + g2 * p)
    return np.where(np.isnan(g3), p, np.nan_to_num(a3) + g3 * p)


class _Rows:
    """The model's rows sorted by key, with the place of each run of keys of equal upper bits, about one row long."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = U64(64 - max(1, len(keys).bit_length()))
        self.starts = np.searchsorted(keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=U64)).astype(np.int32)

    def get(self, asked: np.ndarray) -> np.ndarray:
        """The values of keys, NaN where there are none."""
        out = np.full(len(asked), np.nan)
        run = (asked >> self.shift).astype(np.int64)
        at, end = self.starts[run], self.starts[run + 1]
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], asked[left]
        while len(left):
            same = self.keys[at] == wanted
            out[left[same]] = self.values[at[same]]
            go = ~same & (at + 1 < end)
            left, at, end, wanted = left[go], at[go] + 1, end[go], wanted[go]
        return out


def _score(names: list[str], text: str, lang: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(*shared.value)
        for batch in batches:
            for part in pieces(batch, text):
                asked, first = _asked(Texts.of(part.column(text)), languages(part.column(lang)))
                if len(rows.keys):
                    logs = np.add.reduceat(np.log10(_probability([rows.get(k) for k in asked])), first[:-1]) if len(first) > 1 else np.zeros(0)
                else:
                    logs = np.full(len(first) - 1, np.nan)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(np.diff(first)), pa.array(logs, mask=np.isnan(logs))], names=[*names, "n_tokens", "log10_prob"])

    return run


def _ask_rows(text: str, lang: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                asked, first = _asked(Texts.of(part.column(text)), languages(part.column(lang)))
                row = np.repeat(np.asarray(part.column("__row")), np.diff(first))
                place = np.arange(len(row)) - np.repeat(first[:-1], np.diff(first))
                for k, keys in enumerate(asked):
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(place), pa.array(np.full(len(row), k, np.int32)), pa.array(signed(keys))], names=["row", "place", "kind", "key"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows sorted by key, as the bytes of their keys and of their values."""
    rows = [(np.asarray(b.column("key")).view(U64), np.asarray(b.column("x"))) for b in batches if b.num_rows]
    if rows:
        keys, x = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.argsort(keys)
        yield pa.RecordBatch.from_arrays([pa.array([c[order].tobytes()], pa.binary()) for c in (keys, x)], names=["keys", "x"])


def _gathered(model: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The model's keys, in unsigned order, and values. They come range by range, so the driver holds them once."""
    keys, values, at = np.empty(count, U64), np.empty(count), 0
    ranges = model.repartitionByRange(F.col("key").bitwiseXOR(F.lit(-(1 << 63)))).mapInArrow(_packed, "keys binary, x binary")
    for row in ranges.toLocalIterator():
        part = np.frombuffer(row.keys, U64)
        keys[at : at + len(part)], values[at : at + len(part)] = part, np.frombuffer(row.x)
        at += len(part)
    return keys, values


def perplexities(docs: DataFrame, model: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with n_tokens and log10_prob (null without a model of the language)."""
    docs = without(docs, OWN)
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    count = model.count() if settings.broadcast_rows else 0
    if settings.broadcast_rows and count <= settings.broadcast_rows:
        shared = docs.sparkSession.sparkContext.broadcast(_gathered(model, count))
        out = docs.mapInArrow(_score(names, text, lang, shared), f"{fields}, n_tokens long, log10_prob double")
        out._shared = shared
        return out
    numbered = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    asked = numbered.mapInArrow(_ask_rows(text, lang), "row long, place long, kind int, key long")
    got = asked.join(model, "key", "left").groupBy("row", "place").agg(*[F.max(F.when(F.col("kind") == k, F.col("x"))).alias(f"x{k}") for k in range(6)])
    p = F.coalesce("x4", "x5")
    p = F.when(F.col("x3").isNull(), p).otherwise(F.coalesce("x2", F.lit(0.0)) + F.col("x3") * p)
    p = F.when(F.col("x1").isNull(), p).otherwise(F.coalesce("x0", F.lit(0.0)) + F.col("x1") * p)
    sums = got.groupBy("row").agg(F.count("*").alias("n_tokens"), F.sum(F.log10(p)).alias("log10_prob"))
    return numbered.join(sums, F.col("__row") == F.col("row")).drop("row", "__row")


def classify(docs: DataFrame, trusted: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang", key: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, log10_prob, perplexity, threshold and kept. trusted: a table of keys of trusted documents."""
    docs = without(docs, OWN)
    good = trusted.select(F.col(key).alias("__key")).distinct()
    pairs = docs.select(F.col(key).alias("__key"), F.col(lang).alias("lang")).join(good, "__key", "left_semi").distinct()
    pairs = cut(pairs.withColumn("__h", F.xxhash64("__key")))
    top = small(pairs.groupBy(F.col("lang").alias("__of")).agg(F.max("__h").alias("__top"), F.count("*").alias("__size")))
    held = F.pmod(F.xxhash64("__key", F.lit(HELD_OUT)), F.lit(HELD_OUT)) == 0
    pairs = pairs.join(top, F.col("lang").eqNullSafe(F.col("__of"))).withColumn("__held", held | ((F.col("__size") > 1) & (F.col("__h") == F.col("__top"))))
    open_ = pairs.where("NOT __held")
    lowest = open_.select("__h", "__key").distinct().orderBy("__h", "__key").limit(settings.max_train_docs).select("__key")
    least = max(1, settings.max_train_docs // 8)
    # of a language's keys only the lowest hashes, about twice as many as are taken, are ranked in its one task
    near = (F.col("__h") / F.lit(2.0**64) + 0.5) * F.col("__size") * (1 - 1 / HELD_OUT) <= 2 * least + 100
    ranked = open_.where(near).withColumn("__n", F.row_number().over(Window.partitionBy("lang").orderBy("__h", "__key"))).where(F.col("__n") <= least)
    chosen = open_.join(F.broadcast(lowest), "__key", "left_semi").select("lang", "__key").unionAll(ranked.select("lang", "__key")).distinct()
    picked = small(cut(chosen.select(F.col("lang").alias("__of"), F.col("__key").alias("__id"))))
    sample = docs.join(picked, (docs[key] == F.col("__id")) & docs[lang].eqNullSafe(F.col("__of"))).groupBy(F.col("__of").alias("lang"), "__id").agg(F.min(text).alias("text"))
    model = fit(sample)
    read = perplexities(docs, model, settings, text, lang)
    scored = cut(read if keep_text else read.drop(text))
    if hasattr(read, "_shared"):
        read._shared.destroy()
    release(model)
    step = F.floor(-F.col("log10_prob") / F.col("n_tokens") * 1000)
    marks = scored.select(F.col(key).alias("__key"), F.col(lang).alias("__lang"), step.alias("__step")).where("__step IS NOT NULL")
    outside = pairs.where("__held").select("__key").distinct().withColumn("__trusted", F.lit(True))
    marks = marks.join(outside, "__key", "left").groupBy("__lang", "__step").agg(F.count("*").alias("every"), F.count("__trusted").alias("own"))
    whole = Window.partitionBy("__lang")
    marks = marks.withColumn("n", F.when(F.sum("own").over(whole) > 0, F.col("own")).otherwise(F.col("every")))
    marks = marks.withColumn("upto", F.sum("n").over(whole.orderBy("__step"))).withColumn("of", F.sum("n").over(whole))
    limits = marks.where(F.col("upto") >= settings.quantile * F.col("of")).groupBy("__lang").agg(F.min("__step").alias("limit"))
    out = scored.withColumn("__step", step).join(small(limits), scored[lang].eqNullSafe(F.col("__lang")), "left")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens"))).withColumn("threshold", F.pow(F.lit(10.0), (F.col("limit") + 1) / 1000)).withColumn("kept", F.coalesce(F.col("__step") <= F.col("limit"), F.lit(True))).drop("__step", "__lang", "limit")
