"""MinHash near-dedup (operator 1) by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Texts with equal shingle sets are one class, so copies never meet in pairs. All below is on classes.
2. A class is posted under each of POSTED (coordinate, value) pairs of its signature. Two classes above the
   similarity agree in at least MATCHES of these, but for a chance under MISS. Pairs (of coordinate and value)
   that one class alone has are dropped; a class with fewer than MATCHES left has no partner (skipped).
3. Prefix: with a class's values ordered by how many classes have them, two classes that agree in MATCHES of POSTED
   share one of the first POSTED - MATCHES + 1. Only these are joined, so common values (of a passage that many
   documents share) are hardly ever posted.
4. Stars: every class in a list of postings meets the list's least class; the matches are confirmed on the full sets, and
   linked classes are contracted to components. In a group of near copies this joins most at a cost in proportion to it.
5. Lists that still hold several components tie these to families. In a family only pairs of different components are
   left, and one link between two components settles all of theirs. In a family of more than BLOCK classes, shingles are
   counted first: a class skips what follows if fewer than the similarity's share of its shingles occur in other
   components (pages of one template that are not alike end here, in rows in proportion to their shingles). The
   others are tested in blocks of BLOCK by BLOCK classes, of which the family's main component meets only the others; so
   a family of any size is spread over tasks, each block counts the collisions of its pairs, confirms those above the
   threshold on the full sets, and gives only the links that join two components.

No list, partner or candidate is capped: left out are only pairs that are linked already, or that agree in too few
coordinates.

Defined results: null and empty texts, or texts without words, have no shingles and link with nothing; fewer than
SHINGLE words are one shingle; rows without a doc_id link with nothing (component null, kept false); repeated rows
are alike; an empty table gives an empty result; a very long text has all its shingles, and memory is bounded by BLOCK such
sets. link() gives its own columns alone; dedupe() gives the columns of its input, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Cuts, Texts, chain, cut, join_counted, mix, pieces, release, signed, small
from .components import components

SHINGLE = 5
POSTED, COORDINATES = 64, 256
MISS = 1e-6
BLOCK = 512
#: Classes with copies are broadcast up to so many (16 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Ids of texts whose sets are needed are broadcast up to so many (8 bytes each), or the texts would be shuffled to find them.
WANTED_ROWS = 2_000_000

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 63, COORDINATES, dtype=U64) * U64(2) + _rng.integers(0, 2, COORDINATES, dtype=U64)
_MUL = _rng.integers(0, 1 << 63, COORDINATES, dtype=U64) * U64(2) + U64(1)


@lru_cache
def least_matches(of: int, similarity: float, miss: float = MISS) -> int:
    """The most matches out of `of` that a pair at the similarity falls short of with a chance of at most miss."""
    total, k = 0.0, 0
    while True:
        total += math.comb(of, k) * similarity**k * (1 - similarity) ** (of - k)
        if total > miss:
            return max(1, k)
        k += 1


def shingles(texts: Texts) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    words = texts.words(fold=True)
    at, hashes = words.windows(SHINGLE)
    first = np.searchsorted(at, words.first)
    out = []
    for i, n in enumerate(words.counts()):
        if n >= SHINGLE:
            out.append(np.unique(hashes[first[i] : first[i + 1]]))
        else:
            own = words.hashes[words.first[i] : words.first[i + 1]]
            out.append(chain([np.full(1, n, U64), *(own[k : k + 1] for k in range(n))]) if n else own)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDINATES) minimum hashes, 32 bits each; sets must not be empty."""
    flat, sizes = np.concatenate(sets), [len(s) for s in sets]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((COORDINATES, len(sets)), np.uint32)
    buf, top = np.empty_like(flat), np.empty(len(flat), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(COORDINATES):
            np.bitwise_xor(flat, _XOR[j], out=buf)
            np.multiply(buf, _MUL[j], out=buf)
            np.right_shift(buf, U64(32), out=buf)
            np.copyto(top, buf, casting="unsafe")
            out[j] = np.minimum.reduceat(top, starts)
    return out.T


def class_of(s: np.ndarray) -> int:
    """A hash of the whole set, as Spark's long."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        return int(signed(mix((mix(s).sum(keepdims=True) * U64(0x9E3779B97F4A7C15)) ^ np.bitwise_xor.reduce(mix(s ^ _XOR[0])) ^ U64(len(s))))[0])


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            sets = shingles(Texts.of(part.column("text")))
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = [b""] * len(sets)
            if full:
                values = signatures([sets[i] for i in full])
                for i, v in zip(full, values, strict=True):
                    sig[i] = v[:POSTED].tobytes() + v[POSTED:].astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), _binary(sig)], names=["doc_id", "n", "class", "sig"])


def sketch(sig: list[bytes]) -> np.ndarray:
    """All coordinates of stored signatures, 16 bits each."""
    raw = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1)
    low = np.ascontiguousarray(raw[:, : 4 * POSTED]).view(np.uint32).astype(np.uint16)
    return np.concatenate([low, np.ascontiguousarray(raw[:, 4 * POSTED :]).view(np.uint16)], axis=1)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coordinate = (np.arange(POSTED, dtype=U64) << U64(32))[None]
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            sig = part.column("sig").to_pylist()
            values = np.frombuffer(b"".join(s[: 4 * POSTED] for s in sig), np.uint32).reshape(-1, POSTED)
            tokens = mix(values.astype(U64) | coordinate).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(signed(tokens)), pa.array(np.repeat(np.asarray(part.column("class")), POSTED))], names=["token", "class"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            sets = shingles(Texts.of(part.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), _binary([s.tobytes() for s in sets])], names=["class", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    pairs = pairs.join(sets.select(F.col("class").alias("u"), F.col("shingles").alias("sa")), "u").join(sets.select(F.col("class").alias("v"), F.col("shingles").alias("sb")), "v")
    return pairs.mapInArrow(_confirm(percent), "u long, v long")


def _fits(percent: int):
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _agree(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = (sketch(batch.column("ga").to_pylist()) == sketch(batch.column("gb").to_pylist())).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep))

    return run


def _stars(postings: DataFrame, classes: DataFrame, percent: int, least: int) -> DataFrame:
    """Pairs of each class with the least class of each of its lists, if they match."""
    heads = postings.groupBy("token").agg(F.min("class").alias("head"), F.count("*").alias("n"))
    pairs = join_counted(postings, heads, "token", postings.count()).where("class <> head").select(F.col("class").alias("u"), F.col("head").alias("v")).distinct()
    a = classes.select(F.col("class").alias("u"), F.col("n").alias("na"), F.col("sig").alias("ga"))
    b = classes.select(F.col("class").alias("v"), F.col("n").alias("nb"), F.col("sig").alias("gb"))
    return pairs.join(a, "u").join(b, "v").where(_fits(percent)).select("u", "v", "ga", "gb").mapInArrow(_agree(least), "u long, v long")


class _Union:
    def __init__(self, names):
        self.up = {n: n for n in names}

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def _block_links(percent: int, least: int):
    """Links between components within one block: of rows with columns, and confirmed on the full sets at once.

    Once two components are linked here, their other pairs need no test. So a block gives fewer links than it has rows.
    """

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side = np.asarray(table.column("side"))
        rows, cols = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(rows) or not len(cols):
            return
        ids, labels, n = (np.asarray(table.column(c)) for c in ("class", "label", "n"))
        sig = sketch(table.column("sig").to_pylist())
        right = np.ascontiguousarray(sig[cols].T)
        sets = table.column("shingles").combine_chunks()
        full = lambda k: np.frombuffer(sets[k].as_buffer(), U64)
        union = _Union(labels.tolist())
        us, vs = [], []
        for r in rows:
            other = (labels[cols] != labels[r]) & (100 * np.minimum(n[cols], n[r]) >= percent * np.maximum(n[cols], n[r]))
            if side[r] == 2:
                other &= ids[cols] > ids[r]
            near = np.flatnonzero(other)
            if not len(near):
                continue
            matches = (right[:, near] == sig[r][:, None]).sum(axis=0)
            mine = full(r)
            for k in near[np.argsort(-matches, kind="stable")][: int((matches >= least).sum())]:
                c = cols[k]
                a, b = union.find(int(labels[r])), union.find(int(labels[c]))
                if a == b:
                    continue
                yours = full(c)
                shared = len(np.intersect1d(mine, yours, assume_unique=True))
                if 100 * shared >= percent * (len(mine) + len(yours) - shared):
                    union.up[max(a, b)] = min(a, b)
                    us.append(int(ids[r]))
                    vs.append(int(ids[c]))
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (family, i, j); a block is about 2 * BLOCK rows."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("family", "i", "j")])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, a])
                if last is not None and key != last:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _families(postings: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(family, label, class, n): the classes of components that share a list with another component."""
    own = cut(postings.join(labels, "class", "left").select("token", F.coalesce("label", "class").alias("label")).distinct())
    heads = own.groupBy("token").agg(F.min("label").alias("head"), F.max("label").alias("top"), F.count("*").alias("n"))
    mixed = cut(join_counted(own, heads, "token", own.count()).where("head < top AND label <> head").select(F.col("label").alias("u"), F.col("head").alias("v")).distinct())
    found = components(mixed).select(F.col("u").alias("label"), F.col("root").alias("family"))
    found = small(cut(found.unionAll(found.select(F.col("family").alias("label"), "family").distinct())))
    members = cut(classes.select("class", "n").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")).join(found, "label").select("family", "label", "class", "n"))
    release(own, mixed)
    return members


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for family, label, name, data in zip(batch.column("family").to_pylist(), batch.column("label").to_pylist(), batch.column("class").to_pylist(), batch.column("shingles"), strict=True):
            keys = mix(np.frombuffer(data.as_buffer(), U64) ^ mix(np.array([family], np.int64).view(U64)))
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(np.full(n, name, np.int64)), pa.array(np.full(n, label, np.int64))], names=["k", "class", "label"])


def _skipped(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members without those of families above BLOCK classes that cannot link to another component: a class whose partner is
    in another component shares at least percent of its own shingles with it, so with classes of other components together."""
    sizes = members.groupBy("family").agg(F.count("*").alias("size"))
    large = cut(sizes.where(F.col("size") > BLOCK).select("family"))
    if large.isEmpty():
        return members
    wide = members.join(small(large), "family")
    rows = wide.join(sets, "class").select("family", "label", "class", "shingles").mapInArrow(_shingle_rows, "k long, class long, label long")
    ends = rows.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
    total = wide.agg(F.sum("n")).first()[0]
    shared = join_counted(rows, ends, "k", total).where("lo < hi").groupBy("class").agg(F.count("*").alias("shared"))
    left = wide.join(shared, "class").where(100 * F.col("shared") >= percent * F.col("n")).select("family", "label", "class", "n")
    return cut(members.join(small(large), "family", "left_anti").unionByName(left))


def _blocks(members: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Each class with its signature and shingles in every block that it takes part in: BLOCK by BLOCK pairs of classes of a family."""
    sizes = members.groupBy("family", "label").agg(F.count("*").alias("k"))
    shape = sizes.groupBy("family").agg(F.sum("k").alias("size"), F.max(F.struct("k", "label")).alias("main"))
    shape = shape.select("family", F.col("main.label").alias("main"), F.ceil((F.col("size") - F.col("main.k")) / BLOCK).alias("outer"), F.ceil(F.col("main.k") / BLOCK).alias("inner"))
    own = members.join(classes.select("class", "sig"), "class").join(sets, "class").join(small(shape.where("outer > 0")), "family")
    block = lambda count: F.pmod(F.xxhash64("class", F.lit(7)), count).cast("int")
    upto = lambda count: F.sequence(F.lit(0), count.cast("int") - 1)
    outside = F.col("label") != F.col("main")
    b = F.when(outside, block(F.col("outer"))).otherwise(block(F.col("inner")))
    # side 0: rows, 1: columns, 2: both (a block of the outside with itself)
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    to_inside = F.transform(upto(F.col("inner")), lambda j: place(F.col("b"), j, F.lit(0)))
    to_outside = F.transform(upto(F.col("outer")), lambda o: place(F.least("b", o), -1 - F.greatest("b", o), F.when(F.col("b") == o, 2).when(F.col("b") < o, 0).otherwise(1)))
    from_inside = F.transform(upto(F.col("outer")), lambda i: place(i, F.col("b"), F.lit(1)))
    places = F.when(outside, F.concat(to_inside, to_outside)).otherwise(from_inside)
    keep = ["class", "label", "n", "sig", "shingles"]
    return own.withColumn("b", b).withColumn("p", F.explode(places)).select("family", "p.i", "p.j", "p.side", *keep)


def _across(postings: DataFrame, classes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, least: int) -> DataFrame:
    """The links that stars did not find: between components that share a list."""
    members = _skipped(_families(postings, classes, labels), sets, percent)
    rows = _blocks(members, classes, sets).repartition(F.col("family"), F.col("i"), F.col("j")).sortWithinPartitions("family", "i", "j")
    return rows.mapInArrow(_block_links(percent, least), "u long, v long")


def link(docs: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signs = cut(base.mapInArrow(_sign, "doc_id long, n long, class long, sig binary"))
    cuts = Cuts()
    linked = signs.where("n > 0 AND doc_id IS NOT NULL")
    heads = linked.groupBy("class").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies"))
    copied = cuts(heads.where("copies > 1").select("class", "head"))
    if copied.count() <= BROADCAST_ROWS:
        copied = F.broadcast(copied)
    alone = linked.join(copied, "class", "left").where("head IS NULL OR head = doc_id").select("class", "doc_id", "n", "sig")

    of_posted, of_all = least_matches(POSTED, percent / 100), least_matches(COORDINATES, percent / 100)
    posted = alone.select("class", "sig").mapInArrow(_post, "token long, class long")
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    posted = posted.join(shared, "token").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own")).where(F.size("own") >= of_posted)
    prefix = F.slice("own", 1, F.size("own") - F.lit(of_posted - 1))
    prefixes = cuts(posted.select("class", F.transform(prefix, lambda x: x["token"]).alias("tokens")))
    postings = cuts(prefixes.select("class", F.explode("tokens").alias("token")).join(prefixes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "token"))
    classes = cuts(alone.dropDuplicates(["class"]).join(prefixes.select("class"), "class").select("class", "doc_id", "n", "sig"))
    wanted = cuts(classes.join(postings.select("class").distinct(), "class", "left_semi").select("doc_id"))
    sets = cuts(base.join(small(wanted, WANTED_ROWS), "doc_id", "left_semi").mapInArrow(_sets, "class long, shingles binary").dropDuplicates(["class"]))

    links = cuts(_confirmed(_stars(postings, classes, percent, of_all), sets, percent))
    labels = cuts(components(links).select(F.col("u").alias("class"), F.col("root").alias("label")))
    links = links.unionAll(cuts(_across(postings, classes, sets, labels, percent, of_all)))
    labels = cuts(components(links).select(F.col("u").alias("class"), F.col("root").alias("label")))

    named = classes.select("class", F.col("doc_id").alias("head")).join(labels, "class").select("class", "label", "head")
    roots = classes.select(F.col("class").alias("label"), F.col("doc_id").alias("head"))
    least = named.select("label", "head").unionAll(roots.join(named.select("label").distinct(), "label", "left_semi")).groupBy("label").agg(F.min("head").alias("component"))
    joined = named.select("class", "label").unionAll(named.select(F.col("label").alias("class"), "label").distinct()).join(least, "label").select("class", "component")
    known = heads.where("copies > 1").join(joined, "class", "full").select("class", F.coalesce("component", "head").alias("component"))
    known = cut(known)
    cuts.release()
    out = signs.select("doc_id", "n", "class").join(known, "class", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), None).otherwise(component)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
    out._cut_tables = [signs, known]
    return out


def dedupe(docs: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each component; rows without a key stay."""
    linked = link(docs, percent, text, key)
    found = cut(linked)
    release(*linked._cut_tables)
    dropped = found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__dropped"))
    out = docs.join(dropped, docs[key] == F.col("__dropped"), "left_anti")
    twice = found.where("kept").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("__twice"))
    if twice.isEmpty():
        return out
    once = out.join(twice, docs[key] == F.col("__twice"), "left_anti")
    return once.unionByName(out.join(twice, docs[key] == F.col("__twice"), "left_semi").dropDuplicates([key]))
