"""Mixing sources to target weights (operator 7), in DataFrame functions only.

Sources are ranked in code-point order (null last) without bringing them to one task: a range sort, the
number of sources in each sorted partition, and a rank within the partition. Water filling then needs a
few one-row aggregates: a source whose cap (``max_rate`` times its size) lies under its weighted share is
fixed at the cap, and what remains is shared again, until no source is above its cap.

Defined results: null text counts as no words and has size 0; a null source is a source of its own, ranked
last; a source without words gets target 0; repeated rows each count and take the same number of copies;
an empty table gives an empty result. Columns of the input are kept beside the new ones, except
those named like the operator's own (mix_...), which are dropped. Of a very long text only the number of words
is used, which its row counts by itself; a source of one such document is taken 0 to max_rate times as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, without

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) of 52 bits, from the key alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_sizes(docs: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """One row a source: source, source_size, and rank from 0 in code-point order."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    key = [F.col("source").isNull(), F.col("source")]
    placed = sizes.repartitionByRange(*[F.asc(c) if isinstance(c, str) else c.asc() for c in key]).withColumn("part", F.spark_partition_id())
    placed = cut(placed.withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy(*key)) - 1))
    before = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = before.alias("b").join(before.alias("a"), F.col("a.part") < F.col("b.part"), "left").groupBy(F.col("b.part").alias("part")).agg(F.coalesce(F.sum("a.n"), F.lit(0)).alias("offset"))
    return cut(placed.join(before, "part").select("source", "source_size", (F.col("within") + F.col("offset")).alias("rank")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """sizes with weight and target: shares of the whole by weight, at most max_rate times the source's size."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sizes = sizes.withColumn("weight", weight)
    cap = F.col("source_size") * max_rate
    wide = lambda n: n.cast("decimal(19,0)")  # noqa: E731 - products of sizes and weights pass 64 bits, and a literal's own type may have 32
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = None, -1
    while True:
        full = F.lit(False) if level is None else wide(cap) * wide(F.lit(level[1])) <= wide(F.lit(level[0])) * wide(F.col("weight"))
        x = sizes.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
            F.count_if(full).alias("n"),
        ).first()
        if x.n == fixed or x.open == 0:
            break
        fixed, level = x.n, (int(total) - int(x.held), int(x.open))
    if level is None:
        return sizes.withColumn("target", F.lit(0.0))
    share = F.lit(float(level[0])) * F.col("weight") / F.lit(float(level[1]))
    return sizes.withColumn("target", F.when(full, cap.cast("double")).otherwise(F.least(share, cap.cast("double"))))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies.

    mix_copies is floor(rate) and one more where the key's hash is under rate's fraction; the rate is the
    source's target over its size and so at most max_rate. Only the list of sources is joined, which has a
    row a source; the planner broadcasts it if it is under its own size limit and else sorts and merges,
    with the hot source split by adaptive execution.
    """
    docs = without(docs, ("mix_size", "mix_source_size", "mix_target", "mix_copies", "__source", "__copy"))
    sized = docs.withColumn("mix_size", word_count(F.col(text)))
    wanted = targets(source_sizes(sized, source, "mix_size"), weights, max_rate)
    wanted = wanted.select(F.col("source").alias("__source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + (uniform(F.col(key), seed) < rate - whole).cast("long")).alias("mix_copies")
    return sized.join(wanted, F.col(source).eqNullSafe(F.col("__source"))).select(*[sized[c] for c in sized.columns], "mix_source_size", "mix_target", copies)


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of docs with their own columns, each as often as it is taken."""
    columns = docs.columns
    out = mix(docs, **options)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("mix_copies"), F.lit(1)).cast("int")))).where("mix_copies > 0").select(*[c for c in columns if c in out.columns])
