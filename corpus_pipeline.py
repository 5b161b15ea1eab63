"""The corpus pipeline: five operators in a row over documents, each on all that the one before kept.

Defined results: a stage reads and gives the columns of documents alone, so others cannot clash. Null and empty texts are
rejected by the first stage (fewer than 50 words); given to a later one, null texts stay null and are kept by 1 and 10, weigh
nothing in 7 and have null pieces in 8. A null source is a source and host of its own, a null lang stays null. Rows without a
doc_id are never dropped as copies; rows that repeat one leave one of them. Very long texts are read whole. Ties between copies
go to the smallest doc_id. An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import minhash_dedup, pii, quality_rules, sentencepiece_sampling, source_mixing
from flowspark.llm.common import cut, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; lines above their host's limit leave the others' texts."""
    return _measured(quality_rules.clean(docs.select(*COLUMNS)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    return minhash_dedup.dedupe(docs.select(*COLUMNS), percent=80)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes its kind in brackets; every document stays."""
    return _measured(pii.mask(docs.select(*COLUMNS)))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return source_mixing.emit(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces and pieces: the texts' sampled SentencePiece ids."""
    out = sentencepiece_sampling.encode(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"), alpha=1.0, seed=8)
    return out.select("doc_id", "source", "n_pieces", "pieces")


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("PII", personal_data_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: The tagger and the sampler have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents. What each stage keeps is written once and read by the next; a table that
    the next stage's result no longer needs is removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
            release(*before)
            before = [docs]
    return docs
