"""The pipeline's stages on small tables: each against what its operator gives, and the whole run."""

import public_tokenizers

import corpus_pipeline
from flowspark.llm import minhash_dedup, pii, quality_rules, sentencepiece_sampling, source_mixing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        seen[name] = (docs, docs := spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert docs.dtypes == [(c, dict(seen["quality rules"][0].dtypes)[c]) for c in corpus_pipeline.COLUMNS]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = seen["quality rules"]
    assert ids(after) == ids(quality_rules.judge(before).where("q_kept"))
    before, after = seen["MinHash near-dedup"]
    assert ids(after) == ids(minhash_dedup.link(before, 80).where("kept"))
    before, after = seen["PII"]
    new = {r.doc_id: r.text for r in after.collect()}
    assert ids(before) == ids(after)
    assert all(not pii.base_spans(t) for t in new.values() if t)
    changed = {r.doc_id for r in before.collect() if new[r.doc_id] != r.text}
    assert changed == {r.doc_id for r in pii.tag(before).where("spans <> ''").select("doc_id").collect()}
    before, after = seen["mixing sources to target weights"]
    assert ids(after) == sorted(r.doc_id for r in source_mixing.mix(before).collect() for _ in range(r.mix_copies))
    before, after = seen["SentencePiece encoding"]
    texts = {r.doc_id: r.text for r in before.collect()}
    decoded = sentencepiece_sampling.decode(after, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert all(r.decoded == texts[r.doc_id] for r in decoded) and len(decoded) == before.count()


EDGES = [
    (None, "A row without a key " * 20, "en", "s1", 400), (1, None, "en", "s1", 0), (2, "", None, None, 0), (3, " \n\t ", "fr", None, 4), (4, "one two", None, "s2", 7),
    *[(10 + k, " ".join(f"word{k}x{j}" for j in range(120)) + " a\u2581b \U0001f600", None, None, 900) for k in range(4)],
    (20, "A copy of a text of enough words. " * 12, "en", "s1", 400), (20, "A copy of a text of enough words. " * 12, "en", "s1", 400), (21, "A copy of a text of enough words. " * 12, "en", "s3", 400),
    (30, " ".join(f"long{j}" for j in range(60_000)), "en", "s2", 500_000),
]


def test_stages_on_edge_cases(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, and columns of clashing names; then no rows at all."""
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(EDGES, schema).repartition(3)
    clash = docs.select("*", *[F.lit("x").alias(c) for c in ("q_kept", "kept", "component_id", "mix_size", "spans", "__dropped", "n_shingles")])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, SF)
        rows = out.collect()
        if name != "SentencePiece encoding":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        ids = [r.doc_id for r in rows]
        if name == "quality rules":
            assert not {1, 2, 3, 4} & set(ids)
        if name == "MinHash near-dedup":
            assert ids.count(20) == 1 and 21 not in ids and None in ids and {1, 2, 3, 4, 10, 11, 12, 13, 30} <= set(ids)
        if name == "PII":
            assert len(rows) == len(EDGES)
        if name == "mixing sources to target weights":
            assert set(ids) <= {r[0] for r in EDGES} and all(ids.count(k) <= 6 for k in set(ids))
        if name == "SentencePiece encoding":
            assert len(rows) == len(EDGES)
        empty = stage(spark, clash.where("false"), SF)
        assert empty.columns == out.columns and empty.count() == 0


def test_run_on_edge_cases_and_on_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("edges", EDGES), ("none", [])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "edges")).collect()}
    assert kept <= {None, 10, 11, 12, 13, 20, 30} and kept
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
