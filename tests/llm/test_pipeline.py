"""Every stage of the pipeline, and the whole run, on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import decontamination, simhash

from .test_corpus_operators import plain_kept

SF_DIR = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], {}
    assert names == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "byte_bpe_encoding"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF_DIR).cache()
        kept[name] = after
        assert set(docs.columns) <= set(after.columns) and (name == names[-1] or after.columns == docs.columns)
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        before = after
    good = kept["quality_classifier"]
    assert 0 < good.count() < docs.count()
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    one = kept["simhash_near_dedup"]
    assert sorted(r["doc_id"] for r in one.collect()) == plain_kept(rows)
    assert one.count() == len({simhash.simhash(simhash.shingle_hashes(t, 3)) for _, t in [(r["doc_id"], r["text"]) for r in one.collect()]})
    cut = kept["substring_dedup"]
    assert cut.count() == one.count()
    shorter = cut.join(one.select("doc_id", F.col("text").alias("whole")), "doc_id").where("char_length(text) <= char_length(whole) AND n_chars = char_length(text)")
    assert shorter.count() == cut.count()
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    assert not decontamination.report(kept["benchmark_decontamination"], bench).where("contaminated").count()
    last = kept["byte_bpe_encoding"]
    assert last.count() == kept["benchmark_decontamination"].count() and not last.where("NOT round_trip").count()
    ran = corpus_pipeline.run(spark, SF_DIR)
    assert ran.columns == last.columns and ran.exceptAll(last).count() == 0 and ran.count() == last.count()


def test_an_empty_table_goes_through(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0
