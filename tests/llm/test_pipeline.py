from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from panelytics.llm import decontaminate, language_id, near_duplicates, secret_scans
from panelytics.llm.storage import stored


def test_stages_one_after_another(spark, sf_dir):
    """Each stage does to its predecessor's rows what its operator says, and nothing else goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, sf_dir))
        assert after.columns == columns
        if name == "language ID":
            samples = language_id.dictionaries(docs)
            ids = language_id.identify(docs, samples).where("not rejected")
        elif name == "MinHash near-dedup":
            ids = near_duplicates.near_duplicates(docs).where("kept")
        elif name == "benchmark decontamination":
            ids = decontaminate.report(docs, bench).where("not contaminated")
        else:
            ids = docs
            assert not secret_scans.report(after).where("n_live > 0 and spans like '%hex%'").count()
        assert sorted(after.select("doc_id").collect()) == sorted(ids.select("doc_id").collect())
        if name != "secret scans":
            assert after.exceptAll(docs).count() == 0
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.agg(F.max("length")).first()[0] <= 4096


def test_entry_registers_all(spark):
    names = list(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_odd_rows_and_empty_tables(spark, docs, no_docs, sf_dir):
    """Nulls, repeated rows, long texts and clashing names go through each stage with their columns; so does nothing."""
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        after = stored(stage(spark, docs, sf_dir))
        assert after.columns == docs.columns, name
        assert after.where("text is null").count() == docs.where("text is null").count(), name
        assert stage(spark, no_docs, sf_dir).count() == 0, name
