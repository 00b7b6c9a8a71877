"""The pipeline's stages against brute force, each on what its predecessor kept."""

import collections
import re

import corpus_pipeline
from lakeferry.llm import quality_rules
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    kept = stages[names[0]](spark, docs, SF).cache()
    judged = quality_rules.apply_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept")
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged.collect()}
    single = stages[names[1]](spark, kept, SF).cache()
    rows = sorted(kept.select("doc_id", "text").collect())
    parts = brute_components([r.text for r in rows])
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {rows[i].doc_id for i, (_, c) in parts.items() if i == c}
    clean = stages[names[2]](spark, single, SF).cache()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in single.collect() if any(f" {i} " in f" {' '.join(words(r.text))} " for i in items)}
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and not left & holds and len(left) >= single.count() - len(holds) - 3
    mixed = stages[names[3]](spark, clean, SF).cache()
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= left and mixed.count() > 0
    shards = stages[names[4]](spark, mixed, SF).collect()
    assert collections.Counter(r.doc_id for r in shards) == collections.Counter(r.doc_id for r in mixed.collect())
    assert sorted(map(tuple, shards)) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
