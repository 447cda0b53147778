"""The pipeline's stages, each on all that the one before kept."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import mixing, secretscan
from lamina.llm.common import materialise, table


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs, seen = table(spark, d, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, d), name)
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    first = {r.doc_id: r.text for r in table(spark, d, "documents").collect()}
    clean = {r.doc_id: r.text for r in seen["toxicity"].collect()}
    assert all(first[i] == t for i, t in clean.items()) and len(clean) > 0.8 * len(first)
    one = [r.doc_id for r in seen["near_duplicates"].collect()]
    assert len(one) == len(set(one)) and len({clean[i] for i in one}) == len(one)
    safe = {r.doc_id: r.text for r in seen["secrets"].collect()}
    assert sorted(safe) == sorted(one) and all(safe[i] == secretscan.redact(clean[i]) for i in one)
    mixed = mixing.mix(seen["secrets"]).collect()
    words = lambda t: len([w for w in t.split() if w])
    got = Counter()
    for r in seen["source_mix"].collect():
        got[r.doc_id] += words(r.text)
    assert all(abs(got[r.doc_id] - r.taken) <= 1 for r in mixed)
    assert seen["packing"].agg(F.sum("length")).first()[0] > 0


def test_empty(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    assert docs.count() == 0
