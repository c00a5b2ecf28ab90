import hashlib

import numpy as np

import corpus_pipeline
from rectio.llm import decontaminate, pii, queries, toxicity


def test_pipeline_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns, name
        docs.write.mode("overwrite").format("noop").save()
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        seen.append(docs.count())
    assert seen[0] >= seen[1] > seen[2] > seen[3] == seen[4] > 0
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.contamination(docs, bench, prefix="p_").where("p_contaminated").count() == 0
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.collect())
    for r in out:
        assert r.n_tokens * 4 == len(r.ids) and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert np.frombuffer(r.ids, "<u4").max(initial=0) < 49408
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "pii", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None and pii and toxicity


def test_every_operator_has_a_query():
    names = [n for n in queries.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
