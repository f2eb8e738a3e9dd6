import re

import corpus_pipeline
from llm_helpers import documents, odd_rows
from panelspark.llm.contamination import benchmark_matches
from panelspark.llm.minhash import near_duplicates
from panelspark.llm.mixing import mix_sources
from panelspark.llm.quality import quality_rules
from panelspark.llm.secrets import scan_secrets

SF_DIR = "/root/testdata/sf0.001"


def test_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        ids, before = ([r["doc_id"] for r in d.select("doc_id").collect()] for d in (out, docs))
        if name == "quality_rules":
            want = [r["doc_id"] for r in quality_rules(docs, labels).where("kept").collect()]
        elif name == "near_duplicates":
            want = [r["doc_id"] for r in near_duplicates(docs).where("kept").collect()]
        elif name == "decontamination":
            gone = {r["doc_id"] for r in benchmark_matches(docs, items).collect()}
            want = [d for d in before if d not in gone]
        elif name == "secret_scan":
            want = before
            assert {r["spans"] for r in scan_secrets(out).collect()} == {""}
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        else:
            want = [r["doc_id"] for r in mix_sources(docs).collect() for _ in range(r["copies"])]
        assert sorted(ids) == sorted(want), name
        assert out.columns == docs.columns + ["_copy"] * (name == "mixing")
        rows, docs = sorted(map(str, out.collect())), out
    assert sorted(map(str, corpus_pipeline.run(spark, SF_DIR).collect())) == rows
    assert not re.search("AKIA", "".join(rows))


def test_odd_input(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF_DIR).count() == 0, name
        assert stage(spark, odd, SF_DIR).columns[: len(odd.columns)] == odd.columns, name
    assert documents(spark, odd_rows()).columns == odd.columns
