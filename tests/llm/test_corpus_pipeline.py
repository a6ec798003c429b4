"""The pipeline over planted rows, stage by stage, and the registered queries."""

import __spark_entry__ as driver
import corpus_pipeline
from kerbwatch.llm import queries


def test_stages_are_named_and_registered():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "toxicity", "SimHash near-dedup", "secret scans", "packing"]
    registered = driver.queries()
    assert set(queries.REGISTRY) | {"pipeline"} <= set(registered)
    assert [n.split("_")[0] for n in queries.REGISTRY] and len(queries.REGISTRY) == 13
    assert set(driver.oracle_sql()) >= {"op4_secrets"}


def test_stages_take_effect(spark, corpus, edge_docs, no_docs, tmp_path):
    docs, labels = corpus
    planted = [
        (1000, None, "aa", "s1"), (1001, "", "aa", "s1"), (1002, "123 456", "bb", "s1"),
        (1003, "lorem ipsum dolor amet scumbag scumbag magna tempor lowlife aliqua", "aa", "s2"),
        (1004, "lorem nostrud dolor password=abcd1234efgh tempor aliqua magna veniam", "aa", "s2"),
        (1005, docs.filter("doc_id = 1").first().text.upper(), "aa", "s9"),
    ]
    rows = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, frame, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert frame.columns == docs.columns
        kept[name] = {r.doc_id: r for r in frame.collect()}
    ids = {name: set(v) for name, v in kept.items()}
    assert {1000, 1001, 1002}.isdisjoint(ids["language ID"]) and ids["language ID"] >= set(range(300))
    assert 1003 not in ids["toxicity"] and {1004, 1005} <= ids["toxicity"]
    assert len(ids["toxicity"] & set(range(0, 300, 10))) <= 3  # abusive documents
    assert len(ids["toxicity"] - set(range(0, 300, 10))) >= 265
    assert 1005 not in ids["SimHash near-dedup"] and 1 in ids["SimHash near-dedup"]
    assert ids["secret scans"] == ids["SimHash near-dedup"] == ids["packing"]
    assert kept["secret scans"][1004].text.split()[3] == "[SECRET]"
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in whole} == ids["packing"]
    assert sum(r.length for r in whole) == sum(r.length for r in frame.collect())


def test_stages_take_edge_rows(spark, edge_docs, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, str(tmp_path))
            assert made.count() <= max(docs.count(), made.count() if "sequence_id" in made.columns else 0)
