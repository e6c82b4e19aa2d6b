"""The pipeline's stages in turn: what each keeps, and that its decision holds."""

import corpus_pipeline
from tesserix.session import cut_lineage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, cut_lineage(stage(spark, docs, SF), name)
        assert docs.count() > 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        if name in ("toxicity", "ngram_jaccard_join"):
            assert docs.count() == docs.select("doc_id").distinct().count()
            assert docs.exceptAll(before).count() == 0
        if name == "secret_scan":
            assert docs.count() == before.count()
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 4096").count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r[0] for r in corpus_pipeline.toxicity(spark, docs, sf).select("doc_id").collect()}
    marks = {r[0]: r[1] for r in labels.join(docs.select("doc_id"), "doc_id").groupBy("doc_id").agg({"toxic": "max"}).collect() if r[1] is not None}
    toxic, clean = ([i for i, t in marks.items() if bool(t) == k] for k in (True, False))
    assert sum(i not in kept for i in toxic) >= 0.5 * len(toxic) and sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_a_stage_drops_the_tables_of_the_one_before(spark):
    import os

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = cut_lineage(stages["toxicity"](spark, docs, SF), "kept")
    left = list(corpus_pipeline._LEFT)
    assert left and all(os.path.isdir(p) for p in left)
    second = cut_lineage(stages["secret_scan"](spark, first, SF), "kept")
    assert not any(os.path.isdir(p) for p in left) and second.count() == first.count()
