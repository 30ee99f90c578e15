"""The corpus pipeline on a small folder: each stage's decision takes effect on what its predecessor kept."""

from __future__ import annotations

import corpus_pipeline
from test_operators import documents, labelled, prose  # the folder of this file is on the path


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(spark, 200)
    shared = prose(70, 60)
    more = [(500, prose(71, 80)), (501, prose(71, 80)), (502, f"{prose(72, 20)} {shared} {prose(73, 20)}"), (503, f"{prose(74, 20)} {shared} {prose(75, 20)}"), (504, None)]
    documents(spark, docs + more).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    folder, table = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = tmp_path / str(i)
        (df := stage(spark, table, folder)).write.parquet(str(out))
        assert name and (i == 4 or df.columns == table.columns)
        table = spark.read.parquet(str(out))
        kept[i] = table.collect()
    assert {r.doc_id for r in kept[0]} == {i for i, _ in docs + more if i >= 200 or i % 4}
    assert {r.doc_id for r in kept[0]} - {r.doc_id for r in kept[1]} == {501}
    texts = {r.doc_id: r.text for r in kept[2]}
    assert texts[502] == f"{prose(72, 20)} {prose(73, 20)}" and texts[500] == prose(71, 80) and len(kept[2]) == len(kept[1])
    assert sum(len((r.text or "").split()) for r in kept[3]) > 1.3 * sum(len((r.text or "").split()) for r in kept[2])
    assert len(kept[4]) == len(kept[3]) and all(r.checked for r in kept[4])
    assert corpus_pipeline.run(spark, folder).count() == len(kept[4])


def test_pipeline_of_nothing(spark, tmp_path):
    documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
