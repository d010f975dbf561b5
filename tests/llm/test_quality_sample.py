"""The sample that the quality rules learn from."""

from folioscope.llm import quality


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.range(60_000).selectExpr("IF(id < 300, id, id + 1000000) AS doc_id", "CAST(id % 2 AS int) AS quality", "0 AS toxic")
    chosen = quality._chosen(docs, labels, 300, 300, 1 << 20).collect()
    assert sorted(r.doc_id for r in chosen) == list(range(300))
    assert len(quality._chosen(docs, labels, 40, 40, 1 << 20).collect()) == 40
