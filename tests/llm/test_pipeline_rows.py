"""The pipeline's stages on awkward rows and on empty tables."""

import collections

import corpus_pipeline
from tests.llm.data import documents, empty


def written(spark, folder, docs, labels):
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int, text string").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_awkward_rows(spark, tmp_path):
    """Null, empty and very long texts, null and repeated keys, whole rows twice, columns that clash with those the stages add."""
    sf = written(spark, tmp_path, documents(spark), [(1, 0, 1, "x"), (2, None, 1, "x"), (None, 1, 0, "x"), (6, 0, None, None), (6, 1, None, None)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, sf)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen.append([(r.doc_id, r.text) for r in docs.collect()])
    # Nothing is toxic enough to go. The text of 1 recurs in 2 and under a null key, where line dedup empties it.
    assert collections.Counter(seen[0]) == collections.Counter(rows)
    assert collections.Counter(k for k, _ in seen[1]) == collections.Counter(k for k, _ in rows)
    assert all(r.n_chars == len(r.text) for r in spark.read.parquet(str(tmp_path / "stage1")).collect() if r.text is not None)
    assert {t for k, t in seen[1] if k == 2} == {""} and any(k is None and t == "" for k, t in seen[1])
    # Of near-equal texts and of empty ones that of the smallest key stays, and one of rows that repeat.
    kept = collections.Counter(k for k, _ in seen[2])
    assert kept[1] == kept[2] == kept[7] == 1 and not any(kept[k] for k in (3, 4, 5, 11)) and kept[10] == 2 and kept[None] == 1
    # The mix repeats or leaves whole documents; texts without words have no share in it.
    assert {k for k, _ in seen[3]} <= {k for k, _ in seen[2]} - {2} and set(seen[3]) <= set(seen[2])
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()
    assert collections.Counter(r.doc_id for r in packed if r.start == 0) == collections.Counter(k for k, _ in seen[3])


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, empty(spark), [])).collect() == []
