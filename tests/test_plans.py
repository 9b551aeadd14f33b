"""Tables of texts are dealt by what they hold, whatever their files look like."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from newsflow.plans import tables


def test_texts_are_dealt_by_their_length(spark, tmp_path, monkeypatch):
    """One row group of equal texts, so a small file, still becomes as many tasks as its texts need."""
    monkeypatch.setattr(tables, "TASK_CHARS", 10_000)
    rows = 2_000
    pq.write_table(pa.table({"doc_id": list(range(rows)), "text": ["word " * 100] * rows}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"page_id": list(range(rows)), "html": ["<p>" * 100] * rows}), tmp_path / "pages.parquet")
    for df, chars in ((tables.documents(spark, str(tmp_path)), 500 * rows), (tables.texts(spark, str(tmp_path), "pages", "page_id"), 300 * rows)):
        parts = df.groupBy(F.spark_partition_id().alias("part")).count().collect()
        assert sum(r["count"] for r in parts) == rows
        assert len(parts) > chars // 10_000 * 0.7
        assert max(r["count"] for r in parts) < 8 * rows * 10_000 / chars


def test_a_python_batch_is_bounded_by_bytes(spark):
    """Long texts come to Python in short batches."""
    from newsflow.session import configure

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    df = configure(spark).range(0, 4_000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
    assert max(r["n"] for r in df.mapInArrow(sizes, "n long").collect()) < 16 << 20


def test_a_large_table_has_no_more_tasks_than_plain_writers(spark, tmp_path, monkeypatch):
    """Beyond that number tasks grow, up to their limit, instead of the writers' memory."""
    pq.write_table(pa.table({"doc_id": list(range(500)), "text": ["word " * 100] * 500}), tmp_path / "documents.parquet")
    monkeypatch.setattr(tables, "TASK_CHARS", 1_000)
    assert tables.text_tasks(spark, str(tmp_path), "documents") == 200
    monkeypatch.setattr(tables, "MOST_CHARS", 1_000)
    assert tables.text_tasks(spark, str(tmp_path), "documents") == 250


def test_sentences_of_an_article_meet_in_tasks_by_their_length(spark, tmp_path, monkeypatch):
    """The windows over articles use the tasks that the texts were dealt over, not the session's shuffle partitions."""
    from newsflow.plans import models

    monkeypatch.setattr(tables, "TASK_CHARS", 5_000)
    texts = [f"One word here {k}. Two words there. Three." for k in range(2_000)]
    pq.write_table(pa.table({"doc_id": list(range(2_000)), "text": texts}), tmp_path / "documents.parquet")
    tasks = tables.text_tasks(spark, str(tmp_path), "documents")
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for build in (models.temperature_weights, models.select_top_p, models.sample_candidate, models.block_repeat_ngrams, models.select_top_k):
        parts = build(spark, str(tmp_path)).select(F.spark_partition_id().alias("part")).distinct().count()
        assert parts > tasks * 0.8, build.__name__


def test_texts_of_both_sides_are_never_broadcast(spark, tmp_path):
    """Files that compress well look small: summaries and titles still meet by a merge join."""
    from newsflow.plans import models

    text = ["A title\nOne sentence here. Two are there. Three come after."] * 300
    pq.write_table(pa.table({"doc_id": list(range(300)), "text": text, "source": ["s"] * 300, "lang": ["en"] * 300}), tmp_path / "documents.parquet")
    for build in (models.zip_predictions, models.rouge_n, models.rouge_clipped, models.rouge_l, models.rouge_l_union, models.rouge_corpus, models.compare_runs):
        df = build(spark, str(tmp_path))
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, build.__name__
