"""File-stream ingest of article drops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from newsflow.operators.cleaning import clean_for_domain
from newsflow.schemas import ARTICLE, DOMAIN_LABELS


def stream_ingest_articles(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    allowed: Sequence[str] = tuple(DOMAIN_LABELS),
    schema=ARTICLE,
    files_per_trigger: int = 1000,
) -> None:
    """Clean all article files not seen before and append them to a Parquet table.

    Stateless and exactly-once: the checkpoint remembers files and commits. Runs
    until the files present at the start are done (``availableNow``).
    """
    articles: DataFrame = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(source)
    )
    query = (
        clean_for_domain(articles, allowed)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
