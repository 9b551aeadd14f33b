"""Distributed sinks: every task writes its own part files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.operators.ordering import assign_ordinal


def write_json_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as JSON Lines. A single array file would need one task for the whole table."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_labelled_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``label,text`` with a header, every field quoted, quotes doubled."""
    write_quoted_csv(df.select("label", "text"), path, mode)


def write_eval_predictions(
    predictions: DataFrame, references: DataFrame, path: str, id_col: str = "id", mode: str = "errorifexists"
) -> None:
    """``id,predictions,references``, paired by id and never by position."""
    write_quoted_csv(zip_predictions(predictions, references, id_col), path, mode)


def zip_predictions(predictions: DataFrame, references: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, predictions, references)`` joined on the row id: a row per reference, its prediction empty if there is none.

    Both sides hold texts and grow alike, and sizes guessed from compressed files say little, so neither is ever broadcast.
    """
    paired = references.join(predictions.hint("merge"), id_col, "left")
    return paired.select(id_col, F.coalesce("predictions", F.lit("")).alias("predictions"), "references")


def format_row_id(ordinal: str):
    return F.concat(F.lit("test-"), F.col(ordinal).cast("string"))


def domain_predictions(df: DataFrame, pred: str, id_col: str = "id") -> DataFrame:
    """``(id, source_domain)`` with ids ``test-0``, ``test-1``, ... in row id order."""
    numbered = assign_ordinal(df, id_col, "_ordinal")
    return numbered.select(format_row_id("_ordinal").alias("id"), F.col(pred).alias("source_domain"))


def write_domain_predictions(df: DataFrame, pred: str, path: str, id_col: str = "id", mode: str = "errorifexists") -> None:
    write_quoted_csv(domain_predictions(df, pred, id_col), path, mode)


def title_lines(df: DataFrame) -> DataFrame:
    """One JSON object ``{title, id}`` per row, as text."""
    return df.select(F.to_json(F.struct("title", "id")).alias("value"))


def write_title_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("title", "id").write.mode(mode).json(path)


def write_metrics(metrics: DataFrame, path: str, prefix: str = "", mode: str = "errorifexists") -> None:
    """A metrics table as one JSON file, a line per row, keys optionally prefixed."""
    named = metrics.withColumnsRenamed({c: prefix + c for c in metrics.columns})
    named.coalesce(1).write.mode(mode).json(path)


def write_by_category(df: DataFrame, path: str, category: str = "source_domain", mode: str = "errorifexists") -> None:
    """One folder per category.

    ``rebalance`` gathers each category so that tasks do not write a file per task and
    category, and splits a category that holds most rows over several tasks and files.
    """
    df.hint("rebalance", category).write.mode(mode).partitionBy(category).parquet(path)


def read_through_cache(spark: SparkSession, path: str, build, overwrite: bool = False) -> DataFrame:
    """Reuse the Parquet table at ``path``, or build and write it first."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    done = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
    if overwrite or not done:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_quoted_csv(df: DataFrame, path: str, mode: str) -> None:
    """CSV with a header, every field quoted, quotes doubled, blanks kept."""
    df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
