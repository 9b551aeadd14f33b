"""Row filters, routing and column shaping of article and classifier tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.functions import text as X
from newsflow.operators.ordering import assign_ordinal
from newsflow.schemas import DOMAIN_LABELS, ROUTING_KEYWORDS

# ---------------------------------------------------------------------------
# Fixed values: (text, summary) columns of well-known summarisation datasets.
# ---------------------------------------------------------------------------
DATASET_COLUMNS = {
    "amazon_reviews_multi": ("review_body", "review_title"),
    "big_patent": ("description", "abstract"),
    "cnn_dailymail": ("article", "highlights"),
    "orange_sum": ("text", "summary"),
    "pn_summary": ("article", "summary"),
    "psc": ("extract_text", "summary_text"),
    "samsum": ("dialogue", "summary"),
    "thaisum": ("body", "summary"),
    "xglue": ("news_body", "news_title"),
    "xsum": ("document", "summary"),
    "wiki_summary": ("article", "highlights"),
}
DEFAULT_COLUMNS = ("maintext", "title")
# ---------------------------------------------------------------------------


def clean_for_domain(df: DataFrame, allowed: Sequence[str] = tuple(DOMAIN_LABELS)) -> DataFrame:
    """Articles with text and a domain of the allowed set; ids keep their gaps."""
    return df.filter(
        (F.col("maintext") != "") & (F.col("source_domain") != "") & F.col("source_domain").isin(*allowed)
    )


def route_by_title(
    df: DataFrame, keywords: Sequence[str] = ROUTING_KEYWORDS, hit: str = "no_title", miss: str = "clean"
) -> DataFrame:
    """Add ``route``: report-like titles apart from the rest, in one scan."""
    found = F.lit(False)
    for word in keywords:
        found = found | F.contains(F.col("title"), F.lit(word))
    return df.withColumn("route", F.when(found, hit).otherwise(miss))


def flag_empty_text(df: DataFrame, drop: bool = False) -> DataFrame:
    """Add ``is_empty``; rows are kept unless ``drop`` is set."""
    flagged = df.withColumn("is_empty", X.is_blank(F.col("maintext")))
    return flagged.filter(~F.col("is_empty")) if drop else flagged


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows holding any NULL."""
    return df.na.drop("any")


def keep_text_rows(df: DataFrame, text: str = "text", label: str = "label", id_col: str = "id") -> DataFrame:
    """Rows with a text, as ``(id, sentence, label)`` with a string label; ids keep their gaps."""
    return df.filter(F.col(text).isNotNull()).select(
        id_col, F.col(text).alias("sentence"), F.col(label).cast("string").alias("label")
    )


def rename_for_classifier(df: DataFrame) -> DataFrame:
    """``maintext`` to ``sentence`` and ``source_domain`` to ``label`` where present."""
    return df.withColumnsRenamed({"maintext": "sentence", "source_domain": "label"})


def drop_metadata(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Drop date and address and renumber ``id`` densely."""
    kept = df.drop("date_publish", "url")
    return assign_ordinal(kept, id_col, "_new").drop(id_col).withColumnRenamed("_new", id_col)


def select_text_summary(
    df: DataFrame,
    text_column: str | None = None,
    summary_column: str | None = None,
    dataset: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Project the ``text`` and ``summary`` pair: named columns, else the dataset's, else the default."""
    default_text, default_summary = DATASET_COLUMNS.get(dataset, DEFAULT_COLUMNS)
    chosen = {"text": text_column or default_text, "summary": summary_column or default_summary}
    for name, column in chosen.items():
        if column not in df.columns:
            raise ValueError(f"{name} column '{column}' needs to be one of: {', '.join(df.columns)}")
    return df.select(*keep, *[F.col(column).alias(name) for name, column in chosen.items()])


def drop_label(df: DataFrame, label: str = "label") -> DataFrame:
    return df.drop(label)


def pick_sentence_pair(df: DataFrame, first: str = "sentence", second: str | None = None) -> tuple[str, str | None]:
    """Names of the one or two text columns to encode, found by name."""
    if {"sentence1", "sentence2"} <= set(df.columns):
        return "sentence1", "sentence2"
    for column in (first, second):
        if column is not None and column not in df.columns:
            raise ValueError(f"no text column '{column}' in: {', '.join(df.columns)}")
    return first, second


def add_source_prefix(df: DataFrame, prefix: str | None, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(prefix or ""), F.col(column)))


def default_missing_label(df: DataFrame, label: str = "label", value: int = 0) -> DataFrame:
    return df.withColumn(label, F.coalesce(F.col(label), F.lit(value)))


def detect_task_type(df: DataFrame, label: str = "label") -> str:
    """``regression`` for a floating label, else ``classification``; reads the schema only."""
    is_float = isinstance(df.schema[label].dataType, (T.FloatType, T.DoubleType))
    return "regression" if is_float else "classification"
