"""User functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType
) -> DataFrame:
    """Apply ``fn`` to column batches inside tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def batch_inference(
    df: DataFrame,
    load_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: str | T.StructType,
) -> DataFrame:
    """Pre-process, model and post-process in one pass: ``load_model`` runs once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            model = model or load_model()
            yield model(batch)

    return df.mapInPandas(run, schema)


def metric_callback(df: DataFrame, metric: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score a prediction table with a user metric, itself a DataFrame function."""
    return metric(df)
