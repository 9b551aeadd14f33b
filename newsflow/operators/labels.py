"""Label dictionaries: building, encoding, decoding, counting.

A label table has one row per class and comes from a label file or a distinct
over the corpus; it is broadcast only after its row count is checked.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.operators.lookup import sized

MAX_LABELS = 10_000


def label_table(spark: SparkSession, mapping: Mapping[str, int]) -> DataFrame:
    """``(label_text, label_id)`` rows of a dictionary."""
    if len(mapping) > MAX_LABELS:
        raise ValueError(f"{len(mapping)} labels, at most {MAX_LABELS} expected")
    return spark.createDataFrame(list(mapping.items()), "label_text string, label_id int")


def label_map_rows(json_objects: Column | str, df: DataFrame) -> DataFrame:
    """Rows ``(label_text, label_id)`` of JSON objects held in a string column."""
    return df.select(F.explode(F.from_json(json_objects, "map<string,int>")).alias("label_text", "label_id"))


def encode_label(df: DataFrame, labels: DataFrame, label: str = "label", unknown: str = "error") -> DataFrame:
    """Label text to class id; a missing label becomes 0.

    ``unknown="error"`` fails on a text outside the map, ``"null"`` leaves NULL so
    that the caller can divert those rows.
    """
    dim = sized(labels.select(F.col("label_text").alias(label), F.col("label_id").alias("_id")), MAX_LABELS)
    missing = F.when(F.col(label).isNull(), F.lit(0))
    if unknown == "error":
        absent = F.raise_error(F.concat(F.lit("unknown label: "), F.col(label))).cast("int")
    else:
        absent = F.lit(None).cast("int")
    joined = df.join(dim, label, "left").withColumn("_id", F.coalesce(F.col("_id"), missing.otherwise(absent)))
    return joined.drop(label).withColumnRenamed("_id", label)


def decode_label(df: DataFrame, labels: DataFrame, index: str, out: str) -> DataFrame:
    """Class id to label text (the inverted map)."""
    dim = labels.select(F.col("label_id").alias(index), F.col("label_text").alias(out))
    return df.join(sized(dim, MAX_LABELS), index, "left")


def label_distribution(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def label_index(*parts: DataFrame, label: str = "label") -> DataFrame:
    """Sorted distinct labels of all parts with a dense index from 0.

    The window runs over the distinct labels only.
    """
    names = parts[0].select(label)
    for part in parts[1:]:
        names = names.unionByName(part.select(label))
    order = Window.partitionBy(F.lit(0)).orderBy("label_text")
    return names.select(F.col(label).alias("label_text")).distinct().withColumn(
        "label_id", F.row_number().over(order) - 1
    )
