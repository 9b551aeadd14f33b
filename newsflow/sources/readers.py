"""Readers with explicit schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.functions import text as X
from newsflow.schemas import ARTICLE, LABELLED_TEXT
from newsflow.sources import json_arrays

EXTENSIONS = {"json": "json", "jsonl": "json", "csv": "csv", "parquet": "parquet"}


def scan_json_array(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = ARTICLE, positions: bool = False
) -> DataFrame:
    """Files that each hold one JSON array of records; a large file is read by many tasks."""
    return json_arrays.scan_json_array(spark, paths, schema, positions)


def file_positions(df: DataFrame, file_no: int = 0) -> DataFrame:
    """Add where each row of a file scan stands: file, block and place inside the block.

    Stage the result before numbering it, so that the places stay what they are.
    """
    return df.select(
        "*",
        F.lit(file_no).alias("_file_no"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def union_sources(parts: Mapping[str, DataFrame]) -> DataFrame:
    """All sources in one bag, duplicates kept, with provenance and file order."""
    union = None
    for number, (name, part) in enumerate(parts.items()):
        tagged = part.withColumn("origin", F.lit(name)).withColumn("origin_no", F.lit(number))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    if union is None:
        raise ValueError("no sources")
    return union


def scan_csv_labelled(spark: SparkSession, path: str, schema: T.StructType | str = LABELLED_TEXT) -> DataFrame:
    """CSV with a header; quoted fields may hold line breaks and doubled quotes."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


def scan_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_labelled_lines(spark.read.text(path))


def parse_labelled_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(label, text)`` of the lines that start with ``0,`` or ``1,``.

    A text that opens with a quote gets a closing one. Lines too short to hold a
    label are skipped like any other malformed line. Further columns are kept.
    """
    line = F.col(value)
    body = F.substring(line, 3, 2147483647)
    others = [c for c in lines.columns if c != value]
    return lines.filter(line.rlike("^[01],")).select(
        *others,
        F.substring(line, 1, 1).alias("label"),
        F.when(F.startswith(body, F.lit('"')), F.concat(body, F.lit('"'))).otherwise(body).alias("text"),
    )


def load_splits(spark: SparkSession, files: Mapping[str, str], schema: T.StructType) -> DataFrame:
    """One table of all splits with a ``split`` column; the extension names the format."""
    splits = None
    for name, path in files.items():
        extension = path.rstrip("/").rsplit(".", 1)[-1]
        if extension not in EXTENSIONS:
            raise ValueError(f"{name} file should be one of {', '.join(EXTENSIONS)}: {path}")
        reader = spark.read.schema(schema)
        if extension == "csv":
            reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
        if extension == "json":
            reader = reader.option("multiLine", True)
        part = reader.format(EXTENSIONS[extension]).load(path).withColumn("split", F.lit(name))
        splits = part if splits is None else splits.unionByName(part)
    if splits is None:
        raise ValueError("need at least one split")
    return splits


def clean_stopwords(lines: DataFrame, convert: Column | None = None) -> DataFrame:
    """Distinct non-empty words of a one-word-per-line table."""
    word = X.strip(F.col("value")) if convert is None else convert
    return lines.select(word.alias("word")).filter(F.col("word") != "").distinct()


def load_stopwords(spark: SparkSession, path: str, source: str = "", target: str = "") -> DataFrame:
    """Stop words of a text file, stripped, script-converted and distinct."""
    word = X.fold_characters(X.strip(F.col("value")), source, target)
    return clean_stopwords(spark.read.text(path), word)


def load_label_map(spark: SparkSession, path: str) -> DataFrame:
    """``(label_text, label_id)`` of a file holding one JSON object; the file is one row."""
    return spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string,int>")).alias("label_text", "label_id")
    )
