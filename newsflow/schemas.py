"""Explicit schemas and fixed vocabularies of the news data model."""

from __future__ import annotations

from pyspark.sql import types as T

ARTICLE = T.StructType(
    [
        T.StructField("date_publish", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("maintext", T.StringType()),
        T.StructField("source_domain", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
    ]
)

NUMBERED_ARTICLE = T.StructType(
    [T.StructField("id", T.LongType()) if f.name == "id" else f for f in ARTICLE.fields]
)

LABELLED_TEXT = T.StructType([T.StructField("label", T.StringType()), T.StructField("text", T.StringType())])

CATEGORY = T.StructType(
    [T.StructField("link", T.ArrayType(T.StringType())), T.StructField("source_domain", T.StringType())]
)

# ---------------------------------------------------------------------------
# Label ids, routing keywords and negator that results depend on.
# ---------------------------------------------------------------------------
DOMAIN_LABELS = {
    "system": 0,
    "crypto": 1,
    "bond": 2,
    "estate": 3,
    "forex": 4,
    "future": 5,
    "gold": 6,
    "fund": 7,
    "material": 8,
    "stock": 9,
}

SENTIMENT_LABELS = {"負面": 0, "正面": 1}

ROUTING_KEYWORDS = ("報告", "操作策略")

NEGATORS = ("不",)

LABEL_IGNORE_ID = -100
# ---------------------------------------------------------------------------
