"""Hand-made document tables for the edge cases."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

PROSE = "the quick brown fox jumps over the lazy dog while seven small birds watch from a very old oak tree near the river"


def docs(spark, rows, clashes=()):
    """``rows`` of (doc_id, text) or whole rows; every name of ``clashes`` becomes a further column of strings."""
    full = [tuple(r) if len(r) == 5 else (r[0], r[1], "en", "web", None) for r in rows]
    schema = T.StructType(DOCS.fields + [T.StructField(c, T.StringType()) for c in clashes])
    return spark.createDataFrame([(*r, *(["clash"] * len(clashes))) for r in full], schema)


def awkward():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    return [
        (1, PROSE, "en", "a", 10), (1, PROSE, "en", "a", 10), (2, PROSE, None, None, None), (3, "", "en", "a", 0), (4, None, "en", "b", None),
        (None, "no id here", "en", "a", 1), (None, None, None, None, None), (5, " \t\n ", "de", "b", 3), (6, "word " * 50_000, "en", "b", 1),
        (7, "über straße café naïve 東京 👍", "de", "c", 1), (8, "12345 !!! ###", "en", "c", 1),
    ]
