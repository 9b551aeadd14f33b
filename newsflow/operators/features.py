"""Term statistics and TF-IDF weights as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.functions import text as X
from newsflow.operators.lookup import lookup_join
from newsflow.session import stage


def without_stopwords(tokens: Column, stopwords: Sequence[str]) -> Column:
    """Drop stop words inside the token array (a hash-set test, no join)."""
    return F.filter(tokens, lambda t: ~t.isin(*stopwords)) if stopwords else tokens


def token_table(df: DataFrame, tokens: Column, id_col: str = "id") -> DataFrame:
    """``(id, pos, token)`` rows."""
    return df.select(id_col, F.posexplode(tokens).alias("pos", "token"))


def remove_stopwords(tokens: DataFrame, stopwords: DataFrame, token: str = "token") -> DataFrame:
    """Token rows outside the stop list; repeated tokens stay. The list is a user file of a few
    thousand words, left to the optimiser's own size check."""
    return tokens.join(stopwords.select(F.col("word").alias(token)).distinct(), token, "left_anti")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def counted(tokens: Column) -> Column:
    """``array<struct<term, tf>>``: tokens counted inside the row, by the runs of the sorted array."""

    def runs(ordered: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), new)
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(ordered))
        return let(starts, lambda at: F.transform(at, lambda p, k: F.struct(
            F.get(ordered, p).alias("term"), (end(at, k) - p).cast("long").alias("tf")
        )))

    some = F.size(tokens) > 0
    return F.when(some, let(F.sort_array(tokens), runs))


def term_counts(df: DataFrame, tokens: Column, id_col: str = "id") -> DataFrame:
    """``(id, term, tf)``; a document is one row, so nothing is shuffled."""
    return df.select(id_col, F.inline(counted(tokens)))


def tfidf_fit(df: DataFrame, tokens: Column, n_docs: int | None = None) -> DataFrame:
    """``(term, df, idf)`` with ``idf = ln((1 + n) / (1 + df)) + 1``.

    Terms are made distinct inside each row, so the one shuffle carries partial
    counts per term.
    """
    n = df.count() if n_docs is None else n_docs
    terms = df.select(F.explode(F.array_distinct(tokens)).alias("term"))
    return (
        terms.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", F.ln(F.lit(1.0 + n) / (F.col("df") + 1.0)) + 1.0)
    )


def tfidf_model(df: DataFrame, tokens: Column) -> DataFrame:
    """Fitted terms, staged: they are read by every later transform."""
    return stage(tfidf_fit(df, tokens), "terms")


def weigh_terms(counts: DataFrame, model: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``weight``: tf * idf scaled to unit L2 norm per document; unseen terms are dropped."""
    known = lookup_join(counts, model.drop("df"), "term").filter(F.col("idf").isNotNull())
    raw = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy(id_col)))
    return known.withColumn("weight", raw / norm).drop("idf")


def tfidf_transform(df: DataFrame, tokens: Column, model: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, term, tf, weight)`` of every document."""
    return weigh_terms(term_counts(df, tokens, id_col), model, id_col)


def vocab_lookup(df: DataFrame, tokens: Column, model: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, term, tf, df, idf)`` of the known terms of every document."""
    counts = term_counts(df, tokens, id_col)
    return lookup_join(counts, model.withColumnRenamed("df", "doc_freq"), "term").filter(F.col("idf").isNotNull())


def svm_tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    return without_stopwords(X.pattern_tokens(text), stopwords)
