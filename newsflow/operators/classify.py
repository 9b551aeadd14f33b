"""Text classifiers as joins and sums: multinomial Naive Bayes, and the linear SVM of the sentiment baseline."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions import text as X
from newsflow.operators.features import svm_tokens, term_counts
from newsflow.operators.linear import LinearModel, fit_svm
from newsflow.operators.lookup import lookup_join
from newsflow.operators.ordering import split_random
from newsflow.session import stage

SCORE_DIGITS = 6
# Classes become columns of the term table.
MAX_CLASSES = 1_000


@dataclass
class NaiveBayes:
    """Fitted model: per-class numbers on the driver, term table staged.

    ``terms`` has ``(term, n, logp)`` with one log probability per class, in the
    order of ``labels``.
    """

    labels: list
    priors: list[float]
    terms: DataFrame

    def term_rows(self, label: str = "label") -> DataFrame:
        """Long form ``(term, label, logp)``."""
        pairs = F.arrays_zip(F.array(*[F.lit(x) for x in self.labels]).alias("l"), F.col("logp").alias("p"))
        return self.terms.select("term", F.inline(pairs).alias(label, "logp"))


def train_naive_bayes(df: DataFrame, tokens: Column, label: str = "label", smoothing: float = 1.0) -> NaiveBayes:
    """Laplace-smoothed multinomial Naive Bayes by counting.

    Token counts per (term, class) combine map-side, so a class holding most rows
    costs no more shuffle than a small one. The texts are tokenised once; only
    per-class sums come to the driver.
    """
    sizes = (
        df.groupBy(label).agg(F.count(F.lit(1)).alias("docs")).orderBy(label).limit(MAX_CLASSES + 1).collect()
    )
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    labels = [row[label] for row in sizes]
    counts = (
        df.select(label, F.explode(tokens).alias("term"))
        .groupBy("term")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.count(F.when(F.col(label) == x, 1)) for x in labels]).alias("counts"),
        )
    )
    staged = stage(counts, "nb-terms")
    vocabulary, *totals = staged.agg(
        F.count(F.lit(1)), *[F.sum(F.col("counts")[i]) for i in range(len(labels))]
    ).first()
    logs = [
        F.ln((F.col("counts")[i] + F.lit(smoothing)) / F.lit((total or 0) + smoothing * vocabulary))
        for i, total in enumerate(totals)
    ]
    documents = sum(row["docs"] for row in sizes)
    return NaiveBayes(
        labels,
        [log(row["docs"] / documents) for row in sizes],
        staged.select("term", "n", F.array(*logs).alias("logp")),
    )


def naive_bayes_scores(df: DataFrame, tokens: Column, model: NaiveBayes, id_col: str = "id") -> DataFrame:
    """``(id, scores)``: log posterior (up to a constant) per class; unseen terms are ignored."""
    counts = term_counts(df, F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit(""))), id_col)
    known = lookup_join(counts, model.terms.drop("n"), "term")
    sums = [
        F.round(F.coalesce(F.sum(F.col("tf") * F.col("logp")[i]), F.lit(0.0)) + F.lit(prior), SCORE_DIGITS)
        for i, prior in enumerate(model.priors)
    ]
    return known.groupBy(id_col).agg(F.array(*sums).alias("scores"))


def predict_naive_bayes(df: DataFrame, tokens: Column, model: NaiveBayes, id_col: str = "id") -> DataFrame:
    """``(id, pred, score)``: best class, ties to the first label in sort order."""
    labels = F.array(*[F.lit(x) for x in model.labels])
    scored = naive_bayes_scores(df, tokens, model, id_col)
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    return scored.select(
        id_col, F.element_at(labels, best).alias("pred"), F.array_max("scores").alias("score")
    )


def linear_scores(
    ids: DataFrame, weights: DataFrame, coefficients: DataFrame, bias: float = 0.0, id_col: str = "id"
) -> DataFrame:
    """``(id, score, pred)`` of a linear model for every row of ``ids``.

    ``weights`` is ``(id, term, weight)``, ``coefficients`` a staged ``(term, df, coef)``
    table; the decision is ``score >= 0``. A row without known terms scores the bias.
    """
    joined = lookup_join(weights, coefficients.drop("df"), "term")
    sums = joined.groupBy(id_col).agg(F.sum(F.col("weight") * F.col("coef")).alias("_sum"))
    score = F.round(F.coalesce(F.col("_sum"), F.lit(0.0)) + F.lit(bias), SCORE_DIGITS)
    return (
        ids.select(id_col)
        .join(sums, id_col, "left")
        .select(id_col, score.alias("score"))
        .withColumn("pred", (F.col("score") >= 0).cast("int"))
    )


def social_tokens(text: Column, negators: tuple[str, ...], stopwords=()) -> Column:
    """Tokens of text to predict: cleaned, alphabetic words with negators glued, then vectoriser tokens."""
    cleaned = X.merge_negation(X.words(X.clean_social(text), lower=False), negators)
    return svm_tokens(cleaned, stopwords)


@dataclass
class SentimentModel:
    """Fitted linear SVM over TF-IDF terms."""

    linear: LinearModel
    negators: tuple[str, ...]
    stopwords: tuple[str, ...]

    def predict(self, df: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
        """Add ``pred`` for new texts, which are cleaned first."""
        return self._score(df, social_tokens(F.col(text), self.negators, self.stopwords), id_col)

    def _score(self, df: DataFrame, tokens: Column, id_col: str = "id") -> DataFrame:
        scored = self.linear.scores(df, tokens, id_col).select(id_col, (F.col("scores")[0] >= 0).cast("int").alias("pred"))
        return df.join(scored, id_col)


def train_sentiment(
    df: DataFrame,
    negators: tuple[str, ...],
    stopwords: tuple[str, ...] = (),
    seed: int = 0,
    test_size: float = 0.1,
    idf_on_all: bool = False,
    clean_train: bool = False,
) -> tuple[SentimentModel, DataFrame]:
    """Linear SVM on ``(id, text, label)`` and the scored hold-out part.

    By default the vectoriser sees the train part only; ``idf_on_all`` fits it on the
    hold-out rows as well. Training texts stay raw while texts to predict are
    cleaned; ``clean_train`` treats both alike.
    """
    text = F.col("text")
    tokens = social_tokens(text, negators, stopwords) if clean_train else svm_tokens(text, stopwords)
    parts = stage(split_random(df.withColumn("_tokens", tokens).drop("text"), seed=seed, test_size=test_size), "sentiment")
    train, valid = (parts.filter(F.col("split") == s) for s in ("train", "valid"))
    linear = fit_svm(train, F.col("_tokens"), idf_rows=parts if idf_on_all else None)
    model = SentimentModel(linear, negators, stopwords)
    return model, model._score(valid, F.col("_tokens")).drop("_tokens")
