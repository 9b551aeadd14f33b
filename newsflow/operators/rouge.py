"""ROUGE scores per (prediction, reference) row.

ROUGE-N is a Spark expression; the clipped variant and the union over sentences count in Arrow batches. The longest common
subsequence of ROUGE-L over whole texts runs in a small Arrow batch helper that packs one
dynamic-programming row into one Python integer, so whole texts of thousands of
tokens are scored in milliseconds (bit-parallel LCS, Hyyro 2004).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.functions import text as X
from newsflow.operators.metrics import round_scores

# ---------------------------------------------------------------------------
# Fixed value: the constant that keeps the F score defined for 0 / 0.
# ---------------------------------------------------------------------------
F_EPSILON = 1e-8
# ---------------------------------------------------------------------------


def _prf(overlap: Column, n_pred: Column, n_ref: Column) -> tuple[Column, Column, Column]:
    precision = F.when(n_pred == 0, F.lit(0.0)).otherwise(overlap / n_pred)
    recall = F.when(n_ref == 0, F.lit(0.0)).otherwise(overlap / n_ref)
    return precision, recall, 2.0 * precision * recall / (precision + recall + F.lit(F_EPSILON))


def _add(df: DataFrame, name: str, overlap: Column, n_pred: Column, n_ref: Column) -> DataFrame:
    p, r, f = _prf(overlap, n_pred, n_ref)
    return df.withColumns({f"{name}_p": p, f"{name}_r": r, f"{name}_f": f})


def rouge_n(df: DataFrame, n: int, pred: str = "pred_tokens", ref: str = "ref_tokens") -> DataFrame:
    """Set-based ROUGE-N columns ``rouge<n>_{p,r,f}`` from two token columns."""
    grams = {f"_{side}": F.array_distinct(X.ngrams(F.col(c), n)) for side, c in (("p", pred), ("r", ref))}
    with_grams = df.withColumns(grams)
    overlap = F.size(F.array_intersect("_p", "_r"))
    return _add(with_grams, f"rouge{n}", overlap, F.size("_p"), F.size("_r")).drop("_p", "_r")


def _lcs_batches(a: Column, b: Column) -> Column:
    """LCS length of two token columns. The helper travels with the task, so workers need no package."""

    def length(x, y) -> int:
        if x is None or y is None or len(x) == 0 or len(y) == 0:
            return 0
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        where: dict[str, int] = {}
        for i, token in enumerate(short):
            where[token] = where.get(token, 0) | (1 << i)
        full = (1 << len(short)) - 1
        row = full
        for token in long:
            match = row & where.get(token, 0)
            row = ((row + match) | (row - match)) & full
        return len(short) - row.bit_count()

    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([length(p, q) for p, q in zip(x, y)], dtype="int32")

    return F.pandas_udf(batch, T.IntegerType())(a, b)


def rouge_l(df: DataFrame, pred: str = "pred_tokens", ref: str = "ref_tokens") -> DataFrame:
    """``rougel_{p,r,f}`` from the LCS of the whole texts."""
    scored = df.withColumn("_lcs", _lcs_batches(F.col(pred), F.col(ref)))
    return _add(scored, "rougel", F.col("_lcs"), F.size(pred), F.size(ref)).drop("_lcs")


def _clipped_overlap(a: Column, b: Column) -> Column:
    """Elements that two arrays share, each as often as in both."""

    def both(x: pa.Array, y: pa.Array) -> pa.Array:
        shared = []
        for p, q in zip(x.to_pylist(), y.to_pylist()):
            left = Counter(p)
            shared.append(sum(min(n, left[g]) for g, n in Counter(q).items()))
        return pa.array(shared, pa.int32())

    return F.arrow_udf(both, T.IntegerType())(a, b)


def rouge_clipped(
    df: DataFrame, n: int, id_col: str = "id", pred: str = "pred_tokens", ref: str = "ref_tokens"
) -> DataFrame:
    """Count-clipped ROUGE-N per pair: ``(id, clipped<n>_{p,r,f})``, counted in the row."""
    empty = F.array().cast("array<string>")
    grams = df.select(id_col, *[F.coalesce(X.ngrams(F.col(c), n), empty).alias(s) for c, s in ((pred, "_p"), (ref, "_r"))])
    scored = grams.withColumn("_both", _clipped_overlap(F.col("_p"), F.col("_r")))
    return _add(scored, f"clipped{n}", F.col("_both"), F.size("_p"), F.size("_r")).drop("_both", "_p", "_r")


def _shared_words(ref: list[str], pred: list[str]) -> set[str]:
    """Words of one longest common subsequence.

    Where two are equally long, the walk back from the ends gives up the last word of ``pred`` first.
    """
    codes = {w: i for i, w in enumerate(dict.fromkeys(pred))}
    other = np.array([codes[w] for w in pred], np.int64)
    lengths = np.zeros((len(ref) + 1, len(pred) + 1), np.int32)
    for i, word in enumerate(ref):
        above = lengths[i]
        # Lengths grow by one at most from left to right, so a running maximum fills the row.
        lengths[i + 1, 1:] = np.maximum.accumulate(np.maximum(above[1:], above[:-1] + (other == codes.get(word, -1))))
    found, i, j = set(), len(ref), len(pred)
    while i and j:
        if ref[i - 1] == pred[j - 1]:
            found.add(ref[i - 1])
            i, j = i - 1, j - 1
        elif lengths[i - 1, j] > lengths[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return found


def _united(a: Column, b: Column) -> Column:
    """Distinct words in the common subsequences of all sentence pairs, of the prediction, and of the reference."""

    def count(preds: pa.Array, refs: pa.Array) -> pa.Array:
        rows = []
        for p, r in zip(preds.to_pylist(), refs.to_pylist()):
            p, r = [s or [] for s in p or []], [s or [] for s in r or []]
            pairs = ((x, y) for x in r for y in p if not set(x).isdisjoint(y))
            rows.append([len(set().union(*(_shared_words(x, y) for x, y in pairs))), len(set().union(*p)), len(set().union(*r))])
        return pa.array(rows, pa.list_(pa.int32()))

    return F.arrow_udf(count, T.ArrayType(T.IntegerType()))(a, b)


def rouge_l_union(df: DataFrame, pred: str = "pred_sentences", ref: str = "ref_sentences") -> DataFrame:
    """``rougelu_{p,r,f}`` from sentences as token arrays: the words of the common subsequences of all sentence pairs, united.

    Each distinct word counts once, in the union and in both texts.
    """
    scored = df.withColumn("_n", _united(F.col(pred), F.col(ref)))
    return _add(scored, "rougelu", *[F.get("_n", F.lit(i)) for i in range(3)]).drop("_n")


def corpus_means(metrics: dict[str, str], keep: Column | None = None) -> list[Column]:
    """Percentage means of score columns, over all pairs or over those to ``keep``."""
    return [
        round_scores(F.avg(F.col(c) if keep is None else F.when(keep, F.col(c)))).alias(name)
        for name, c in metrics.items()
    ]


def not_empty(pred: str = "pred_tokens", ref: str = "ref_tokens") -> Column:
    return (F.size(pred) > 0) & (F.size(ref) > 0)


def rouge_corpus(scores: DataFrame, metrics: dict[str, str], ignore_empty: bool = False) -> DataFrame:
    """One row of corpus scores; ``ignore_empty`` leaves out pairs with an empty side."""
    return scores.agg(*corpus_means(metrics, not_empty() if ignore_empty else None))
