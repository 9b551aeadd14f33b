"""Extractive summaries: sentence candidates, scores and selection strategies.

A candidate is one sentence of one article: ``(id, pos, sentence, score)``. All
windows are partitioned by article, whose size is bounded by one text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsflow.functions import text as X
from newsflow.operators import lookup
from newsflow.operators.features import svm_tokens

SCORE_DIGITS = 6


def sentence_table(df: DataFrame, text: str = "maintext", id_col: str = "id") -> DataFrame:
    """``(id, pos, sentence)``, positions from 0."""
    return df.select(id_col, F.posexplode(X.sentences(F.col(text))).alias("pos", "sentence"))


def _scorer(terms: pa.Array, idf: np.ndarray, spark: SparkSession) -> Callable[[Column], Column]:
    """Scores of an article's sentences from their tokens, an array of arrays; the terms are sent to the workers once."""
    model = spark.sparkContext.broadcast((terms, idf))

    def score(tokens: pa.Array) -> pa.Array:
        terms, idf = model.value
        outer = tokens.fill_null(pa.scalar([], tokens.type))
        inner = outer.flatten()
        lengths = lambda lists: pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        per_article = lengths(outer)
        article = np.repeat(np.arange(len(outer)), per_article)
        sentence = np.repeat(np.arange(len(inner)), lengths(inner))
        term = pc.fill_null(pc.index_in(inner.flatten(), value_set=terms), -1).to_numpy()
        sentence, term = sentence[term >= 0], term[term >= 0]
        owner = article[sentence]
        # Uses of a token's term in its article.
        _, at, uses = np.unique(owner * np.int64(len(idf) + 1) + term, return_inverse=True, return_counts=True)
        raw = uses[at] * idf[term]
        known = np.bincount(sentence, minlength=len(inner))
        norm = np.sqrt(np.bincount(owner, raw * idf[term], len(outer)))[article]
        sums = np.bincount(sentence, raw, len(inner))
        scores = np.divide(sums, known * norm, out=np.zeros(len(inner)), where=known > 0)
        return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(per_article))).astype(np.int32), pa.array(scores))

    return F.arrow_udf(score, T.ArrayType(T.DoubleType()))


def score_sentences(
    df: DataFrame, model: DataFrame, stopwords: Sequence[str] = (), text: str = "maintext", id_col: str = "id"
) -> DataFrame:
    """Candidates scored by the mean TF-IDF weight of their tokens; no known token scores 0.

    A term's idf up to ``MAX_BROADCAST_BYTES`` of model is looked up inside the article's row: the tokens of all its sentences give the uses
    of every term, the norm and all scores at once, so neither texts nor terms move. A larger model is met by a join of term rows.
    """
    if lookup.stored_bytes(model) > lookup.MAX_BROADCAST_BYTES:
        return _score_by_join(df, model, stopwords, text, id_col)
    found = model.select("term", "idf").toArrow().combine_chunks()
    score = _scorer(found["term"].combine_chunks(), found["idf"].to_numpy(), df.sparkSession)
    cut = df.select(id_col, X.sentences(F.col(text)).alias("sentence"))
    tokens = cut.withColumn("_tokens", F.transform("sentence", lambda s: svm_tokens(s, stopwords)))
    scored = tokens.withColumn("_score", score(F.col("_tokens")))
    entries = F.posexplode(F.arrays_zip("sentence", "_score")).alias("pos", "_one")
    return scored.select(id_col, entries).select(
        id_col, "pos", F.col("_one")["sentence"].alias("sentence"), F.round(F.col("_one")["_score"], SCORE_DIGITS).alias("score")
    )


def _score_by_join(df: DataFrame, model: DataFrame, stopwords: Sequence[str], text: str, id_col: str) -> DataFrame:
    """The same scores for a model of any size.

    With ``c`` uses of a term in a sentence and ``tf`` in the article, a sentence sums ``c * tf * idf`` and the squared norm of the
    article is the sum of ``c * tf * idf^2`` over all its sentences, so one pass over the term rows gives both.
    """
    sentences = sentence_table(df.select(id_col, text).repartition(id_col), text, id_col)
    tokens = sentences.select(id_col, "pos", F.explode(svm_tokens(F.col("sentence"), stopwords)).alias("term"))
    counts = tokens.groupBy(id_col, "term", "pos").agg(F.count(F.lit(1)).alias("c"))
    with_tf = counts.withColumn("tf", F.sum("c").over(Window.partitionBy(id_col, "term")))
    known = lookup.lookup_join(with_tf, model.drop("df"), "term").filter(F.col("idf").isNotNull())
    raw = F.col("c") * F.col("tf") * F.col("idf")
    sums = known.groupBy(id_col, "pos").agg(
        F.sum(raw).alias("_raw"), F.sum("c").alias("_tokens"), F.sum(raw * F.col("idf")).alias("_square")
    )
    norm = F.sqrt(F.sum("_square").over(Window.partitionBy(id_col)))
    scores = sums.select(
        id_col, "pos", F.round(F.col("_raw") / F.col("_tokens") / norm, SCORE_DIGITS).alias("score")
    )
    return sentences.join(scores, [id_col, "pos"], "left").withColumn("score", F.coalesce(F.col("score"), F.lit(0.0)))


def _best_first(id_col: str):
    return Window.partitionBy(id_col).orderBy(F.desc("score"), F.asc("pos"))


def rank_candidates(candidates: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``rank`` from 1 by score, ties by position."""
    return candidates.withColumn("rank", F.row_number().over(_best_first(id_col)))


def extractive_summary(candidates: DataFrame, k: int = 3, id_col: str = "id", articles: DataFrame | None = None) -> DataFrame:
    """``(id, summary)``: the ``k`` best sentences in text order.

    With ``articles``, one without a sentence gets an empty summary.
    """
    best = join_sentences(rank_candidates(candidates, id_col).filter(F.col("rank") <= k), id_col)
    if articles is None:
        return best
    return articles.select(id_col).join(best, id_col, "left").select(id_col, F.coalesce("summary", F.lit("")).alias("summary"))


def join_sentences(chosen: DataFrame, id_col: str = "id") -> DataFrame:
    entry = F.collect_list(F.struct("pos", "sentence"))
    return chosen.groupBy(id_col).agg(F.array_join(F.sort_array(entry)["sentence"], " ").alias("summary"))


def lead_summary(df: DataFrame, k: int = 3, text: str = "maintext", id_col: str = "id") -> DataFrame:
    """``(id, summary)``: the first ``k`` sentences; row-local, nothing is shuffled."""
    return df.select(id_col, F.array_join(F.slice(X.sentences(F.col(text)), 1, k), " ").alias("summary"))


def select_greedy(candidates: DataFrame, id_col: str = "id") -> DataFrame:
    return rank_candidates(candidates, id_col).filter(F.col("rank") == 1)


def select_top_k(candidates: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    return rank_candidates(candidates, id_col).filter(F.col("rank") <= k)


def temperature_weights(candidates: DataFrame, temperature: float | Column = 1.0, id_col: str = "id") -> DataFrame:
    """Add ``weight``: softmax of ``score / temperature`` per article."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    group = Window.partitionBy(id_col)
    raised = candidates.withColumn("_raised", F.exp((F.col("score") - F.max("score").over(group)) / t))
    return raised.withColumn("weight", F.col("_raised") / F.sum("_raised").over(group)).drop("_raised")


def select_top_p(candidates: DataFrame, p: float, temperature: float = 1.0, id_col: str = "id") -> DataFrame:
    """Smallest best-first set whose probability mass reaches ``p``."""
    weighted = rank_candidates(temperature_weights(candidates, temperature, id_col), id_col)
    before = F.sum("weight").over(
        Window.partitionBy(id_col).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    )
    return weighted.withColumn("_before", F.coalesce(before, F.lit(0.0))).filter(F.col("_before") < p).drop("_before")


def uniform_draw(seed: int, key: Column) -> Column:
    """Deterministic number in [0, 1) of a row key."""
    return F.conv(F.substring(X.seeded_hash(seed, key), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def sample_candidate(weighted: DataFrame, seed: int = 42, id_col: str = "id") -> DataFrame:
    """One seeded draw per article from ``weight`` (rescaled), best first.

    Takes the first candidate whose cumulative weight reaches the draw.
    """
    group = Window.partitionBy(id_col)
    upto = group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulative = F.sum("weight").over(upto) / F.sum("weight").over(group)
    below = F.when(F.col("_cum") < uniform_draw(seed, F.col(id_col)), 1).otherwise(0)
    return (
        rank_candidates(weighted, id_col)
        .withColumn("_cum", cumulative)
        .withColumn("_pick", F.least(F.sum(below).over(group) + 1, F.max("rank").over(group)))
        .filter(F.col("rank") == F.col("_pick"))
        .drop("_cum", "_pick")
    )


def _kept(n: int) -> Callable[[Column], Column]:
    """Which sentences stay, from their words in rank order. One set of n-grams per article, so time is linear in its words."""

    def decide(words: pa.Array) -> pa.Array:
        decided = []
        for sentences in words.to_pylist():
            seen: set[tuple[str, ...]] = set()
            flags = []
            for own in sentences:
                grams = list(zip(*(own[i:] for i in range(n))))
                new = set(grams)
                fits = len(new) == len(grams) and seen.isdisjoint(new)
                if fits:
                    seen |= new
                flags.append(fits)
            decided.append(flags)
        return pa.array(decided, pa.list_(pa.bool_()))

    return F.arrow_udf(decide, T.ArrayType(T.BooleanType()))


def block_repeat_ngrams(candidates: DataFrame, n: int = 2, id_col: str = "id") -> DataFrame:
    """Drop sentences that would repeat an n-gram in the text made of the sentences kept before, best first.

    A sentence that repeats an n-gram in itself goes too; one that goes blocks nothing. Decided in rank order over one array per article.
    """
    columns = [c for c in candidates.columns if c != id_col]
    best = F.struct((-F.col("score")).alias("_order"), "pos", F.struct(*columns).alias("_row"))
    grouped = candidates.groupBy(id_col).agg(F.sort_array(F.collect_list(best))["_row"].alias("_all"))
    words = grouped.withColumn("_words", F.transform("_all", lambda s: X.words(s["sentence"])))
    decided = words.withColumn("_fits", _kept(n)(F.col("_words")))
    marked = F.posexplode(F.arrays_zip("_all", "_fits")).alias("_place", "_one")
    chosen = decided.select(id_col, marked).filter(F.col("_one")["_fits"])
    return chosen.select(id_col, *[F.col("_one")["_all"][c].alias(c) for c in columns], (F.col("_place") + 1).alias("rank"))


def _picks(runs: Sequence[tuple[str, float, int | None, float | None]]) -> Callable[[Column, Column], Column]:
    """Which candidate each run takes, from an article's scores, best first, and one number in [0, 1) per run."""
    settings = [(float(t), k, p) for _, t, k, p in runs]

    def pick(scores: pa.Array, draws: pa.Array) -> pa.Array:
        found = np.zeros((len(scores), len(settings)), np.int32)
        values, ends = scores.flatten().to_numpy(), scores.offsets.to_numpy() - scores.offsets[0].as_py()
        numbers = draws.flatten().to_numpy().reshape(len(draws), len(settings))
        for i in range(len(scores)):
            own = values[ends[i] : ends[i + 1]]
            own = own - own[0]
            for j, (t, k, p) in enumerate(settings):
                weight = np.exp(own[:k] / t)
                if p is not None:
                    # The smallest best-first set whose mass reaches p.
                    mass = np.cumsum(weight) / weight.sum()
                    weight = weight[: 1 + np.searchsorted(mass[:-1], p, "left")]
                upto = np.cumsum(weight)
                found[i, j] = min(np.searchsorted(upto / upto[-1], numbers[i, j], "left"), len(weight) - 1)
        return pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(settings), dtype=np.int32), pa.array(found.ravel()))

    return F.arrow_udf(pick, T.ArrayType(T.IntegerType()))


def decoding_runs(candidates: DataFrame, runs: Sequence[tuple[str, float, int | None, float | None]],
                  seed: int = 42, id_col: str = "id") -> DataFrame:
    """One chosen sentence per article and run: ``(id, run, pos, sentence, score)``.

    A run is ``(name, temperature, top_k, top_p)``; top_k 1 is greedy. An article is one row: its scores are sorted once, each run is a search
    in their running sums, and only the chosen sentences are taken out.
    """
    best = F.struct((-F.col("score")).alias("_order"), "pos", "sentence", "score")
    grouped = candidates.groupBy(id_col).agg(F.sort_array(F.collect_list(best)).alias("_all"))
    draws = F.array(*[uniform_draw(seed, F.concat_ws(":", F.lit(name), F.col(id_col).cast("string"))) for name, *_ in runs])
    picked = grouped.withColumn("_picks", _picks(runs)(F.col("_all")["score"], draws))
    names = F.array(*[F.lit(name) for name, *_ in runs])
    taken = F.zip_with(names, "_picks", lambda run, at: F.struct(run.alias("run"), F.get("_all", at).alias("_one")))
    return picked.select(id_col, F.inline(taken)).select(id_col, "run", "_one.pos", "_one.sentence", "_one.score")
