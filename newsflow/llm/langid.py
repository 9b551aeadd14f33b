"""Language identification by rank-order n-gram profiles.

A language's profile is its ``PROFILE`` most frequent letter n-grams (one to three
letters, with the word edge as a letter) by rank. A document's own most frequent n-grams
are ranked the same way; the sum of how far each one is out of place in a language's
profile, with the profile length for a missing one, is the distance to that language.
The nearest language wins. Grams of equal count share their mean rank, so that short texts, in
which nearly all counts are equal, don't depend on an arbitrary order.

Profiles come from at most about ``TRAIN_DOCS`` labelled documents of each language, taken by a hash of
their id (the bound is the parameter ``train_docs``; whole texts are counted). They hold
``PROFILE`` rows per language, which bounds what the tasks get.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and if
nothing was learned; the score is one minus the distance scaled to 0..1; of equally near languages the first by code
point. Repeated rows are judged one by one. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.llm.common import Batches, held_out, prepare, query, rows_to_batch, schema_with, stage, table, without

PROFILE = 600
TRAIN_DOCS = 20_000
UNKNOWN = "und"
FOLDS = 4
#: Grams that a training task gathers before it adds up equal ones.
GATHER = 2_000_000
#: Letters of a text that are turned into grams at once.
LETTERS = 1 << 20
_BITS = 21


@functools.cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 1- to 3-grams of the text's letters and their counts; none without a letter."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.concatenate(([1], np.where(_letters()[points], points, 1), [1]))
    # Runs of other characters are one word edge.
    points = points[np.concatenate(([True], (points[1:] != 1) | (points[:-1] != 1)))]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = []
    for k in range(0, len(points), LETTERS):
        p = points[k:k + LETTERS + 2]
        one = p[:LETTERS]
        two = (p[:-1] << _BITS | p[1:])[:LETTERS]
        three = (p[:-2] << 2 * _BITS | p[1:-1] << _BITS | p[2:])[:LETTERS]
        parts.append(np.unique(np.concatenate((one[one != 1], two, three)), return_counts=True))
    return parts[0] if len(parts) == 1 else merged(parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Mean rank from 0 by falling count."""
    _, at, size = np.unique(-counts, return_inverse=True, return_counts=True)
    first = np.cumsum(size) - size
    return (first + (size - 1) / 2)[at]


class Profiles:
    """All languages' ranks as one matrix: a row per gram, a column per language, NaN where a profile lacks it."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.array(sorted({r[1] for r in rows}), np.int64)
        self.rank = np.full((len(self.codes), len(self.langs)), np.nan)
        for k, lang in enumerate(self.langs):
            own = [r for r in rows if r[0] == lang]
            at = np.searchsorted(self.codes, [r[1] for r in own])
            self.rank[at, k] = ranks(np.array([r[2] for r in own]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        if len(codes) > self.size:
            # All grams that are as frequent as the last of the first ones stay: no arbitrary choice among equals.
            least = np.partition(counts, -self.size)[-self.size]
            codes, counts = codes[counts >= least], counts[counts >= least]
        own = np.minimum(ranks(counts), self.size)
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        seen = self.codes[at] == codes
        out_of_place = np.abs(self.rank[at[seen]] - own[seen, None])
        total = np.where(np.isnan(out_of_place), self.size, np.minimum(out_of_place, self.size)).sum(axis=0)
        total += self.size * float((~seen).sum())
        distance = total / (self.size * len(codes))
        best = int(np.argmin(distance))
        return self.langs[best], float(1.0 - distance[best])


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", size: int = PROFILE, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``(lang, code, n)``: the most frequent grams of each non-null language of ``docs``."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).cast("string").alias("key"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    # Stored, so that its size is known before the join and the texts stay where they are.
    share = stage(rows.groupBy("lang").count().select("lang", (F.lit(float(train_docs)) / F.col("count")).alias("share")), "languages")
    drawn = F.pmod(F.xxhash64(F.coalesce("key", F.lit("")), F.lit("profile")), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.join(share, "lang").filter(drawn < F.col("share")).select("lang", "text")

    def count(batches: Batches) -> Batches:
        held: dict[str, list] = {}
        size = 0

        def out():
            for name, parts in held.items():
                codes, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = held.setdefault(name, [])
                parts.append(gram_counts(body))
                size += len(parts[-1][0])
            if size > GATHER:
                held = {name: [merged(parts)] for name, parts in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > GATHER // 2:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    counts = taken.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return counts.withColumn("place", place).filter(F.col("place") <= size).select("lang", "code", "n")


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = PROFILE) -> DataFrame:
    """The ``keep`` columns (all, if None) with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    prepare(spark)
    columns = without(docs.select(keep) if keep is not None else docs, "lang_pred", "score")
    df = docs.select(*columns, *([] if text in columns else [text]))
    # ``size`` rows per language.
    known = spark.sparkContext.broadcast(Profiles([tuple(r) for r in profiles.select("lang", "code", "n").collect()], size))

    def run(batches: Batches) -> Batches:
        model = known.value
        for batch in batches:
            found = [model.nearest(x) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield rows_to_batch(batch, columns, {
                "lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64()),
            })

    return df.mapInArrow(run, schema_with(df, columns, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())))


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` without texts that have no letter or share no gram with any language learned from them; if none was, all texts with a letter."""
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    lower = [c.lower() for c in docs.columns]
    profiles = stage(learn(docs, text, lang, key, train_docs=train_docs), "profiles")
    body = f"c{lower.index(text.lower())}"
    if profiles.isEmpty():
        def lettered(batches: Batches) -> Batches:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(body)).to_pylist()
                yield batch.filter(pa.array([bool(x) and len(gram_counts(x)[0]) > 0 for x in texts], pa.bool_()))

        return own.mapInArrow(lettered, own.schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
    found = identify(own, profiles, body).filter(f"lang_pred <> '{UNKNOWN}' AND score > 0")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), FOLDS))
    profiles = stage(learn(docs.filter(~F.col("held_out"))), "profiles")
    return identify(docs, profiles, keep=["doc_id", "held_out"])
