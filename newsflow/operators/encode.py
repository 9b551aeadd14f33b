"""Word-level encoding: vocabulary, ids, truncation, padding, decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsflow.functions import arrays as A
from newsflow.operators.ordering import assign_batches
from newsflow.session import stage

# ---------------------------------------------------------------------------
# Special ids of the word vocabulary.
# ---------------------------------------------------------------------------
PAD_ID = 0
UNKNOWN_ID = 1
FIRST_WORD_ID = 2
# ---------------------------------------------------------------------------

# An encoder vocabulary is a parameter of the model: at most this many words, checked
# before the table is broadcast.
MAX_VOCABULARY = 500_000


def build_vocab(df: DataFrame, tokens: Column, size: int = 30_000) -> DataFrame:
    """``(token, token_id, n)`` of the ``size`` most frequent tokens, ties by token.

    Counts combine map-side. The count at the cut-off comes from a table of counts, and tokens that tie there are narrowed
    by their first letters, so the sort that picks the last ones and the ranking see little more than ``size`` rows.
    """
    if size > MAX_VOCABULARY:
        raise ValueError(f"vocabulary of {size} words, at most {MAX_VOCABULARY} expected")
    counts = stage(df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    order = [F.desc("n"), F.asc("token")]
    cut, room = _cut_off(counts.groupBy("n").agg(F.count(F.lit(1)).alias("rows")), F.desc("n"), "n", size)
    top = counts
    if cut is not None:
        ties = counts.filter(F.col("n") == cut).withColumn("_letters", F.substring("token", 1, 2))
        letters, _ = _cut_off(ties.groupBy("_letters").agg(F.count(F.lit(1)).alias("rows")), F.asc("_letters"), "_letters", room)
        ties = ties if letters is None else ties.filter(F.col("_letters") <= letters)
        top = counts.filter(F.col("n") > cut).unionByName(ties.drop("_letters").orderBy("token").limit(room))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return top.withColumn("token_id", rank + (FIRST_WORD_ID - 1)).select("token", "token_id", "n")


def _cut_off(groups: DataFrame, order: Column, key: str, size: int):
    """The group in ``order`` that holds the ``size``-th row, and how many of its rows are wanted; none if there are fewer rows."""
    before = F.sum("rows").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    at = groups.withColumn("_before", F.coalesce(before, F.lit(0))).filter((F.col("_before") < size) & (F.col("_before") + F.col("rows") >= size))
    row = at.select(key, "_before").first()
    return (None, size) if row is None else (row[0], size - row[1])


def _shipped(vocab: DataFrame) -> Broadcast:
    """The vocabulary on every worker: words and their ids, two Arrow arrays of at most ``MAX_VOCABULARY`` entries."""
    found = vocab.select("token", F.col("token_id").cast("int").alias("token_id")).limit(MAX_VOCABULARY + 1).toArrow()
    if found.num_rows > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY} words")
    words, ids = (found[c].combine_chunks() for c in ("token", "token_id"))
    return vocab.sparkSession.sparkContext.broadcast((words, ids))


def _looked_up(lists: pa.Array, keys: pa.Array, values: pa.Array, default: int | None) -> pa.ListArray:
    """Every element of a list column replaced by its value; without one by the default, or left out. A null list is empty."""
    lists = lists.fill_null(pa.scalar([], lists.type))
    flat = lists.flatten()
    found = pc.take(values, pc.index_in(flat, value_set=keys, skip_nulls=True))
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int32)
    if default is not None:
        return pa.ListArray.from_arrays(ends, pc.fill_null(found, default))
    known = pc.is_valid(found)
    kept = np.concatenate(([0], np.cumsum(known.to_numpy(zero_copy_only=False)))).astype(np.int32)
    return pa.ListArray.from_arrays(kept[ends], found.filter(known))


def _row_local(df: DataFrame, id_col: str, columns: dict[str, Column], kind: T.DataType, convert: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``id_col`` and the converted columns, batch by batch; documents stay where they are."""
    names = list(columns)
    sent = df.select(id_col, *[c.alias(n) for n, c in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch[id_col], *[convert(batch[n]) for n in names]], names=[id_col, *names])

    made = [T.StructField(n, kind) for n in names]
    return sent.mapInArrow(run, T.StructType([sent.schema[id_col], *made]))


def encode_tokens(df: DataFrame, tokens: Column, vocab: DataFrame, id_col: str = "id", out: str = "ids") -> DataFrame:
    """Ids of every token in text order; words outside the vocabulary get the unknown id, no tokens an empty array.

    The vocabulary, whose size is checked, is sent to the workers and its words are looked up inside the row, so nothing is shuffled.
    """
    shipped = _shipped(vocab)
    return _row_local(df, id_col, {out: tokens}, T.ArrayType(T.IntegerType()), lambda x: _looked_up(x, *shipped.value, UNKNOWN_ID))


def encode_pairs(df: DataFrame, first: Column, second: Column, vocab: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids of a sentence pair in one pass over both texts."""
    shipped = _shipped(vocab)
    return _row_local(df, id_col, {"ids1": first, "ids2": second}, T.ArrayType(T.IntegerType()), lambda x: _looked_up(x, *shipped.value, UNKNOWN_ID))


def truncate_pair(df: DataFrame, max_length: int) -> DataFrame:
    """Cut ``ids1`` and ``ids2`` to ``max_length`` together, the longer side first."""
    keep1, keep2 = A.pair_lengths(F.col("ids1"), F.col("ids2"), max_length)
    return df.withColumns({"ids1": F.slice("ids1", F.lit(1), keep1), "ids2": F.slice("ids2", F.lit(1), keep2)})


def pad_batches(
    df: DataFrame, batch_size: int, ids: str = "ids", id_col: str = "id", multiple: int | None = None
) -> DataFrame:
    """Pad to the longest row of each batch, optionally up to a multiple; add the mask.

    A batch holds ``batch_size`` rows, so the window over it is bounded.
    """
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch"))
    length = A.round_up(longest, multiple) if multiple else longest
    return (
        assign_batches(df, batch_size, id_col)
        .withColumn("_length", length)
        .withColumn("attention_mask", A.attention_mask(F.col(ids), F.col("_length")))
        .withColumn("input_ids", A.pad(F.col(ids), F.col("_length"), PAD_ID))
        .drop("_length", ids)
    )


def pad_fixed(df: DataFrame, length: int, ids: str = "ids") -> DataFrame:
    """Cut and pad every row to one length."""
    cut = df.withColumn(ids, A.truncate(F.col(ids), length))
    return cut.withColumns(
        {
            "attention_mask": A.attention_mask(F.col(ids), F.lit(length)),
            "input_ids": A.pad(F.col(ids), F.lit(length), PAD_ID),
        }
    ).drop(ids)


def decode_ids(df: DataFrame, vocab: DataFrame, ids: str = "ids", id_col: str = "id", out: str = "text") -> DataFrame:
    """Ids to space-joined words, skipping padding and unknown ids; row-local as the encoding is."""
    shipped = _shipped(vocab)

    def words(column: pa.Array) -> pa.Array:
        known, numbers = shipped.value
        return pc.binary_join(_looked_up(column, numbers, known, None), " ")

    return _row_local(df, id_col, {out: F.col(ids).cast("array<int>")}, T.StringType(), words)
