"""Joins of a large fact table to a keyed table, safe under key skew.

The keyed side has one row per key and is stored, so its size in bytes is known. Up to
``MAX_BROADCAST_BYTES`` it is broadcast and the facts do not move. Beyond that:

* hot keys are found in the facts themselves, by a count that combines map-side. A key is hot above
  one in ``HOT_KEYS`` of all facts, so there are fewer than that, whether the keyed side has them or not;
* facts of hot keys are joined map-side, in a branch that never meets the shuffle;
* only the other facts meet the keyed side by shuffle; none of their keys can fill a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.session import stage

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 << 20
HOT_KEYS = 1_000


def sized(table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark a dimension for broadcast if it really is small, else leave the join to Spark."""
    return F.broadcast(table) if table.limit(max_rows + 1).count() <= max_rows else table


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the files that a stored table reads."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lookup_join(facts: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of ``facts`` to the stored ``table`` on ``key``; adds its other columns."""
    values = [c for c in table.columns if c != key]
    if stored_bytes(table) <= MAX_BROADCAST_BYTES:
        return facts.join(F.broadcast(table), key, "left").select(*facts.columns, *values)
    # Read three times below.
    facts = stage(facts, "facts")
    counts = stage(facts.groupBy(key).agg(F.count(F.lit(1)).alias("_uses")), "uses")
    total = counts.agg(F.sum("_uses")).first()[0] or 0
    often = counts.filter(F.col("_uses") > F.lit(total / HOT_KEYS)).select(key)
    hot = stage(often.join(table, key, "left"), "hot-keys")
    joined = facts.join(F.broadcast(hot), key)
    rare = facts.filter(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti")
    cold = rare.join(table, key, "left")
    # Null keys have no partner and stay out of the shuffle too.
    nothing = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in values]
    parts = [joined.select(*facts.columns, *values), facts.filter(F.col(key).isNull()).select("*", *nothing)]
    return parts[0].unionByName(cold.select(*facts.columns, *values)).unionByName(parts[1])
