"""Sharding by sampled splitters: shards of near equal bytes, with a gapless slot number in each.

Records are ordered by the 64-bit hash of their text, so equal texts are neighbours. A sample in
which a record's chance grows with its size gives quantile boundaries; ranges that turn out
overfull are sampled and cut again. A text that is heavier than half a range, by exact sums per text, is taken
out of the ranges and subdivided by a hash of the id and the record's place in the stored table into pieces, so that rows that repeat in every column are
drawn and dealt one by one as well.

Shards are then filled: groups of heavy texts first, whole where they fit into a shard's even share,
else piece by piece, each to the emptiest shard; the ranges, in order, fill what is left, and are cut
exactly between the two texts nearest to each shard's end. So equal texts share a shard unless they alone
exceed the room of one, and shards differ by less than the largest text group that is not heavy.

The driver holds boundaries and totals of ranges only, about ``total bytes / range_bytes`` numbers. Keys and kept columns are
stored once, read by plan and placement alike; records then move once, by range, to be numbered. Reruns over the same files give the same shards and slots.

Defined results: a null text weighs 1 byte and its checksum is null, and it is a text like any other; repeated rows get slots of
their own; an empty table gives no rows. Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.llm.common import prepare, query, stage, table, without

SHARDS = 8
#: Ranges per shard at least, and bytes that a range may have before there are more of them.
RANGES = 64
RANGE_BYTES = 256 << 20
#: Expected sampled records per range.
DRAWS = 32
LAW = "bytes"


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text and one more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _keyed(df: DataFrame, doc_id: str, text: str) -> list[Column]:
    return [
        F.xxhash64(F.col(text)).alias("key"),
        F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.monotonically_increasing_id(), F.lit("tie")).alias("tie"),
        size_of(F.col(text)).alias("size"),
    ]


class Layout:
    """Where a record goes: leaf ranges of the light keys, pieces of the heavy ones, and what follows from them."""

    def __init__(self, bounds: np.ndarray, heavy: list[tuple[int, int]], limit: int):
        self.bounds = bounds
        heavy = sorted(heavy)
        self.heavy = np.array([k for k, _ in heavy], np.int64)
        self.weight = np.array([w for _, w in heavy], np.int64)
        self.pieces = np.maximum(1, -(-self.weight // limit))
        self.first = len(bounds) + 1 + np.cumsum(self.pieces) - self.pieces
        self.n = len(bounds) + 1 + int(self.pieces.sum())
        self.shard, self.offset = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)

    def leaf(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.bounds, key, "right")
        if len(self.heavy):
            h = np.minimum(np.searchsorted(self.heavy, key), len(self.heavy) - 1)
            piece = (tie.view(np.uint64) % self.pieces[h].astype(np.uint64)).astype(np.int64)
            at = np.where(self.heavy[h] == key, self.first[h] + piece, at)
        return at


def _leaf(layout) -> Column:
    """Column function of (key, tie) that gives leaf, shard and the slot before the leaf's first."""

    @F.pandas_udf("leaf long, shard int, offset long")
    def place(key: pd.Series, tie: pd.Series) -> pd.DataFrame:
        known = layout.value
        leaf = known.leaf(key.to_numpy(np.int64), tie.to_numpy(np.int64))
        return pd.DataFrame({"leaf": leaf, "shard": known.shard[leaf].astype(np.int32), "offset": known.offset[leaf]})

    return place(F.col("key"), F.col("tie"))


def _sample(rows: DataFrame, limit: int) -> DataFrame:
    """Keys drawn in proportion to size, ``DRAWS`` expected per ``limit`` bytes, by a hash of the record."""
    expected = F.col("size") * F.lit(DRAWS / limit)
    u = F.pmod(F.xxhash64("key", "tie", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    times = F.floor(expected) + (u < expected - F.floor(expected)).cast("long")
    return rows.withColumn("times", times).filter("times > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("k", "times")


def _totals(rows: DataFrame, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows of every leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(layout)
    size, count = np.zeros(layout.n, np.int64), np.zeros(layout.n, np.int64)
    for leaf, s, c in rows.select(_leaf(shared)["leaf"].alias("leaf"), "size").groupBy("leaf").agg(F.sum("size"), F.count(F.lit(1))).collect():
        size[leaf], count[leaf] = s, c
    return size, count


def _cut(rows: DataFrame, layout: Layout, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For ``(leaf, bytes)``: the key at which the leaf is cut nearest to these bytes, and the cut's number."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(layout)
    marks = spark.createDataFrame([(leaf, x, i) for i, (leaf, x) in enumerate(cuts)], "leaf long, x long, cut int")
    own = rows.withColumn("leaf", _leaf(shared)["leaf"]).filter(F.col("leaf").isin([leaf for leaf, _ in cuts]))
    sums = own.groupBy("leaf", "key").agg(F.sum("size").alias("size"))
    ends = sums.withColumn("stop", F.sum("size").over(Window.partitionBy("leaf").orderBy("key")))
    over = ends.join(F.broadcast(marks), "leaf").filter("stop > x AND stop - size <= x")
    at = F.when(F.col("x") - (F.col("stop") - F.col("size")) <= F.col("stop") - F.col("x"), F.col("key")).otherwise(F.col("key") + 1)
    top = np.iinfo(np.int64).max
    return [(r[0], r[1]) for r in over.select("cut", F.when(F.col("key") < F.lit(int(top)), at).otherwise(F.col("key"))).collect()]


def plan(rows: DataFrame, shards: int, ranges: int = RANGES, range_bytes: int = RANGE_BYTES) -> Layout:
    """The layout of stored ``rows`` (key, tie, size)."""
    total, n_rows = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    total = total or 0
    limit = max(1, min(-(-total // (ranges * shards)), range_bytes))
    drawn = stage(_sample(rows, limit), "sample")
    # Sums combine map-side; at most two heavy texts per range exist.
    heavy = [tuple(r) for r in rows.groupBy("key").agg(F.sum("size").alias("w")).filter(F.col("w") * 2 >= limit).collect()]
    pieces = max(1, -(-total // limit))
    first = min(pieces, 512)
    light = drawn
    if heavy:
        names = rows.sparkSession.createDataFrame([(k,) for k, _ in heavy], "key long")
        light = drawn.join(names, "key", "left_anti")
    bounds = _quantiles(light, first)
    layout = Layout(bounds, heavy, limit)
    size, _ = _totals(rows, layout)
    while True:
        full = [i for i in range(len(layout.bounds) + 1) if size[i] > 2 * limit]
        shared = rows.sparkSession.sparkContext.broadcast(layout)
        if not full:
            break
        # Overfull ranges are cut again, each by the quantiles of the sample inside it.
        parts = rows.sparkSession.createDataFrame([(i, int(min(512, -(-size[i] // limit)))) for i in full], "leaf long, n int")
        inside = light.withColumn("leaf", _leaf(shared)["leaf"]).join(F.broadcast(parts), "leaf")
        found = []
        for n, own in sorted({n: None for n in (int(min(512, -(-size[i] // limit))) for i in full)}.items()):
            steps = F.array(*[F.lit(k / n) for k in range(1, n)])
            for r in inside.filter(F.col("n") == n).groupBy("leaf").agg(F.percentile_approx("key", steps, 10000)).collect():
                found += r[1]
        more = np.unique(np.concatenate((layout.bounds, np.array(found, np.int64))))
        if len(more) == len(layout.bounds):
            break
        layout = Layout(more, heavy, limit)
        size, _ = _totals(rows, layout)
    return _filled(rows, layout, size, total, shards, limit)


def _quantiles(drawn: DataFrame, n: int) -> np.ndarray:
    if n < 2:
        return np.zeros(0, np.int64)
    steps = F.array(*[F.lit(k / n) for k in range(1, n)])
    found = drawn.agg(F.percentile_approx("key", steps, 10000)).first()[0]
    return np.unique(np.array(found or [], np.int64))


def _filled(rows: DataFrame, layout: Layout, size: np.ndarray, total: int, shards: int, limit: int) -> Layout:
    """Give heavy groups and cut ranges to shards, then number the rows before every leaf."""
    load = np.zeros(shards, np.int64)
    share = -(-total // shards)
    chosen: dict[int, int] = {}
    for h in np.lexsort((layout.heavy, -layout.weight)).tolist():
        own = range(int(layout.first[h]), int(layout.first[h] + layout.pieces[h]))
        s = int(np.argmin(load))
        whole = load[s] + layout.weight[h] <= share
        for leaf in own:
            s = s if whole else int(np.argmin(load))
            chosen[leaf - layout.n] = s
            load[s] += size[leaf]
    n_light = len(layout.bounds) + 1
    ends = np.cumsum(size[:n_light])
    room = np.maximum(0, share - load).astype(np.float64)
    stops = np.cumsum(room / max(1.0, room.sum()) * (ends[-1] if len(ends) else 0))[:-1].astype(np.int64)
    cuts = [(int(r := np.searchsorted(ends, x, "right")), int(x - (ends[r] - size[r]))) for x in stops if x < ends[-1]]
    keys = dict(_cut(rows, layout, cuts)) if cuts else {}
    bounds = np.unique(np.concatenate((layout.bounds, np.array(list(keys.values()), np.int64))))
    done = Layout(bounds, list(zip(layout.heavy.tolist(), layout.weight.tolist())), limit)
    # A shard without room ends where the one before it ends, and so gets no range.
    firsts = np.concatenate(([np.iinfo(np.int64).min], bounds))
    done.shard[: len(firsts)] = np.searchsorted(np.sort(np.array(list(keys.values()), np.int64)), firsts, "right")
    for back, s in chosen.items():
        done.shard[done.n + back] = s
    _, count = _totals(rows, done)
    for s in range(shards):
        own = np.flatnonzero(done.shard == s)
        done.offset[own] = np.cumsum(count[own]) - count[own]
    return done


def shard(
    docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
    ranges: int = RANGES, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """The ``keep`` columns (all, if None) with ``size``, ``shard`` and ``slot``."""
    prepare(docs.sparkSession)
    columns = without(docs.select(keep) if keep is not None else docs, "size", "shard", "slot")
    own = stage(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(doc_id).alias("own_id"), *_keyed(docs, doc_id, text)), "keys")
    layout = plan(own.select("key", "tie", "size"), shards, ranges, range_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(layout)
    placed = own.withColumn("at", _leaf(shared))
    number = F.row_number().over(Window.partitionBy("leaf").orderBy("key", "own_id", "tie"))
    placed = placed.select("*", F.col("at.leaf").alias("leaf"), F.col("at.shard").alias("shard"), F.col("at.offset").alias("offset"))
    return placed.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "size", "shard", (F.col("offset") + number - 1).cast("long").alias("slot")
    )


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.col("text").cast("binary")))
    return shard(docs, keep=["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
