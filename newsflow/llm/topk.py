"""Exact top-k search by inner product as a Voronoi join of a query set with all vectors.

Vectors and queries are grouped by their nearest pivot. Along a pivot's direction a vector splits into a part ``b`` on that line
and a part of length ``h`` off it; with ``alpha`` and ``beta`` for a query, every inner product lies in
``alpha * b - beta * h .. alpha * b + beta * h``. Two kinds of summaries follow:

* for a query, a floor: its k-th best score among the witnesses (sampled rows, scored exactly) or, if higher, among the lower bounds of whole
  shells (the vectors of a cell at about one distance from its pivot; a shell has the ranges of ``b`` and ``h`` and its number of vectors);
* for a group of queries (neighbouring cells, up to ``GROUP_BYTES`` of queries), the ranges of ``alpha`` and ``beta`` to every pivot, and its lowest floor.

A vector goes to a group of queries only if the group's bound on their scores reaches the floor. Copies of one group are
dealt into pieces of ``PIECE_BYTES``, so that neither a popular cell nor a popular vector fills a task; each piece meets its group's queries,
is searched cell by cell under every query's own bound, and gives at most k rows per query. The k best over all pieces are the result.

The bounds only save work. Scores are whole numbers, computed without rounding, and no vector whose bound ties with a floor is left out.

Bounds in size: at most ``PIVOTS`` pivots and ``WITNESSES`` witnesses are sampled and broadcast, with some dozens of shells per pivot.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part, neither as query nor as candidate; an empty vector is a
vector of zeros, and a shorter one counts as padded with zeros; a query's own row is no candidate, another row with the same id is one; ties go
to the smaller id, null ids last, equal ids in any order of their rows; a null id is no query; an empty table, or one without queries, gives no rows; a score that doesn't
fit a long is an error. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.llm.common import prepare, query, stage, table
from newsflow.operators.lookup import lookup_join

SCALE, EVERY, K = 1024, 100, 10
#: Sampled rows that are scored against every query, and those among them that are pivots.
WITNESSES, PIVOTS = 2_048, 512
#: Components, as doubles, of the queries of a group and of the vectors of a piece; a piece that is small anyway has so many rows at least.
GROUP_BYTES, PIECE_BYTES, LEAST_ROWS = 16 << 20, 32 << 20, 1_024
#: Shells per doubling of the distance.
SHELLS = 4
#: Queries and vectors that meet in one product.
TILE = 1_024
#: Whole numbers up to here are exact in doubles.
_EXACT = float(1 << 53)
_NO_ID = np.iinfo(np.int64).max


def whole(vector: Column, scale: int = SCALE) -> Column:
    """Components as whole numbers ``floor(scale * x)``, kept as doubles; null unless all are finite."""
    wide = F.transform(vector, lambda x: x.cast("double") * scale)
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # Doubles from 2^53 on are whole numbers already.
    return F.when(sound, F.transform(wide, lambda x: F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)))


# --- geometry in numpy ---------------------------------------------------------


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` doubles, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def scores(q: np.ndarray, x: np.ndarray, small: bool) -> np.ndarray:
    """Inner products without rounding; ``small`` if no sum leaves the whole numbers that doubles hold."""
    if small:
        return (q @ x.T).astype(np.int64)
    exact = _integers(q) @ _integers(x).T
    if any(abs(v) >= 1 << 63 for v in exact.flat):
        raise ValueError("an inner product doesn't fit a long")
    return exact.astype(np.int64)


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.flat], object).reshape(x.shape)


def _small(q: np.ndarray, x: np.ndarray) -> bool:
    return bool(np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < _EXACT)


class Space:
    """Pivots, witnesses and the summaries of all cells; small enough to be sent to every task."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, pivots: int, k: int):
        self.k, self.witness_rows, self.witnesses = k, rows, vectors
        distinct = vectors[np.sort(np.unique(vectors, axis=0, return_index=True)[1])] if len(vectors) else vectors
        self.pivots = distinct[:pivots]
        self.norms = np.sqrt((self.pivots**2).sum(1))
        self.axes = self.pivots / np.where(self.norms > 0, self.norms, 1)[:, None]
        #: Of each shell: cell, lowest and highest b, highest h, vectors. Of each cell: the first three over its shells.
        self.shells, self.boxes, self.reach = np.zeros((0, 5)), np.zeros((len(self.pivots), 3)), 0.0

    def summarize(self, shells: np.ndarray) -> None:
        cell = shells[:, 0].astype(np.int64)
        self.shells, self.boxes = shells, np.tile([np.inf, -np.inf, 0.0], (len(self.pivots), 1))
        np.minimum.at(self.boxes[:, 0], cell, shells[:, 1])
        np.maximum.at(self.boxes[:, 1], cell, shells[:, 2])
        np.maximum.at(self.boxes[:, 2], cell, shells[:, 3])
        self.reach = float(np.hypot(np.abs(shells[:, 1:3]).max(1, initial=0), shells[:, 3]).max(initial=0))

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts on and off every pivot's line."""
        along = x @ self.axes.T
        return along, np.sqrt(np.maximum((x**2).sum(1)[:, None] - along**2, 0))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot of every row, with b and h to it."""
        along, off = self.split(x)
        cell = np.argmin(self.norms[None, :] ** 2 - 2 * along * self.norms[None, :], axis=1)
        at = np.arange(len(x))
        return cell, along[at, cell], off[at, cell]

    def slack(self, q: np.ndarray, x_size: float) -> np.ndarray:
        """Room for the rounding of the bounds."""
        return 1e-6 * (1 + np.sqrt((q**2).sum(1)) * x_size)

    def floors(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """A score that the k-th best candidate of each query reaches at least; minus infinity if unknown."""
        found = np.full(len(q), -np.inf)
        cell, low, high, far, n = self.shells.T
        cell = cell.astype(np.int64)
        small = _small(q, self.witnesses)
        for i in range(0, len(q), TILE):
            own = slice(i, i + TILE)
            s = scores(q[own], self.witnesses, small).astype(np.float64)
            # A query is no candidate of its own.
            s[rows[own, None] == self.witness_rows[None, :]] = -np.inf
            if s.shape[1] >= self.k:
                found[own] = -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1]
            along, off = self.split(q[own])
            least = np.minimum(along[:, cell] * low, along[:, cell] * high) - off[:, cell] * far
            order = np.argsort(-least, axis=1)
            # One more than k, because the query itself may be in a shell.
            enough = np.cumsum(n[order], axis=1) > self.k
            at = np.take_along_axis(order, np.argmax(enough, axis=1)[:, None], 1) if enough.shape[1] else None
            if at is not None:
                bound = np.take_along_axis(least, at, 1)[:, 0] - self.slack(q[own], self.reach)
                found[own] = np.where(enough.any(1) & (bound > found[own]), bound, found[own])
        return found


def search(q: np.ndarray, floors: np.ndarray, own_rows: np.ndarray, x: np.ndarray, x_rows: np.ndarray, x_ids: np.ndarray, x_cells: np.ndarray, space: Space, k: int):
    """(query number, score, candidate number) of the k best of a piece for every query, by cell under each query's bound."""
    order = np.lexsort((x_rows, x_ids, x_cells))
    x, x_rows, x_ids, x_cells = x[order], x_rows[order], x_ids[order], x_cells[order]
    starts = np.flatnonzero(np.r_[True, x_cells[1:] != x_cells[:-1]]) if len(x) else np.zeros(0, np.int64)
    along, off = space.split(q)
    slack = space.slack(q, space.reach)
    floors, small = floors.copy(), _small(q, x)
    kept = [np.zeros(0, np.int64)] * 3
    new: list[tuple[np.ndarray, ...]] = []
    waiting = 0

    def best() -> None:
        """Keep the k best per query and raise the floors."""
        nonlocal kept, new, waiting
        n, s, c = (np.concatenate([kept[i], *[f[i] for f in new]]) for i in range(3))
        first = np.lexsort((x_rows[c], x_ids[c], -s, n))
        n, s, c = n[first], s[first], c[first]
        rank = np.arange(len(n)) - np.searchsorted(n, n, "left")
        last = rank == k - 1
        floors[n[last]] = np.maximum(floors[n[last]], s[last])
        kept, new, waiting = [v[rank < k] for v in (n, s, c)], [], 0

    # Cells that promise most come first, so that the floors rise early.
    own, ends = x_cells[starts], np.r_[starts[1:], len(x)]
    low, high, far = space.boxes[own].T
    bound = np.maximum(along[:, own] * low, along[:, own] * high) + off[:, own] * far
    for i in np.argsort(-bound.max(0, initial=-np.inf), kind="stable"):
        able = np.flatnonzero(~(bound[:, i] + slack < floors))
        for a in range(0, len(able), TILE):
            for lo in range(starts[i], ends[i], TILE):
                some, hi = able[a : a + TILE], min(lo + TILE, ends[i])
                s = scores(q[some], x[lo:hi], small)
                n, c = np.nonzero(~(s < floors[some, None]) & (own_rows[some, None] != x_rows[None, lo:hi]))
                new.append((some[n], s[n, c], c + lo))
                waiting += len(n)
                if waiting > max(1 << 18, 4 * k * len(q)):
                    best()
    best()
    return kept[0], kept[1], order[kept[2]]


# --- the join --------------------------------------------------------------------


def _celled(space, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, b, h = space.value.cells(matrix(batch["v"], width))
            distance = np.hypot(b - space.value.norms[cell], h)
            shell = np.floor(SHELLS * np.log2(1 + distance))
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in ("row", "id", "v", "asked")], pa.array(cell, pa.int32()), pa.array(b), pa.array(h), pa.array(shell.astype(np.int32))],
                names=["row", "id", "v", "asked", "cell", "b", "h", "shell"],
            )

    return run


def _asked(space, width: int):
    """Floors of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = space.value.floors(batch["row"].to_numpy(), matrix(batch["v"], width))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("row", "id", "v", "part")], pa.array(floor)], names=["row", "id", "v", "part", "floor"])

    return run


def _ranges(space, width: int):
    """Of a group of queries, for every cell: the ranges of alpha and beta, and the lowest floor."""

    def run(group: pa.Table) -> pa.Table:
        q = matrix(group["v"], width)
        along, off = space.value.split(q)
        floor = (group["floor"].to_numpy() - space.value.slack(q, space.value.reach)).min()
        cells = along.shape[1]
        return pa.table({
            "part": pa.array([group["part"][0].as_py()] * cells, pa.int32()), "cell": pa.array(np.arange(cells), pa.int32()),
            "low": along.min(0), "high": along.max(0), "far": off.max(0), "floor": np.full(cells, floor),
        })

    return run


def packed(pivots: np.ndarray, counts: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(cell, first group, groups) of the cells with queries: neighbouring cells share a group, a crowded one has several."""
    left, out, group, room = sorted(counts), [], -1, 0
    at = left[0] if left else None
    while left:
        left.remove(at)
        n = counts[at]
        if n > most:
            own = -(-n // most)
            out.append((at, group + 1, own))
            group, room = group + own, 0
        else:
            if n > room:
                group, room = group + 1, most
            out.append((at, group, 1))
            room -= n
        if left:
            at = left[int(np.argmin(((pivots[left] - pivots[at]) ** 2).sum(1)))]
    return out


def _local(space, width: int, k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "row", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names=names)
        q, x = matrix(left["v"], width), matrix(right["v"], width)
        # A null id comes after all others.
        ids = right["id"].fill_null(_NO_ID).to_numpy()
        n, s, c = search(
            q, left["floor"].to_numpy(), left["row"].to_numpy(), x, right["row"].to_numpy(), ids, right["cell"].to_numpy(), space.value, k
        )
        return pa.table(
            [left["row"].take(pa.array(n)), left["id"].take(pa.array(n)), right["id"].take(pa.array(c)), right["row"].take(pa.array(c)), pa.array(s, pa.int64())], names=names
        )

    return run


def top_k(
    vectors: DataFrame, asked: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS,
    witnesses: int = WITNESSES, group_bytes: int = GROUP_BYTES, piece_bytes: int = PIECE_BYTES, least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best candidates of every row for which ``asked`` holds."""
    spark = vectors.sparkSession
    prepare(spark)
    numbers = stage(vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), whole(F.col(vector), scale).alias("v"),
        F.coalesce(asked, F.lit(False)).alias("asked"),
    ).filter("v IS NOT NULL"), "vectors")
    width = max(1, numbers.agg(F.max(F.size("v"))).first()[0] or 0)
    sample = numbers.orderBy(F.xxhash64("row"), "row").limit(max(witnesses, 2 * k)).select("row", "v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space = Space(sample["row"].to_numpy(), matrix(sample["v"], width), pivots, k)
    celled = stage(numbers.mapInArrow(
        _celled(spark.sparkContext.broadcast(space), width), "row long, id long, v array<double>, asked boolean, cell int, b double, h double, shell int"
    ), "cells")
    shells = celled.groupBy("cell", "shell").agg(F.min("b"), F.max("b"), F.max("h"), F.count(F.lit(1)), F.count_if("asked")).collect()
    space.summarize(np.array([(r[0], *r[2:6]) for r in shells], np.float64))
    shared = spark.sparkContext.broadcast(space)
    # Queries by group, with their floors.
    counts: dict[int, int] = {}
    for r in shells:
        if r[6]:
            counts[r[0]] = counts.get(r[0], 0) + r[6]
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = spark.createDataFrame(packed(space.pivots, counts, max(1, group_bytes // (8 * width))), "cell int, first int, groups int")
    grouped = celled.filter("asked").join(F.broadcast(groups), "cell").withColumn("part", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("groups"))).cast("int"))
    queries = stage(grouped.select("row", "id", "v", "part").mapInArrow(
        _asked(shared, width), "row long, id long, v array<double>, part int, floor double"
    ), "queries")
    # What each group needs of every cell.
    ranges = queries.groupBy("part").applyInArrow(_ranges(shared, width), "part int, cell int, low double, high double, far double, floor double")
    needs = stage(ranges.groupBy("cell").agg(F.collect_list(F.struct("part", "low", "high", "far", "floor")).alias("needs")), "needs")
    reached = lambda g: F.greatest(g["low"] * F.col("b"), g["high"] * F.col("b")) + g["far"] * F.col("h") >= g["floor"]

    def copies(columns: list[str]) -> DataFrame:
        met = lookup_join(celled.select(*columns), needs, "cell")
        return met.select(*columns, F.explode(F.filter("needs", reached)["part"]).alias("part"))

    sizes = copies(["cell", "b", "h"]).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    spread = F.least(F.ceil(F.col("rows") / least_rows), F.lit(spark.sparkContext.defaultParallelism))
    pieces = stage(sizes.select(
        "part", F.greatest(F.ceil(F.col("rows") * (8 * width) / piece_bytes), spread, F.lit(1)).cast("int").alias("pieces")
    ), "pieces")
    left = lookup_join(queries, pieces, "part").select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    right = lookup_join(copies(["row", "id", "v", "cell", "b", "h"]), pieces, "part").select(
        "row", "id", "v", "cell", "part", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int").alias("piece")
    )
    local = left.groupBy("part", "piece").cogroup(right.groupBy("part", "piece")).applyInArrow(
        _local(shared, width, k), "query_row long, query_id long, vec_id long, row long, score long"
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.r <> c.r)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= {K}
"""


@query("op11_top_k", SQL)
def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
