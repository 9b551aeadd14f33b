"""Merkle manifest of a dataset: a tree of digests per source, one over the sources, and a proof for every row.

Checkpoint and recompute: of a tree's levels only the leaves and every ``STRIDE``-th level above them are stored. A proof
needs the siblings on every level, so the levels between are made again, one aligned subtree of at most ``FANOUT ** STRIDE`` stored
nodes at a time, from those nodes; the siblings are emitted and the interior nodes forgotten. Paths run from the root
downwards: a stored node hands the part of the path above it to the stored nodes of its subtree.

Leaves get their places by one range partitioning over (tree, order, leaf, row): a source that holds most rows, or a
row that repeats without end, is cut over many tasks. Places follow from sums over one row per (task, tree). Every group
of rows below is an aligned subtree, so none has more than ``FANOUT ** STRIDE`` rows, whatever the sources hold.

Defined results: a null field counts as ``-``; a null source is a source of its own and comes first; null ids come first in
their source; rows with equal ids are ordered by their leaf, and equal leaves are interchangeable; repeated rows are leaves of their own; a row
without an id is never tampered with; an empty table has no root and gives no rows; further columns, whatever their names, don't enter the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsflow.llm.common import prepare, query, stage, table
from newsflow.operators.lookup import lookup_join

FANOUT = 3
#: Levels between two stored ones.
STRIDE = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

STEP = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("others", T.ArrayType(T.StringType()))])
PATH = T.ArrayType(STEP)
_ARROW_PATH = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))


# --- digests -----------------------------------------------------------------


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tree_of(group: Column) -> Column:
    """Name of a group's tree; the names are in the order of the groups, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def step(digest: Column, s: Column) -> Column:
        others = s["others"]
        before = F.slice(others, F.lit(1), s["at"])
        after = F.slice(others, s["at"] + 1, F.size(others))
        return F.sha2(F.concat(F.array_join(before, ""), digest, F.array_join(after, "")), 256)

    return F.aggregate(path, leaf, step)


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf upwards, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["others"])), ""), 256)


def _height(nodes: int) -> int:
    """Levels above ``nodes`` nodes until one is left."""
    levels, reach = 0, 1
    while reach < nodes:
        reach *= FANOUT
        levels += 1
    return levels


def _levels(nodes: list[str], steps: int) -> list[list[str]]:
    """The nodes of an aligned subtree and the ``steps`` levels above them."""
    levels = [nodes]
    for _ in range(steps):
        below = levels[-1]
        levels.append([
            hashlib.sha256("".join(below[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(below), FANOUT)
        ])
    return levels


def _path(levels: list[list[str]], at: int) -> list[dict]:
    """The steps of node ``at`` up to the top of its subtree."""
    steps = []
    for level in levels[:-1]:
        first = at - at % FANOUT
        run = level[first : first + FANOUT]
        steps.append({"at": at - first, "others": run[: at - first] + run[at - first + 1 :]})
        at //= FANOUT
    return steps


def _raise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the stored nodes of a subtree to its top, one stored level up."""
    for batch in batches:
        steps = [min(STRIDE, _height(n)) for n in batch["n"].to_pylist()]
        tops = [_levels(nodes, k)[-1][0] for nodes, k in zip(batch["nodes"].to_pylist(), steps)]
        left = [-(-n // FANOUT**k) for n, k in zip(batch["n"].to_pylist(), steps)]
        yield pa.RecordBatch.from_arrays(
            [batch["tree"], batch["block"], pa.array(left, pa.int64()), pa.array(tops, pa.string())], names=["tree", "pos", "n", "node"]
        )


def _lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a subtree's nodes and the path above its top to one path per node, subtree by subtree."""
    for batch in batches:
        for i in range(batch.num_rows):
            own = batch.slice(i, 1)
            n, nodes, above = (own[c][0].as_py() for c in ("n", "nodes", "path"))
            levels = _levels(nodes, min(STRIDE, _height(n)))
            paths = pa.array([[_path(levels, k) + above for k in range(len(nodes))]], pa.list_(_ARROW_PATH))
            yield pa.RecordBatch.from_arrays([own["tree"], own["top"], own["rows"], paths], names=["tree", "top", "rows", "paths"])


# --- trees -------------------------------------------------------------------


def place(rows: DataFrame, order: list[str]) -> DataFrame:
    """Stored ``rows`` of (tree, node, ...) with ``pos``, from 0 in each tree by ``order``, and ``n``, the rows of the tree."""
    keys = ["tree", *order, "node"]
    sorted_rows = (
        rows.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], F.col("_row"))
        .sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys], "_row")
        .drop("_row")
    )
    # Rows are counted off in their sorted order: the upper bits name the task, the lower ones the row in it.
    counted = sorted_rows.withColumn("_mark", F.monotonically_increasing_id())
    counted = stage(counted.withColumn("_span", F.struct(F.shiftright("_mark", 33).alias("task"), F.col("tree").alias("name"))), "merkle-order")
    spans = counted.groupBy("_span").agg(F.min("_mark").alias("first"), F.count(F.lit(1)).alias("rows"))
    own = Window.partitionBy("_span.name")
    before = F.sum("rows").over(own.orderBy("_span.task").rowsBetween(Window.unboundedPreceding, -1))
    shifts = stage(spans.select(
        "_span", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_shift"), F.sum("rows").over(own).alias("n")
    ), "merkle-spans")
    return lookup_join(counted, shifts, "_span").withColumn("pos", F.col("_mark") + F.col("_shift")).drop("_mark", "_span", "_shift")


def _subtrees(level: DataFrame, extra: list[str]) -> DataFrame:
    """(tree, n, block, rows, nodes): the aligned subtrees over a stored level; ``rows`` are (pos, node, extra) in order."""
    own = level.select("tree", "n", F.expr(f"pos div {FANOUT**STRIDE}").alias("block"), F.struct("pos", "node", *extra).alias("row"))
    grouped = own.groupBy("tree", "n", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return grouped.withColumn("nodes", F.col("rows.node"))


class Trees:
    """Stored levels of all trees, lowest first; a tree is part of a level as long as it has more than one node there."""

    def __init__(self, leaves: DataFrame, extra: list[str]):
        """``leaves``: stored (tree, pos, n, node) and the ``extra`` columns that stay beside a leaf."""
        self.levels, self.tops, self.leaves, self.extra = [], None, leaves, extra
        level = leaves
        largest = level.agg(F.max("n")).first()[0] or 0
        while True:
            done = level.filter("n = 1").select("tree", "node")
            self.tops = done if self.tops is None else self.tops.unionByName(done)
            if largest <= 1:
                break
            level = level.filter("n > 1")
            self.levels.append(level)
            level = stage(_subtrees(level, []).drop("rows").mapInArrow(_raise, "tree string, pos long, n long, node string"), "merkle-level")
            largest = -(-largest // FANOUT**STRIDE)

    def paths(self, above: DataFrame) -> DataFrame:
        """(tree, top, pos, node, extra, path) of every leaf; ``above`` is the (tree, top, path) that leads on from each tree's top.

        Level by level downwards: a subtree meets the path of its top, and gives its stored nodes theirs. The paths of the
        leaves are made beside the leaves and never move.
        """
        upper = above.select("tree", F.lit(0).cast("long").alias("block"), F.lit(True).alias("last"), "top", "path")
        found = None
        for k, level in reversed(list(enumerate(self.levels))):
            parents = upper if found is None else upper.unionByName(
                found.select("tree", F.col("pos").alias("block"), F.lit(False).alias("last"), "top", "path")
            )
            # A tree's top is above the one subtree of its last level, other subtrees are below nodes of the next level.
            below = _subtrees(level, [] if k else self.extra).withColumn("last", F.col("n") <= FANOUT**STRIDE).join(parents, ["tree", "block", "last"])
            kinds = [below.schema[c] for c in ("tree", "top", "rows")]
            made = below.mapInArrow(_lower, T.StructType([*kinds, T.StructField("paths", T.ArrayType(PATH))]))
            found = made.select("tree", "top", F.inline(F.arrays_zip("rows", "paths"))).select("tree", "top", "rows.*", F.col("paths").alias("path"))
            if k:
                found = stage(found.drop("node"), "merkle-paths")
        # The leaf of a tree of one leaf is its top.
        lone = self.leaves.filter("n = 1").join(upper, "tree").select("tree", "top", "pos", "node", *self.extra, "path")
        return lone if found is None else found.unionByName(lone)


def manifest(docs: DataFrame, leaf: Column, group: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``order``, the ``keep`` columns, ``leaf``, ``subroot``, ``root`` and ``path``.

    ``path`` lists, from the leaf to the root, the place in the run and the digests of the others.
    """
    prepare(docs.sparkSession)
    named = {f"_k{i}": c for i, c in enumerate((keep or {}).values())}
    rows = stage(docs.select(
        tree_of(F.col(group)).alias("tree"), F.col(order).alias("_order"), leaf.alias("node"), *[c.alias(k) for k, c in named.items()]
    ), "merkle-leaves")
    leaves = stage(place(rows, ["_order"]), "merkle-placed")
    trees = Trees(leaves, ["_order", *named])
    # The tops of the sources are the leaves of one more tree.
    tops = stage(trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("_order"), "node"), "merkle-tops")
    sources = stage(place(tops, ["_order"]), "merkle-sources")
    crown = Trees(sources, ["_order"])
    root = crown.tops.first()
    root = None if root is None else root["node"]
    no_steps = F.array().cast(PATH)
    start = crown.tops.select("tree", F.col("node").alias("top"), no_steps.alias("path"))
    over = crown.paths(start).select(F.col("_order").alias("tree"), F.col("node").alias("top"), "path")
    return trees.paths(stage(over, "merkle-crown")).select(
        F.col("_order").alias(order), *[F.col(k).alias(name) for k, name in zip(named, keep or {})],
        F.col("node").alias("leaf"), F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"), "path",
    )


# --- query -------------------------------------------------------------------

_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT)), lambda a, b: " + (
    "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, (p & 1) * 3988292384)))"
)


def _field_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if f == "text" else f) for f in FIELDS) + ")"


_UP = f"list_transform(range(0, len(nodes), {FANOUT}), lambda i: sha256(array_to_string(nodes[i + 1:i + {FANOUT}], '')))"

SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, {_leaf_sql('text')} AS leaf,
       CASE WHEN xor({_CRC.format(x='doc_id')}, 4294967295) % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS bad FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
lv(tree, level, nodes) AS (SELECT tree, 0, list(leaf ORDER BY pos) FROM p GROUP BY tree
       UNION ALL SELECT tree, level + 1, {_UP} FROM lv WHERE len(nodes) > 1),
sub AS (SELECT tree, max(level) AS height, max(nodes[1]) FILTER (WHERE len(nodes) = 1) AS subroot FROM lv GROUP BY tree),
sp AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS spos FROM sub),
tv(level, nodes) AS (SELECT 0, list(subroot ORDER BY spos) FROM sp HAVING count(*) > 0 UNION ALL SELECT level + 1, {_UP} FROM tv WHERE len(nodes) > 1),
rt AS (SELECT nodes[1] AS root FROM tv WHERE len(nodes) = 1),
steps AS MATERIALIZED (
  SELECT p.tree, p.pos, lv.level, p.pos // CAST({FANOUT} ** lv.level AS BIGINT) AS i, lv.nodes FROM p JOIN lv USING (tree) WHERE len(lv.nodes) > 1
  UNION ALL
  SELECT p.tree, p.pos, sp.height + tv.level, sp.spos // CAST({FANOUT} ** tv.level AS BIGINT), tv.nodes FROM p JOIN sp USING (tree) CROSS JOIN tv WHERE len(tv.nodes) > 1),
runs AS MATERIALIZED (SELECT tree, pos, level, array_to_string(nodes[i - i % {FANOUT} + 1:i], '') AS before, array_to_string(nodes[i + 2:i - i % {FANOUT} + {FANOUT}], '') AS after FROM steps),
pr AS (SELECT tree, pos, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM runs GROUP BY tree, pos),
f(tree, pos, level, h) AS (SELECT tree, pos, 0, coalesce(bad, leaf) FROM p
       UNION ALL SELECT f.tree, f.pos, f.level + 1, sha256(before || h || after) FROM f JOIN runs r ON r.tree = f.tree AND r.pos = f.pos AND r.level = f.level),
top AS (SELECT tree, pos, arg_max(h, level) AS folded FROM f GROUP BY tree, pos)
SELECT p.doc_id, p.leaf, sp.subroot, rt.root, coalesce(pr.proof, sha256('')) AS proof_sha256, top.folded AS folded_root, top.folded = rt.root AS verified
FROM p JOIN sp USING (tree) CROSS JOIN rt JOIN top USING (tree, pos) LEFT JOIN pr USING (tree, pos)
"""


@query("op13_manifest", SQL)
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaf = leaf_of(*[F.col(c) for c in FIELDS])
    tampered = F.when(chosen, leaf_of(*[cut if c == "text" else F.col(c) for c in FIELDS]))
    rows = manifest(docs, leaf, keep={"tampered": tampered})
    folded = rows.withColumn("folded_root", fold_path(F.coalesce("tampered", "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
