"""Near duplicates by SimHash, with candidate keys from the binary Golay code.

A text's 64-bit fingerprint is cut into segments A and B of 23 bits and C of 18 bits
(padded with zeros). The perfect (23, 12, 7) Golay code maps a segment to at most six
codewords, those nearest to it or to one of its one-bit neighbours; two segments that
differ in at most two bits always share one of them. For two fingerprints that differ in
at most four bits

* A and B both differ in at most two bits, so some pair of codewords of (A, B) is shared, or
* A differs in three or more, so B and C together differ in at most one bit: the nearest
  codeword of one and some codeword of the other are shared, or
* the same with A and B exchanged.

So no link is lost. Distinct fingerprints that share a key meet in one task, their exact
distance is tested there, and a task gives on only a spanning forest of the links it found, never all
pairs. Keys with very many fingerprints are handed on and done in blocks over many tasks,
again without loss. Connected components come from alternating large and small stars with
tables written to the shared folder between rounds.

Defined results: null text has no words, and texts without words have fingerprint zero,
which links like any other; repeated rows are rows of their own; a null id never becomes a
component's id unless all its ids are null. Input columns named like a result column are
replaced by it.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.llm.common import Batches, bytes_of, prepare, query, rows_to_batch, schema_with, stage, table, without

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of one key that one task compares; keys with more are done in blocks.
BLOCK = 20_000
#: Rows that a task gathers before it looks for links, and links it gathers before it thins them.
GATHER = 200_000
#: Shingle hashes whose bits are counted at once.
HASHES = 200_000
#: Verdicts on rows up to this number travel to the documents; more meet them by shuffle.
BROADCAST_ROWS = 200_000

#: Generator polynomial of the binary Golay code.
GOLAY = 0xC75
_MASK23, _MASK18 = (1 << 23) - 1, (1 << 18) - 1


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    stops = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *stops[:-1]]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, HASHES):
        ends = stops[k + shingle - 1:k + HASHES + shingle - 1] or stops[-1:]
        hashes = [digest(joined[s:e - 1], SEED) for s, e in zip(starts[k:k + HASHES], ends)]
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, into: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """The ``keep`` columns (all, if None) and the fingerprint as a signed 64-bit number."""
    prepare(docs.sparkSession)
    columns = without(docs.select(keep) if keep is not None else docs, into)
    df = docs.select(*columns, *([] if text in columns else [text]))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [fingerprint(x, shingle) for x in bytes_of(batch.column(batch.schema.get_field_index(text)))]
            yield rows_to_batch(batch, columns, {into: pa.array(found, pa.int64())})

    return df.mapInArrow(run, schema_with(df, columns, T.StructField(into, T.LongType())))


def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the 2^12 upper and 2^11 lower half words, and per syndrome the six error patterns to
    the codewords within three bits of the word or of a one-bit neighbour (repeats marked by -1)."""
    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    units = [remainder(1 << i) for i in range(23)]
    patterns = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    weight = np.zeros(2048, np.int64)
    for w in range(5):
        for bits in combinations(range(23), w):
            syndrome = 0
            for b in bits:
                syndrome ^= units[b]
            # Words of weight four matter only where the nearest codeword is three bits away.
            if w <= 3 or weight[syndrome] == 3:
                patterns[syndrome, filled[syndrome]] = sum(1 << b for b in bits)
                filled[syndrome] += 1
                weight[syndrome] = w if w <= 3 else 3
    high = np.array([remainder(x << 11) for x in range(4096)], np.int64)
    return high, np.arange(2048, dtype=np.int64), patterns


_HIGH, _LOW, _PATTERNS = _golay_tables()


def codewords(segments: np.ndarray) -> np.ndarray:
    """Per 23-bit word up to six codeword indices, the nearest codeword first; -1 fills up."""
    syndrome = _HIGH[segments >> 11] ^ (segments & 2047)
    patterns = _PATTERNS[syndrome]
    return np.where(patterns >= 0, (segments[:, None] ^ np.maximum(patterns, 0)) >> 11, -1)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of all keys of the fingerprints."""
    u = fps.astype(np.int64).view(np.uint64)
    a, b, c = ((u >> np.uint64(41)).astype(np.int64), (u >> np.uint64(18)).astype(np.int64) & _MASK23, u.astype(np.int64) & _MASK18)
    ka, kb, kc = codewords(a), codewords(b), codewords(c)
    rows, keys = [], []

    def add(table: int, x: np.ndarray, y: np.ndarray) -> None:
        fits = (x >= 0) & (y >= 0)
        rows.append(np.nonzero(fits)[0])
        keys.append(((table << 24) | (x << 12) | y)[fits])

    wide = len(fps), 6
    for i in range(6):
        add(0, np.broadcast_to(ka[:, i:i + 1], wide), kb)
    for number, k in ((1, ka), (2, kb)):
        add(number, k, np.broadcast_to(kc[:, :1], wide))
        add(number, np.broadcast_to(k[:, :1], (len(fps), 5)), kc[:, 1:])
    return np.concatenate(rows), np.concatenate(keys)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between every node and the smallest node of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints of equal key; ``key`` is sorted."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    stop = np.repeat(starts + sizes, sizes)
    i = np.flatnonzero(stop - np.arange(len(key)) > 1)
    bits = fp.view(np.uint64)
    found_a, found_b, held, lag = [], [], 0, 1
    while len(i):
        near = i[np.bitwise_count(bits[i] ^ bits[i + lag]) <= radius]
        near = near[fp[near] != fp[near + lag]]
        found_a.append(fp[near])
        found_b.append(fp[near + lag])
        held += len(near)
        if held > GATHER:
            x, y = forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [x], [y], 0
        lag += 1
        i = i[i + lag < stop[i]]
    if not found_a:
        return fp[:0], fp[:0]
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def _link_rows(radius: int, block: int | None):
    """Rows sorted by key to links; keys of more than ``block`` rows are handed on as (a = fingerprint, key)."""
    names = ["a", "b", "key"]

    def links(key, fp):
        a, b = _links(key, fp, radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=names)

    def later(key, fp):
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(key)], names=names)

    def run(batches: Batches) -> Batches:
        held_k, held_f, held, over = [], [], 0, None

        def gathered():
            return np.concatenate(held_k), np.concatenate(held_f)

        for batch in batches:
            held_k.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            held_f.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            held += batch.num_rows
            if held < GATHER:
                continue
            key, fp = gathered()
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(key, key[-1]))
            if over is not None:
                own = int(np.searchsorted(key, over, "right"))
                if own:
                    yield later(key[:own], fp[:own])
                key, fp, cut = key[own:], fp[own:], max(0, cut - own)
            if cut:
                yield from _split(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
            if block is not None and len(key) > block:
                over = int(key[-1])
                yield later(key, fp)
                key, fp = key[:0], fp[:0]
            held_k, held_f, held = [key], [fp], len(key)
        if held:
            key, fp = gathered()
            if over is not None:
                own = int(np.searchsorted(key, over, "right"))
                if own:
                    yield later(key[:own], fp[:own])
                key, fp = key[own:], fp[own:]
            if len(key):
                yield from _split(key, fp)

    def _split(key, fp):
        """Links of the keys in bounds; the others are handed on whole."""
        if block is not None:
            _, at, sizes = np.unique(key, return_inverse=True, return_counts=True)
            large = sizes[at] > block
            if large.any():
                yield later(key[large], fp[large])
                key, fp = key[~large], fp[~large]
        if len(key):
            yield links(key, fp)

    return run


_LINK_SCHEMA = "a long, b long, key long"


def golay_links(nodes: DataFrame, fp: str = "fingerprint", radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links that connect all distinct fingerprints which differ in at most ``radius`` bits (at most 4)."""
    if not 0 <= radius <= 4:
        raise ValueError("the Golay keys find all pairs up to four differing bits")
    prepare(nodes.sparkSession)

    def expand(batches: Batches) -> Batches:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, keys = golay_keys(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows])], names=["key", "fp"])

    keyed = nodes.select(F.col(fp).alias("fp")).mapInArrow(expand, "key long, fp long")
    first = stage(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link_rows(radius, block), _LINK_SCHEMA), "links")
    links = first.filter("key IS NULL").select("a", "b")
    large = first.filter("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    if large.isEmpty():
        return links.distinct()
    # Blocks of half the limit: every two blocks of a key meet in one task.
    blocks = large.groupBy("key").count().select("key", F.ceil(F.col("count") / (block / 4)).alias("n"))
    dealt = large.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")))
    met = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp"
    )
    more = met.repartition("key").sortWithinPartitions("key").mapInArrow(_link_rows(radius, None), _LINK_SCHEMA)
    return links.unionByName(more.select("a", "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes that have a link: the smallest node of their component.

    Alternating large and small stars; every round's links are written to the shared folder, so a lost
    executor costs one round at most.
    """
    now = stage(links.filter("a <> b"), "stars")
    mark = _mark(now)
    while True:
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Stored, so that the joins below are dealt out apart from the sums and their hot nodes can be split.
        lowest = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "stars")
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        down = stage(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
        lowest = stage(down.groupBy("a").agg(F.min("b").alias("m")), "stars")
        small = down.join(lowest, "a").select(F.col("b").alias("x"), "m").filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        now = stage(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "stars")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def classes(marked: DataFrame, order: Column, fp: str = "fingerprint", radius: int = RADIUS) -> DataFrame:
    """``(fingerprint, first)``: the smallest ``order`` of all rows connected with each fingerprint.

    ``marked`` is a stored table of rows with fingerprints; equal fingerprints are merged first, so groups of copies of any size
    cost one row per task.
    """
    nodes = stage(marked.groupBy(fp).agg(F.min(order).alias("first")), "fingerprints")
    roots = stage(components(golay_links(nodes, fp, radius)), "components")
    own = nodes.join(roots, nodes[fp] == roots["node"])
    lowest = own.groupBy("root").agg(F.min("first").alias("lowest"))
    linked = roots.join(lowest, "root").select("node", "lowest")
    return stage(
        nodes.join(linked, nodes[fp] == linked["node"], "left").select(fp, F.coalesce("lowest", "first").alias("first")), "classes"
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row."""
    marked = stage(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"], shingle=shingle), "marked")
    found = classes(marked, F.col("doc_id"), radius=radius)
    return marked.join(found.withColumnRenamed("first", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def _marks(df: DataFrame) -> list[Column]:
    """128 bits of a row's content as columns ``one`` and ``two``; only rows that are equal in every column share them."""
    parts = []
    for field in df.schema.fields:
        value = F.col(field.name)
        # Maps have no hash.
        parts += [value.isNull(), F.to_json(F.struct(value)) if "map<" in field.dataType.simpleString() else value]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in enumerate(("one", "two"))]


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: that of the smallest id (of several such rows, any one).

    Only ids, fingerprints and marks of the rows are stored; the texts are read again where the verdicts meet them.
    """
    columns = docs.columns
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    key, body = (f"c{[c.lower() for c in columns].index(x.lower())}" for x in (doc_id, text))
    slim = fingerprints(own.select(F.col(key).alias("id"), F.col(body).alias("text"), *_marks(own)), "text", ["id", "one", "two"], shingle=shingle)
    marked = stage(slim.withColumn("row", F.monotonically_increasing_id()), "marked")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    found = classes(marked, order, radius=radius)
    first = (F.col("row") == F.col("first")["row"]).alias("first")
    judged = marked.select("fingerprint", "row", "one", "two").join(found, "fingerprint").select("one", "two", first)
    # Equal rows share a verdict: all of them go, or all but one.
    verdicts = judged.groupBy("one", "two").agg(F.max("first").alias("once"), F.count(F.lit(1)).alias("n"))
    lost = stage(verdicts.filter(~F.col("once") | (F.col("n") > 1)).select("one", "two", "once"), "lost")
    few = lost.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = own.select("*", *_marks(own)).join(F.broadcast(lost) if few else lost, ["one", "two"], "left")
    kept = rows.filter("once IS NULL")
    if not lost.filter("once").isEmpty():
        kept = kept.unionByName(rows.filter("once").dropDuplicates(["one", "two"]))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )
