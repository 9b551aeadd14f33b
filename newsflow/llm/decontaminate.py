"""Benchmark decontamination with suffix arrays of the training texts.

Every task takes the documents it reads in shards of about ``SHARD_WORDS`` words
and builds the shard's suffix array over words. All suffixes of the benchmark
items are then searched in it at once: the array interval that agrees with a
suffix is narrowed word by word with binary searches until it is empty, which
gives the longest verbatim match of every suffix and its locations. Documents
never leave their task, so nothing is shuffled; a match can't span two documents.

Words that no benchmark item holds end every match, so they get no entry in the
array.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text,
one after the other. With more than one block, the documents are stored with row numbers, each block's
result is stored, and its broadcast is destroyed before the next block is fetched, so what is
broadcast at once has a fixed bound however large the benchmark table is.

Defined results: null text has no words; an item without words is never found; a
null ``item_id`` is an item named by the empty string; rows that repeat are
judged one by one; items that repeat an id count once. Input columns named like a
result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.llm.common import Batches, bytes_of, prepare, query, rows_to_batch, schema_with, stage, table, without

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 32 << 20

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing, all others become spaces.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.LongType())])
LEAK = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("longest", T.LongType()),
    T.StructField("longest_start", T.LongType()),
    T.StructField("longest_item", T.StringType()),
])
MATCH = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("item_start", T.LongType()),
    T.StructField("words", T.LongType()),
    T.StructField("n_locations", T.LongType()),
    T.StructField("doc_key", T.StringType()),
    T.StructField("doc_start", T.LongType()),
])


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_WORD_BYTES).split() if text else []


class Suffixes:
    """All item suffixes long enough to hold a window, as word numbers."""

    def __init__(self, items: Iterable[tuple[str, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        names, flat, starts, ends, needs = [], [], [], [], []
        for name, text in items:
            ws = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ws:
                continue
            need, at = min(window, len(ws)), len(flat)
            flat += ws
            for p in range(len(ws) - need + 1):
                names.append((name, p))
                starts.append(at + p)
                ends.append(at + len(ws))
                needs.append(need)
        self.names = names
        self.flat = np.array(flat, np.int64)
        self.start, self.length = np.array(starts, np.int64), np.array(ends, np.int64) - np.array(starts, np.int64)
        self.need = np.array(needs, np.int64)
        self.longest = int(self.length.max(initial=0))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes that begin with a known word, sorted by their first ``depth`` words.

    Prefix doubling: ranks by 1, 2, 4 ... words. Word 0 ends a suffix and sorts first.
    """
    at = np.flatnonzero(ids)
    rank = np.append(ids, 0)
    order = at[np.argsort(rank[at], kind="stable")]
    step = 1
    while step < depth and len(at):
        after = np.where(at + step < len(ids), rank[np.minimum(at + step, len(ids))], 0)
        pair = rank[at] * (int(rank.max()) + 1) + after
        by = np.argsort(pair, kind="stable")
        order = at[by]
        fresh = np.concatenate(([1], np.diff(pair[by]) != 0)).cumsum()
        rank = np.zeros_like(rank)
        rank[order] = fresh
        if fresh[-1] == len(at):
            break
        step *= 2
    return order


def _bound(ids: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, right: bool) -> np.ndarray:
    """Per query, the first place in [lo, hi) whose word at ``depth`` is not below (``right``: above) ``word``."""
    lo, hi = lo.copy(), hi.copy()
    while len(k := np.flatnonzero(lo < hi)):
        mid = (lo[k] + hi[k]) >> 1
        # The suffixes of an interval agree in ``depth`` known words, so there is a word or an end at this depth.
        seen = ids[sa[mid] + depth]
        low = (seen <= word[k]) if right else (seen < word[k])
        lo[k[low]] = mid[low] + 1
        hi[k[~low]] = mid[~low]
    return lo


def search(ids: np.ndarray, suffixes: Suffixes):
    """``(query, words matched, places)`` for every set of places that leaves the interval of a suffix.

    A place appears once per suffix, with the length of its longest match, if a window fits.
    ``ids`` ends with a 0.
    """
    sa = suffix_array(ids, suffixes.longest)
    if not len(sa):
        return
    q = np.arange(len(suffixes.start))
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(sa), np.int64)
    depth = 0
    while len(q):
        more = suffixes.length[q] > depth
        word = np.where(more, suffixes.flat[np.minimum(suffixes.start[q] + depth, len(suffixes.flat) - 1)], -1)
        left = np.where(more, _bound(ids, sa, lo, hi, depth, word, False), hi) if more.any() else hi
        right = np.where(more, _bound(ids, sa, left, hi, depth, word, True), hi) if more.any() else hi
        done = (left >= right) | ~more
        ripe = np.flatnonzero((suffixes.need[q] <= depth) & ((left > lo) | (right < hi) | done))
        for k in ripe.tolist():
            a, b = int(left[k]), int(right[k])
            gone = sa[lo[k]:hi[k]] if done[k] else np.concatenate((sa[lo[k]:a], sa[b:hi[k]]))
            if len(gone):
                yield int(q[k]), depth, gone
        q, lo, hi = q[~done], left[~done], right[~done]
        depth += 1


def _shards(batches: Batches, text: str, vocabulary: dict[bytes, int], size: int):
    """``(batches, ids, doc starts, words per doc)`` of about ``size`` words each; documents stay whole."""
    held, ids, starts, counts = [], [], [], []

    def shard():
        return held, np.array(ids, np.int64), np.array(starts, np.int64), counts

    for batch in batches:
        held.append(batch)
        for body in bytes_of(batch.column(batch.schema.get_field_index(text))):
            ws = words_of(body)
            starts.append(len(ids))
            counts.append(len(ws))
            ids.extend([vocabulary.get(w, 0) for w in ws])
            ids.append(0)
        if len(ids) >= size:
            yield shard()
            held, ids, starts, counts = [], [], [], []
    if held:
        yield shard()


def _scan(suffixes, columns: list[str], text: str, into: str, shard_words: int) -> Callable[[Batches], Batches]:
    def judge(known, ids, starts, counts):
        n_docs = len(starts)
        best = np.zeros(len(ids) + 1, np.int64)
        whose = np.zeros(len(ids) + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(n_docs)]
        for q, length, places in search(ids, known):
            better = places[best[places] < length]
            best[better], whose[better] = length, q
            for d in np.unique(np.searchsorted(starts, places, "right") - 1).tolist():
                items[d].add(known.names[q][0])
        cover = np.zeros(len(ids) + 2, np.int64)
        found = np.flatnonzero(best)
        np.add.at(cover, found, 1)
        np.add.at(cover, found + best[found], -1)
        hit = np.cumsum(cover)[: len(ids)] > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        runs = edges.reshape(-1, 2)
        of = np.searchsorted(starts, runs[:, 0], "right") - 1 if len(runs) else runs[:, 0]
        first, last = np.searchsorted(of, np.arange(n_docs)), np.searchsorted(of, np.arange(n_docs), "right")
        for d in range(n_docs):
            own = runs[first[d]:last[d]]
            a = int(starts[d])
            spans = [{"start": int(x) - a, "words": int(y - x)} for x, y in own]
            top = a + int(np.argmax(best[a:a + counts[d]])) if len(own) else -1
            yield {
                "n_words": counts[d], "n_hit": int((own[:, 1] - own[:, 0]).sum()), "items": sorted(items[d]),
                "spans": spans, "longest": int(best[top]) if len(own) else 0,
                "longest_start": top - a if len(own) else None,
                "longest_item": known.names[whose[top]][0] if len(own) else None,
            }

    def run(batches: Batches) -> Batches:
        known = suffixes.value
        for held, ids, starts, counts in _shards(batches, text, known.vocabulary, shard_words):
            results = judge(known, ids, starts, counts)
            for b in held:
                own = [next(results) for _ in range(b.num_rows)]
                yield rows_to_batch(b, columns, {into: pa.array(own, LEAK_ARROW)})

    return run


LEAK_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))),
    ("longest", pa.int64()), ("longest_start", pa.int64()), ("longest_item", pa.string()),
])


def item_blocks(spark: SparkSession, items: DataFrame, item_id: str, text: str, block_bytes: int, window: int):
    """The items as broadcast suffixes, in blocks of bounded text; at least one block. Each comes with the number of blocks.

    Blocks are hash classes of the text, as many as the measured bytes ask for; each is
    fetched alone. A single longer item makes a longer block.
    """
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total * 1.5) // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        part = named if n == 1 else named.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        rows = [(r[0], None if r[1] is None else r[1].encode("utf-8", "surrogatepass")) for r in part.collect()]
        yield spark.sparkContext.broadcast(Suffixes(sorted(rows, key=lambda r: (r[0], r[1] or b"")), window)), n


def find_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    keep: list[str] | None = None, into: str = "leak", window: int = WINDOW, shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``keep`` columns (all, if None) and ``into``: words, words hit, items found, hit spans in words
    and the longest verbatim match of each document."""
    spark = docs.sparkSession
    prepare(spark)
    columns = without(docs.select(keep) if keep is not None else docs, into)
    df = docs.select(*columns, *([] if text in columns else [text]))
    found, stored = None, None
    for known, n in item_blocks(spark, items, item_id, item_text, block_bytes, window):
        if n == 1:
            return df.mapInArrow(_scan(known, columns, text, into, shard_words), schema_with(df, columns, T.StructField(into, LEAK)))
        if stored is None:
            inner = [f"c{i}" for i in range(len(columns))]
            own = df.select(*[F.col(c).alias(i) for c, i in zip(columns, inner)], F.col(text).alias("text"))
            stored = stage(own.withColumn("row", F.monotonically_increasing_id()), "documents")
        rows = stored.select("row", "text")
        part = rows.mapInArrow(_scan(known, ["row"], "text", "leak", shard_words), schema_with(rows, ["row"], T.StructField("leak", LEAK)))
        # The first block keeps every row, for its words.
        part = stage(part if found is None else part.filter(F.col("leak")["n_hit"] > 0), "leaks")
        known.destroy()
        found = part if found is None else found.unionByName(part)
    leaks = found.groupBy("row").agg(F.collect_list("leak").alias("leaks")).select("row", _merged().alias("leak"))
    return stored.join(leaks, "row").select(*[F.col(i).alias(c) for c, i in zip(columns, inner)], F.col("leak").alias(into))


def _merged():
    """One result from those of several blocks in ``leaks``: spans united, items united, the longest of all."""
    spans = F.array_sort(F.flatten(F.col("leaks.spans")))
    # Sorted spans: each either starts a new run or stretches the last one.
    last = lambda acc: F.element_at(acc, -1)
    stop = lambda s: s["start"] + s["words"]
    joined = F.aggregate(
        spans, F.slice(spans, 1, 0),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= stop(F.try_element_at(acc, F.lit(-1)))), F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(
                F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
                (F.greatest(stop(F.try_element_at(acc, F.lit(-1))), stop(s)) - F.try_element_at(acc, F.lit(-1))["start"]).alias("words"),
            )),
        )).otherwise(F.concat(acc, F.array(s))),
    )
    best = F.array_max(F.transform("leaks", lambda x: F.struct(
        x["longest"].alias("longest"), (-x["longest_start"]).alias("back"), x["longest_item"].alias("item")
    )))
    return F.struct(
        F.array_max("leaks.n_words").alias("n_words"),
        F.aggregate(joined, F.lit(0).cast("long"), lambda n, s: n + s["words"]).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("leaks.items"))).alias("items"),
        joined.alias("spans"), best["longest"].alias("longest"), (-best["back"]).alias("longest_start"), best["item"].alias("longest_item"),
    )


def longest_matches(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per benchmark suffix with a match of a window or more: its longest match over all shards, how many
    places hold it, and one of them (the smallest document key as text)."""
    spark = docs.sparkSession
    prepare(spark)
    slim = docs.select(F.col(doc_id).cast("string").alias("doc_key"), F.col(text).alias("text"))

    def task(suffixes):
        def run(batches: Batches) -> Batches:
            known = suffixes.value
            for held, ids, starts, counts in _shards(batches, "text", known.vocabulary, shard_words):
                keys = [k for b in held for k in b.column(0).to_pylist()]
                top: dict[int, tuple[int, np.ndarray]] = {}
                for q, length, places in search(ids, known):
                    if length >= top.get(q, (0,))[0]:
                        top[q] = (length, places)
                rows = []
                for q, (length, places) in top.items():
                    of = np.searchsorted(starts, places, "right") - 1
                    key, start = min((keys[d] or "", int(p - starts[d])) for d, p in zip(of, places))
                    rows.append((*known.names[q], length, len(places), key, start))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=MATCH.names)

        return run

    found = None
    for known, n in item_blocks(spark, items, item_id, item_text, block_bytes, window):
        part = slim.mapInArrow(task(known), MATCH)
        if n > 1:
            part = stage(part, "matches")
            known.destroy()
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("item_id", "item_start").agg(F.max("words").alias("words"))
    return (
        found.join(best, ["item_id", "item_start", "words"]).groupBy("item_id", "item_start", "words")
        .agg(F.sum("n_locations").alias("n_locations"), F.min(F.struct("doc_key", "doc_start")).alias("at"))
        .select("item_id", "item_start", "words", "n_locations", "at.doc_key", "at.doc_start")
    )


def drop_leaked(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents in which no window of an item occurs, with their own columns."""
    into = "leak"
    while into in {c.lower() for c in docs.columns}:
        into += "_"
    return find_leaks(docs, items, text, into=into, **options).filter(F.col(into)["n_hit"] == 0).drop(into)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH i0 AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
i1 AS (SELECT item_id, w, least(10, len(w)) AS k FROM i0 WHERE len(w) > 0),
i2 AS (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM i1),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM i2),
ks AS (SELECT DISTINCT k FROM win),
d0 AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
d1 AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d0, ks WHERE len(w) >= k),
hit AS (SELECT d1.doc_id, d1.p, d1.k, win.item_id FROM d1 JOIN win ON d1.k = win.k AND win.s = array_to_string(d1.w[p:p + d1.k - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS x FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d0.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d0 LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op7_decontaminate", SQL)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    leak = F.col("leak")
    return found.select(
        "doc_id", leak["n_words"].alias("n_words"), leak["n_hit"].alias("n_hit"),
        F.size(leak["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(leak["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (leak["n_hit"] > 0).alias("contaminated"),
    )
