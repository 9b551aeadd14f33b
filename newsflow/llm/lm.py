"""Language-model scores by a weighted backoff automaton over words.

Tokens are words and one end per text. Every token has the smoothed unigram probability
``(c + 1) / (N + V + 1)``, from exact counts of all training tokens. On top of it come bigrams and trigrams:

* every bigram and trigram seen ``LEAST`` times gets an arc, at every size of the corpus. All others flow into the backoff weights;
* contexts are the automaton's states. An arc carries the discounted log-probability; where a state has no arc
  for a word, its failure arc leads to the shorter context and carries the backoff weight;
  probabilities of each state add up to 1;
* one left-to-right traversal of a text carries the state and adds up what differs from the unigram model.

The arcs grow with the corpus, so the automaton is a table and never travels to every task. Its weights are pushed onto the grams: what a
traversal passes through between two states depends on the grams that occur there alone, and a gram's weight is its arc, less the
backoff weights and the shorter arc that it spares, and the backoff weight of the context that it is. The sum of the weights of a
text's grams is then that of its traversal. Grams are number keys: the ``NUMBERED`` most frequent words have numbers, up to three make a key; a word without
a number, or a gram with one, is known by 62 bits of a hash (two that shared one would be counted as one). Keys move sorted and compressed, many in a row,
and meet their weights in one shuffle; a sum per text and part goes back. Numbered words and grams
above ``HOT_SHARE`` (so a bounded number) are looked up in the task, and a bit filter of bounded size holds back most grams that
training has no weight for; both only spare work.

With ``word_share`` and ``gram_share``, ``train`` learns an automaton of the frequent grams alone, small enough to be broadcast; there only rare
words meet their counts in a join.

Defined results: null text is empty (an end alone); repeated rows are scored one by one; without training tokens every score is 0.
Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import contextlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.llm.common import Batches, bytes_of, held_out, prepare, query, rows_to_batch, stage, table, without
from newsflow.session import staging_path, staging_scope

#: Times that a bigram or trigram with an arc was seen.
LEAST = 2
#: Share of the training tokens from which a gram is looked up in the task.
HOT_SHARE = 1e-5
#: The filter has about 16 bits a gram, and at most so many.
FILTER_BITS = 1 << 27
FOLDS = 7
END = b""
#: Distinct entries that a counting task gathers before it passes them on.
GATHER = 1_000_000
#: Discounts are kept inside these bounds.
DISCOUNT = (0.1, 0.95)
#: Words that get a number, at most; two and three numbers make the key of a gram.
NUMBERED = 1 << 18
#: Keys that one counting task merges at a time, about, and training tokens for each task in which texts meet weights.
PART = 2_000_000
MEETING = 64_000_000
#: Rows of an Arrow batch of numbers, bytes of one of texts, and words of 64 bits in a block of the filter.
BATCH = 100_000
BATCH_BYTES = 4 << 20
BLOCK = 1 << 17
_BITS = 20
_MASK = (1 << _BITS) - 1
_PAIR = (1 << 2 * _BITS) - 1
_TWO, _THREE = 1 << 60, 1 << 61
_HASH = (1 << 62) - 1
_LAST = (1 << 63) - 1
_SIGN = 1 << 63
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def strings(words: list[bytes] | pa.Array) -> pa.Array:
    """The words as a string column; bytes that are no UTF-8 are replaced."""
    found = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    try:
        return found.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([w.decode("utf-8", "replace") for w in found.to_pylist()], pa.string())


def _prepare(spark: SparkSession) -> None:
    """Batches as long as their bytes allow, as most tables here hold numbers."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tokens_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, as ``tokens_of`` gives them without the ends; and how many each text has."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    found = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    found = found + ((found - np.uint8(65) < 26).view(np.uint8) << 5)
    solid = (found != 32) & (found - np.uint8(9) > 4)
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    first = bounds[bounds < len(found)]
    begins[first] = solid[first]
    ends[:-1] &= ~solid[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.searchsorted(starts, bounds))
    ends = np.concatenate(([0], np.cumsum(np.flatnonzero(ends) + 1 - starts))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(found[solid])]), sizes


def count_words(train: DataFrame, text: str = "text") -> DataFrame:
    """``(word, c)`` of all training tokens, stored; the end token is the empty word."""

    def count(batches: Batches) -> Batches:
        held, size, texts = [], 0, 0

        def out():
            words, n = pa.chunked_array(held, pa.binary()).value_counts().flatten()
            words, n = pa.concat_arrays([strings(words), pa.array([END.decode()])]), pa.concat_arrays([n, pa.array([texts])])
            return pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

        for batch in batches:
            words, sizes = split_words(batch.column(0))
            held.append(words)
            size, texts = size + len(words), texts + len(sizes)
            if size > 4 * GATHER:
                yield out()
                held, size, texts = [], 0, 0
        if texts:
            yield out()

    found = train.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return stage(found.groupBy("word").agg(F.sum("n").alias("c")), "words")


class Frequent:
    """Numbers of the frequent words."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.counts = np.array(counts, np.int64)
        self.number = {w: i for i, w in enumerate(words)}

    def ids(self, text: bytes | None) -> list[int]:
        """Word numbers between the ends of the text before and of this one; -1 for a rare word."""
        get = self.number.get
        return [get(END, -1), *[get(w, -1) for w in (text or b"").lower().split()], get(END, -1)]


def _gram_counts(train: DataFrame, frequent, order: int, known: np.ndarray | None) -> DataFrame:
    """``(code, n)`` of the bigrams of frequent words, or the trigrams both of whose bigrams are ``known``."""

    def codes(ids: np.ndarray) -> np.ndarray:
        pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] << _BITS | ids[1:], -1)
        if order == 2:
            return pair[pair >= 0]
        arcs = known.value
        at = np.minimum(np.searchsorted(arcs, pair), max(0, len(arcs) - 1))
        fits = (arcs[at] == pair) if len(arcs) else np.zeros(len(pair), bool)
        return (pair[:-1] << _BITS | ids[2:])[fits[:-1] & fits[1:]]

    def count(batches: Batches) -> Batches:
        words = frequent.value
        held, size = [], 0

        def merged():
            return np.unique(np.concatenate([h[0] for h in held]), return_inverse=True), np.concatenate([h[1] for h in held])

        def out():
            (own, at), n = merged()
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(at, n, len(own)).astype(np.int64))], names=["code", "n"])

        def add(ids):
            nonlocal size
            own, n = np.unique(codes(np.array(ids, np.int64)), return_counts=True)
            held.append((own, n))
            size += len(own)

        for batch in batches:
            ids: list[int] = []
            for body in bytes_of(batch.column(0)):
                ids += words.ids(body)
                ids.append(-1)
                if len(ids) > GATHER:
                    add(ids)
                    ids = []
            if len(ids) > 2:
                add(ids)
            if size > 2 * GATHER:
                (own, at), n = merged()
                held[:] = [(own, np.bincount(at, n, len(own)).astype(np.int64))]
                size = len(own)
                if size > GATHER:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return train.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("c"))


def _kept(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Codes and counts of at least ``least``, and the discount that the numbers of entries seen once and twice give."""
    bucket = F.when(F.col("c") >= least, F.col("code")).otherwise(-F.least("c", F.lit(3)))
    rows = counts.groupBy(bucket.alias("code")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    seen = {1: 0, 2: 0}
    kept = []
    for code, c, n in rows:
        if code >= 0:
            kept.append((code, c))
        times = c if code >= 0 else -code
        if times in seen:
            seen[times] += n
    kept.sort()
    once, twice = seen[1], seen[2]
    discount = once / (once + 2 * twice) if once else DISCOUNT[0]
    codes, c = (np.array(x, np.int64) for x in zip(*kept)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return codes, c, min(DISCOUNT[1], max(DISCOUNT[0], discount))


class Automaton:
    """States, arcs and failure arcs. State 0 is the empty context, state i + 1 the frequent word i, later ones are bigrams.

    Weights are base-10 logarithms; those of arcs are relative to the word's unigram probability.
    """

    def __init__(self, counts: np.ndarray, total: int, bigrams, trigrams):
        (two, c2, d2), (three, c3, d3) = bigrams, trigrams
        unigram = (counts + 1) / total
        n = len(counts)
        self.codes: list[np.ndarray] = []
        before, word = two >> _BITS, two & _MASK
        p2 = (c2 - d2) / counts[before] if len(two) else np.zeros(0)
        left2 = 1 - np.bincount(before, p2, n)
        rest2 = 1 - np.bincount(before, unigram[word], n)
        alpha2 = np.maximum(left2, 1e-12) / np.maximum(rest2, 1e-12)
        open_ = np.bincount(before, minlength=n) > 0
        # Trigram contexts are bigrams with arcs, so they have a place in ``two``.
        context = np.searchsorted(two, three >> _BITS)
        last, middle = three & _MASK, (three >> _BITS) & _MASK
        p3 = (c3 - d3) / c2[context] if len(three) else np.zeros(0)
        shorter = middle << _BITS | last
        at = np.searchsorted(two, shorter)
        lower = p2[at] if len(three) else np.zeros(0)
        left3, rest3 = 1 - np.bincount(context, p3, len(two)), 1 - np.bincount(context, lower, len(two))
        alpha3 = np.maximum(left3, 1e-12) / np.maximum(rest3, 1e-12)
        contexts = np.unique(context)
        state_of = np.zeros(len(two), np.int64)
        state_of[contexts] = n + 1 + np.arange(len(contexts))
        word_state = np.where(open_, np.arange(n) + 1, 0)
        after2 = np.where(state_of > 0, state_of, word_state[word]) if len(two) else state_of
        self.root = word_state.tolist()
        self.back = [0.0, *np.where(open_, np.log10(alpha2), 0.0).tolist(), *np.log10(alpha3[contexts]).tolist()]
        self.fail = [0] * (n + 1) + word_state[word[contexts]].tolist()
        self.source = np.concatenate((before + 1, state_of[context])).astype(np.int64)
        self.label = np.concatenate((word, last)).astype(np.int64)
        self.weight = np.concatenate((np.log10(p2 / unigram[word]), np.log10(p3 / unigram[last])))
        self.target = np.concatenate((after2, after2[at] if len(three) else after2[:0])).astype(np.int64)
        self.logs = np.log10(counts + 1).tolist()
        self.arcs = None

    def adjustment(self, ids: list[int], start: int) -> float:
        """What the model's log-probability of the text adds to that of the unigrams."""
        if self.arcs is None:
            keys = (self.source << _BITS | self.label).tolist()
            self.arcs = dict(zip(keys, zip(self.weight.tolist(), self.target.tolist())))
        arc, back, fail, root = self.arcs.get, self.back, self.fail, self.root
        state, total = (root[start] if start >= 0 else 0), 0.0
        for w in ids:
            if w < 0:
                while state:
                    total += back[state]
                    state = fail[state]
                continue
            while state:
                found = arc(state << _BITS | w)
                if found is not None:
                    total += found[0]
                    state = found[1]
                    break
                total += back[state]
                state = fail[state]
            else:
                state = root[w]
        return total


class Model:
    """What training gives: exact word counts as a table, and the automaton of frequent grams."""

    def __init__(self, words: DataFrame, tokens: int, types: int, least: int, frequent, automaton):
        self.words, self.tokens, self.types, self.least, self.frequent, self.automaton = words, tokens, types, least, frequent, automaton

    @property
    def total(self) -> int:
        """Denominator of the unigram probabilities."""
        return self.tokens + self.types + 1


class Words:
    """Numbers from 1 of the most frequent words, with their counts; any other word is known by 62 bits of its hash, as a negative key.

    Numbers are found by these bits as well.
    """

    def __init__(self, words: list[bytes], counts: list[int]):
        self.words = pa.array(words, pa.binary())
        self.counts = np.array([0, *counts], np.int64)
        hashes = _hashed(self.words)
        order = np.argsort(hashes)
        self.hashes, self.numbers = np.append(hashes[order], _LAST), np.append(order + 1, 0)
        self.end = self.of(pa.array([END], pa.binary()))

    def of(self, words: pa.Array) -> np.ndarray:
        """The keys of words."""
        hashes = _hashed(strings(words).cast(pa.binary()))
        at = np.searchsorted(self.hashes, hashes)
        return np.where(self.hashes[at] == hashes, self.numbers[at], hashes)

    def keys(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the words of all texts, each between the end of the text before and its own, and the place of their text."""
        words, sizes = split_words(column)
        distinct = words.dictionary_encode()
        texts = np.arange(len(sizes))
        ids = np.repeat(self.end, len(words) + 2 * len(sizes))
        ids[np.arange(len(words)) + 2 * np.repeat(texts, sizes) + 1] = self.of(distinct.dictionary)[distinct.indices.to_numpy()]
        return ids, np.repeat(texts, sizes + 2)


def _hashed(words: pa.Array) -> np.ndarray:
    """62 bits of a hash of each word, negative: the sum of well-spread numbers of its bytes and their places, spread again."""
    _, offsets, data = words.buffers()
    if not len(words):
        return np.zeros(0, np.int64)
    bounds = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    body = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]].astype(np.int64)
    sizes = np.diff(bounds)
    place = np.arange(len(body)) - np.repeat(bounds[:-1] - bounds[0], sizes)
    sums, some = sizes.astype(np.uint64), sizes > 0
    if len(body):
        sums[some] += np.add.reduceat(_mixed(place << 8 | body + 1 << 40), (bounds[:-1] - bounds[0])[some])
    return (_mixed(sums.view(np.int64)) & np.uint64(_HASH) | np.uint64(_SIGN)).view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64 bits of a number."""
    x = x.astype(np.int64, copy=False).view(np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _far(first: np.ndarray, second: np.ndarray, trigram: bool) -> np.ndarray:
    """Keys of grams with a word without a number: 62 bits of a hash, negative, and a bit that tells trigrams."""
    h = _mixed((_mixed(first) * np.uint64(0x9E3779B97F4A7C15) + second.view(np.uint64)).view(np.int64)) & np.uint64(_HASH)
    return (h | np.uint64(1 << 63 | trigram << 62)).view(np.int64)


def _bigrams(ids: np.ndarray) -> np.ndarray:
    """Keys of all neighbours: both numbers, or a hash."""
    a, b = ids[:-1], ids[1:]
    keys, far = _TWO | a << _BITS | b, (a < 0) | (b < 0)
    keys[far] = _far(a[far], b[far], False)
    return keys


def _trigrams(ids: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    a, b = pairs[:-1], ids[2:]
    keys, far = _THREE | (a & _PAIR) << _BITS | b, (a < 0) | (b < 0)
    keys[far] = _far(a[far], b[far], True)
    return keys


def _packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Eight-byte values, compressed by byte place; ascending ones as differences."""
    if ascending and len(values):
        values = np.concatenate((values[:1], np.diff(values)))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, kind=np.int64, ascending: bool = False) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(8, n).T).view(kind).ravel()
    return np.cumsum(values) if ascending else values


def _by_part(keys: np.ndarray, parts: int):
    """Places of ascending keys, part by part; they ascend in each."""
    part = (_mixed(keys) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    return [(k, order[bounds[k] : bounds[k + 1]]) for k in range(parts) if bounds[k] < bounds[k + 1]]


_COUNTED = T.StructType([T.StructField("part", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("keys", "counts", "befores", "shorters")],
                         *[T.StructField(c, T.LongType()) for c in ("once2", "once3")]])
_GRAMS = "key long, size int, before long, shorter long, c_before long, c_word long, c long, n long"


def count_grams(train: DataFrame, words, seen: Filter, tokens: int, text: str = "text") -> DataFrame:
    """``(key, size, before, shorter, c_before, c_word, c, n)``, stored: the bigrams and trigrams seen ``LEAST`` times, and per size and count null keys for the ``n`` others.

    A gram with a word that training saw once was seen once itself, so it is only added to their number. ``before`` and ``shorter`` are the keys of the
    gram without its last and first word, null where they can be read off the key; there bigrams have the counts of their words.
    """
    parts = max(1, -(-2 * tokens // PART))

    def count(batches: Batches) -> Batches:
        held, size, once = [], 0, [0, 0]

        def out():
            arrays = [np.concatenate(x) for x in zip(*held)]
            keys, n = np.unique(arrays[0], return_counts=True)
            # Far keys come first; the others tell what they are made of.
            _, first = np.unique(arrays[1], return_index=True)
            rows = []
            for part, at in _by_part(keys, parts):
                far = first[at[: np.searchsorted(keys[at], 0)]]
                rows.append((part, _packed(keys[at], True), _packed(n[at]), _packed(arrays[2][far]), _packed(arrays[3][far]), 0, 0))
            rows.append((0, None, None, None, None, *once))
            held.clear()
            once[:] = 0, 0
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows), _types(_COUNTED))], names=_COUNTED.names)

        for batch in batches:
            ids, doc = words.value.keys(batch.column(0))
            pairs = _bigrams(ids)
            alone = ids < 0
            alone[alone] = ~seen.value.may_have(ids[alone])
            for k, keys, before, shorter in ((2, pairs, ids[:-1], ids[1:]), (3, _trigrams(ids, pairs), pairs[:-1], pairs[1:])):
                inside = doc[: len(keys)] == doc[k - 1 :]
                single = np.logical_or.reduce([alone[i : len(keys) + i] for i in range(k)])
                once[k - 2] += int((inside & single).sum())
                live = inside & ~single
                far = live & (keys < 0)
                held.append((keys[live], keys[far], before[far], shorter[far]))
                size += int(live.sum())
            if size > 2 * GATHER:
                yield out()
                size = 0
        if held:
            yield out()

    def merge(batches: Batches) -> Batches:
        kept, once = {}, [0, 0]
        for batch in batches:
            for row in batch.to_pylist():
                once = [once[0] + row["once2"], once[1] + row["once3"]]
                if row["keys"] is not None:
                    kept.setdefault(row["part"], []).append((row["keys"], row["counts"], row["befores"], row["shorters"]))

        def table(size, c, n, keys=None, before=None, shorter=None):
            none, two = pa.nulls(len(c), pa.int64()), np.asarray(size) != 2
            counts = [None, None] if keys is None or before is not None else [
                pa.array(words.value.counts[np.where(two, 0, k & _MASK)], pa.int64(), mask=two) for k in (keys >> _BITS, keys)]
            given = [none if x is None else pa.array(x, pa.int64()) for x in (keys, before, shorter, *counts)]
            columns = [given[0], pa.array(size, pa.int32()), *given[1:], pa.array(c, pa.int64()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _GRAMS.split(", ")])

        others = Counter({(2, 1): once[0], (3, 1): once[1]})
        for part in sorted(kept):
            blobs = kept.pop(part)
            keys = [_unpacked(b[0], ascending=True) for b in blobs]
            far = [np.searchsorted(k, 0) for k in keys]
            n = [_unpacked(b[1]) for b in blobs]
            wide = [np.concatenate([_unpacked(b[i]) for b in blobs]) for i in (2, 3)]
            near = [k[f:] for k, f in zip(keys, far)], [c[f:] for c, f in zip(n, far)]
            keys, n = [k[:f] for k, f in zip(keys, far)], [c[:f] for c, f in zip(n, far)]
            for own, counts, given in ((keys, n, wide), (*near, None)):
                own, counts = np.concatenate(own), np.concatenate(counts)
                if not len(own):
                    continue
                order = np.argsort(own)
                ordered = own[order]
                starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
                sums, ordered, first = np.add.reduceat(counts[order], starts), ordered[starts], order[starts]
                size = np.where(ordered < 0, 2 + (ordered >> 62 & 1), np.where(ordered >= _THREE, 3, 2))
                for k in (2, 3):
                    for c, times in zip(*np.unique(sums[(size == k) & (sums < LEAST)], return_counts=True)):
                        others[k, int(c)] += int(times)
                ok = sums >= LEAST
                for i in range(0, int(ok.sum()), BATCH):
                    at = np.flatnonzero(ok)[i : i + BATCH]
                    before, shorter = (None, None) if given is None else (x[first[at]] for x in given)
                    yield table(size[at], sums[at], np.ones(len(at), np.int64), ordered[at], before, shorter)
        rows = [(k, c, t) for (k, c), t in sorted(others.items()) if t]
        if rows:
            yield table([r[0] for r in rows], [r[1] * r[2] for r in rows], [r[2] for r in rows])

    found = train.select(F.col(text).alias("text")).mapInArrow(count, _COUNTED)
    return stage(found.repartitionById(parts, "part").mapInArrow(merge, _GRAMS), "grams")


def _types(schema: T.StructType) -> list[pa.DataType]:
    of = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return [of[f.dataType.simpleString()] for f in schema.fields]


def _weights(words: DataFrame, grams: DataFrame, total: int, discounts: dict[int, float], path: str) -> None:
    """Store ``(key, c, logs, more)``: what a gram adds to the unigram score, if it is a word, and to the rest of the score."""

    def backoff(p: Column, lower: Column) -> Column:
        """Base-10 logarithm of the backoff weight of a context, from the sums over its arcs."""
        return F.log10(F.greatest(1 - p, F.lit(1e-12)) / F.greatest(1 - lower, F.lit(1e-12)))

    of = {k: grams.filter(F.col("key").isNotNull() & (F.col("size") == k)) for k in (2, 3)}
    two = of[2].withColumns({
        "before": F.coalesce("before", F.shiftright("key", _BITS).bitwiseAND(_MASK)), "word": F.coalesce("shorter", F.col("key").bitwiseAND(_MASK)),
    }).drop("shorter")
    # A word of a gram seen so often was seen as often itself.
    often = words.filter(F.col("c") >= LEAST)
    near, far = two.filter(F.col("c_before").isNotNull()), two.filter(F.col("c_before").isNull()).drop("c_before", "c_word")
    far = far.join(often.select(F.col("key").alias("before"), F.col("c").alias("c_before")), "before")
    far = far.join(often.select(F.col("key").alias("word"), F.col("c").alias("c_word")), "word")
    two = near.unionByName(far).select(
        "key", "c", "before", ((F.col("c") - discounts[2]) / F.col("c_before")).alias("p"), ((F.col("c_word") + 1) / total).alias("lower")
    )
    two = stage(two, "bigrams")
    back = stage(two.groupBy("before").agg(backoff(F.sum("p"), F.sum("lower")).alias("back")), "backoff")
    # Words seen less often begin no gram with an arc.
    one = often.join(back.withColumnRenamed("before", "key"), "key", "left").unionByName(words.filter(F.col("c") < LEAST).withColumn("back", F.lit(None).cast("double")))
    one.select("key", "c", F.log10(F.col("c") + 1).alias("logs"), F.coalesce("back", F.lit(0.0)).alias("more")).write.parquet(path)
    # Numbered words are so few that their backoff weights are sent to every task.
    numbered, arc = F.col("before") > 0, F.log10(F.col("p") / F.col("lower")) - F.col("back")
    states = two.filter(numbered).join(F.broadcast(back.filter(numbered)), "before").unionByName(two.filter(~numbered).join(back.filter(~numbered), "before"))
    states = states.select(F.col("key").alias("context"), F.lit(None).cast("long").alias("key"), "c", arc.alias("arc"))
    three = of[3].select(
        "key", "c", F.coalesce("before", F.shiftright("key", _BITS).bitwiseAND(_PAIR).bitwiseOR(_TWO)).alias("context"),
        F.coalesce("shorter", F.col("key").bitwiseAND(_PAIR).bitwiseOR(_TWO)).alias("shorter"),
    )
    three = three.join(two.select(F.col("key").alias("shorter"), F.col("p").alias("arc")), "shorter").select("context", "key", "c", "arc")
    # A bigram meets the trigrams that it is the context of, whose shorter arcs stand in its place; each gets its weight there.
    by, trigram = Window.partitionBy("context"), F.col("key").isNotNull()
    met = states.unionByName(three).withColumns({
        "seen": F.max(F.when(~trigram, F.col("c"))).over(by), "arcs": F.count("key").over(by),
        "times": F.sum(F.when(trigram, F.col("c"))).over(by), "lower": F.sum(F.when(trigram, F.col("arc"))).over(by),
    })
    own = backoff((F.col("times") - F.col("arcs") * discounts[3]) / F.col("seen"), F.col("lower"))
    more = F.when(trigram, F.log10((F.col("c") - discounts[3]) / F.col("seen") / F.col("arc")) - own).otherwise(F.col("arc") + F.when(F.col("arcs") > 0, own).otherwise(0.0))
    met.select(F.coalesce("key", "context").alias("key"), "c", F.lit(0.0).alias("logs"), more.alias("more")).write.mode("append").parquet(path)


def _gathered(batches: Batches, columns: int) -> Iterator[list[np.ndarray]]:
    """The columns of many batches at a time, as numbers."""
    held, size = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(columns)])
        size += batch.num_rows
        if size > GATHER // 4:
            yield [np.concatenate(c) for c in zip(*held)]
            held, size = [], 0
    if size:
        yield [np.concatenate(c) for c in zip(*held)]


class Filter:
    """Bits of the keys of a table; each sets two of them, in one word."""

    def __init__(self, keys: DataFrame, n: int):
        places = self.places = min(FILTER_BITS, 1 << max(6, (16 * n).bit_length()))
        self.bits = np.zeros(places >> 6, np.uint64)
        if not n:
            return

        def block_rows(bits: np.ndarray) -> Batches:
            for at in range(0, len(bits), BLOCK):
                if bits[at : at + BLOCK].any():
                    blob = pa.compress(bits[at : at + BLOCK].tobytes(), codec="zstd", asbytes=True)
                    yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([blob])], names=["block", "bits"])

        def spread(batches: Batches) -> Batches:
            bits = np.zeros(places >> 6, np.uint64)
            for keys, in _gathered(batches, 1):
                np.bitwise_or.at(bits, *_places(keys, places))
            yield from block_rows(bits)

        def unite(batches: Batches) -> Batches:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    bits = np.frombuffer(pa.decompress(blob, 8 * min(BLOCK, places >> 6), codec="zstd", asbytes=True), np.uint64)
                    held[block] = held[block] | bits if block in held else bits
            for block, bits in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()])], names=["block", "bits"])

        blocks = keys.select("key").mapInArrow(spread, "block int, bits binary").repartitionById(max(1, (places >> 6) // BLOCK), "block")
        for block, bits in zip(*(c.to_pylist() for c in blocks.mapInArrow(unite, "block int, bits binary").toArrow().columns)):
            self.bits[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(bits, np.uint64)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        word, own = _places(keys, self.places)
        return self.bits[word] & own == own


def _places(keys: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key, and its bits there."""
    h, one, six = _mixed(_mixed(keys).view(np.int64)), np.uint64(1), np.uint64(63)
    return (h >> np.uint64(12) & np.uint64((places >> 6) - 1)).view(np.int64), one << (h & six) | one << (h >> np.uint64(6) & six)


class Hot:
    """Weights that are looked up in the task: those of the numbered words, by number, and of the hottest words without one and grams."""

    def __init__(self, rows: pa.Table, numbered: int):
        key, logs, more = (rows[c].to_numpy() for c in ("key", "logs", "more"))
        word = (key > 0) & (key <= _MASK)
        self.word_logs, self.word_more = np.zeros(numbered + 1), np.zeros(numbered + 1)
        self.word_logs[key[word]], self.word_more[key[word]] = logs[word], more[word]
        order = np.flatnonzero(~word)
        order = order[np.argsort(key[order])]
        self.keys, self.logs, self.more = (np.append(c[order], x) for c, x in ((key, _LAST), (logs, 0.0), (more, 0.0)))
        # Most keys are not here, as 20 bits of them tell.
        self.some = np.zeros(1 << 20, bool)
        self.some[_mixed(self.keys) >> np.uint64(44)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the keys, none of them a number, are here, and the weights of these."""
        there = self.some[_mixed(keys) >> np.uint64(44)]
        near = keys[there]
        at = np.searchsorted(self.keys, near)
        fits = self.keys[at] == near
        there[there] = fits
        return there, self.logs[at[fits]], self.more[at[fits]]


class GramTable:
    """What training gives: the weights of all grams as a table; those of the hottest, the numbered words and the filter in the tasks."""

    def __init__(self, table: DataFrame, tokens: int, types: int, words, hot, sieve):
        self.table, self.tokens, self.types, self.words, self.hot, self.sieve = table, tokens, types, words, hot, sieve

    @property
    def total(self) -> int:
        """Denominator of the unigram probabilities."""
        return self.tokens + self.types + 1

    @property
    def weights(self) -> DataFrame:
        """``(gram, c, logs, more)`` with the words of a gram joined by a space; null if one of them has no number."""
        words = self.words

        def spell(batches: Batches) -> Batches:
            own = [None, *words.value.words.to_pylist()]
            for batch in batches:
                keys, grams = batch.column(0).to_pylist(), []
                for k in keys:
                    n = 0 if k < 0 else 3 if k >= _THREE else 2 if k >= _TWO else 1
                    grams.append(b" ".join(own[k >> _BITS * i & _MASK] for i in range(n - 1, -1, -1)).decode() if n else None)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *batch.columns[1:]], names=["gram", "c", "logs", "more"])

        return self.table.select("key", "c", "logs", "more").mapInArrow(spell, "gram string, c long, logs double, more double")


def train(docs: DataFrame, text: str = "text", word_share: float | None = None, gram_share: float | None = None) -> GramTable | Model:
    """Learn from all texts of ``docs``; with shares, the automaton of the frequent grams."""
    if word_share is not None and gram_share is not None:
        return train_frequent(docs, text, word_share, gram_share)
    if word_share is not None or gram_share is not None:
        raise ValueError("give both shares or none")
    spark = docs.sparkSession
    _prepare(spark)
    # The weights outlive what is stored on the way to them.
    path = staging_path(spark, "weights")
    with staging_scope(spark), shuffles_removed(spark):
        words = count_words(docs, text)
        times = sorted(((r["c"], r["n"]) for r in words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        tokens, types = sum(c * n for c, n in times), sum(n for _, n in times)
        # The most frequent words get numbers; words seen equally often get them together.
        least, room, others = math.inf, NUMBERED, 0
        for c, n in times:
            room -= n
            if c < LEAST:
                break
            if room >= 0:
                least = c
            else:
                others += n
        top = sorted(((c, w) for w, c in words.filter(F.col("c") >= least).collect()), key=lambda x: (-x[0], x[1])) if least < math.inf else []
        known = spark.sparkContext.broadcast(Words([w.encode("utf-8", "surrogatepass") for _, w in top], [c for c, _ in top]))

        def keyed(batches: Batches) -> Batches:
            for batch in batches:
                keys = known.value.of(batch.column(0).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(1)], names=["key", "c"])

        words = stage(words.select("word", "c").mapInArrow(keyed, "key long, c long"), "keys")
        repeated = words.filter(F.col("c") >= LEAST)
        seen = spark.sparkContext.broadcast(Filter(repeated.filter(F.col("key") < 0), others))
        grams = count_grams(docs, known, seen, tokens, text)
        once, twice = (F.sum(F.when((F.col("c") / F.col("n")) == k, F.col("n"))) for k in (1, 2))
        of = {r["size"]: r for r in grams.groupBy("size").agg(once.alias("once"), twice.alias("twice")).collect()}
        discounts = {}
        for k in (2, 3):
            has = [(of[k][x] or 0) if k in of else 0 for x in ("once", "twice")]
            found = has[0] / (has[0] + 2 * has[1]) if has[0] else DISCOUNT[0]
            discounts[k] = min(DISCOUNT[1], max(DISCOUNT[0], found))
        _weights(words, grams, tokens + types + 1, discounts, path)
    weights = spark.read.schema("key long, c long, logs double, more double").parquet(path)
    # At most one over the share of each size, and the numbered words.
    is_hot = F.col("key").between(1, _MASK) | (F.col("c") >= max(1, math.ceil(HOT_SHARE * tokens)))
    hot, cold = Hot(weights.filter(is_hot).toArrow(), len(top)), weights.filter(~is_hot)
    return GramTable(weights, tokens, types, known, spark.sparkContext.broadcast(hot), spark.sparkContext.broadcast(Filter(cold, cold.count())))


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Files of a shuffle go when the query that made them ends; what is read again is stored by then."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def train_frequent(docs: DataFrame, text: str, word_share: float, gram_share: float) -> Model:
    """Learn the automaton of the words and grams that make up these shares of the training tokens."""
    spark = docs.sparkSession
    prepare(spark)
    if word_share < 1 / _MASK or gram_share <= 0:
        raise ValueError(f"shares must be positive; that of words at least 1 / {_MASK}")
    rows = docs.select(F.col(text).alias("text"))
    words = count_words(rows)
    tokens, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(1, math.ceil(word_share * tokens))
    # At most one over the share.
    top = sorted(((c, w) for w, c in words.filter(F.col("c") >= least).collect()), key=lambda x: (-x[0], x[1]))
    known = Frequent([w.encode("utf-8", "surrogatepass") for _, w in top], [c for c, _ in top])
    frequent = spark.sparkContext.broadcast(known)
    enough = max(1, math.ceil(gram_share * tokens))
    bigrams = _kept(_gram_counts(rows, frequent, 2, None), enough)
    trigrams = _kept(_gram_counts(rows, frequent, 3, spark.sparkContext.broadcast(bigrams[0])), enough)
    automaton = spark.sparkContext.broadcast(Automaton(known.counts, tokens + types + 1, bigrams, trigrams))
    return Model(words, tokens, types, least, frequent, automaton)


_COLD = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]))


def _walk(model: Model):
    """The same by a traversal of the automaton of the frequent grams; the others are the rare words."""

    def run(bodies: list[bytes | None]):
        words, states = frequent.value, automaton.value
        get, logs = words.number.get, states.logs
        start = get(END, -1)
        for body in bodies:
            own = tokens_of(body)
            ids = [get(w, -1) for w in own]
            seen = [i for i in ids if i >= 0]
            yield (len(own), len(seen), math.fsum([logs[i] for i in seen]), states.adjustment(ids, start)), Counter([w for w, i in zip(own, ids) if i < 0])

    frequent, automaton = model.frequent, model.automaton
    return run


def _score_grams(df: DataFrame, model: GramTable, inner: list[str]) -> DataFrame:
    """``inner``, ``n_tokens``, ``seen``, ``logs`` and ``more`` of every text.

    Hot grams are looked up where the text is. The keys of the others that pass the filter go to the weights with the number of their text, many in a
    row, sorted and compressed; what comes back is a sum per text and part of the weights.
    """
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-model.tokens // MEETING))
    words, hot, sieve = model.words, model.hot, model.sieve
    sums = [T.StructField("n_tokens", T.LongType()), T.StructField("seen", T.LongType()), T.StructField("logs", T.DoubleType()), T.StructField("more", T.DoubleType())]
    asked = [T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("kind", T.IntegerType())]
    blobs = [T.StructField(c, T.BinaryType()) for c in ("keys", "first", "second")]
    # Rows of keys have none of the columns of a text.
    carried = [T.StructField(c, df.schema[c].dataType) for c in inner]
    schema = T.StructType(carried + sums + asked + blobs)
    result = T.StructType(carried + sums + [T.StructField("row", T.LongType()), T.StructField("kind", T.IntegerType())])
    filled = [f.name for f in sums + asked + blobs]

    def rows(columns: dict, n: int, kinds: dict, fields: T.StructType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, kinds[f.name])) for f in fields], names=fields.names)

    def ask(batches: Batches) -> Batches:
        """A row per text with the sums of its hot grams, and packed keys of the others; kinds 2 and 1."""
        from pyspark import TaskContext

        next_row, held, size = TaskContext.get().partitionId() << 33, [], 0
        kinds: dict = dict(zip(filled, _types(T.StructType(sums + asked + blobs))))

        def out():
            keys, row = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(keys)
            keys, row, base = keys[order], row[order], int(row.min())
            found = [(part, base, 1, _packed(keys[at], True), _packed(row[at] - base)) for part, at in _by_part(keys, parts)]
            names = ("part", "row", "kind", "keys", "first")
            return rows({c: pa.array(v, kinds[c]) for c, v in zip(names, zip(*found))}, len(found), kinds, schema)

        for batch in batches:
            kinds |= {c: batch.schema.field(c).type for c in inner}
            n = batch.num_rows
            ids, doc = words.value.keys(batch.column(batch.schema.get_field_index("text")))
            pairs = _bigrams(ids)
            start = np.concatenate(([True], doc[1:] != doc[:-1])) if n else np.zeros(0, bool)
            word, owner = ids[~start], doc[~start]
            numbered = word > 0
            near, number = owner[numbered], word[numbered]
            logs = hot.value.word_logs[number]
            of = [np.bincount(owner, minlength=n), np.bincount(near[logs > 0], minlength=n), np.bincount(near, logs, n), np.bincount(near, hot.value.word_more[number], n)]
            rest = [(word[~numbered], owner[~numbered])]
            rest += [(k[inside], doc[: len(k)][inside]) for k, by in ((pairs, 1), (_trigrams(ids, pairs), 2)) for inside in [doc[: len(k)] == doc[by:]]]
            for keys, owner in rest:
                there, logs, more = hot.value.find(keys)
                near = owner[there]
                of[1:] = [a + b for a, b in zip(of[1:], (np.bincount(near[logs > 0], minlength=n), np.bincount(near, logs, n), np.bincount(near, more, n)))]
                cold, owner = keys[~there], owner[~there]
                fits = sieve.value.may_have(cold)
                held.append((cold[fits], owner[fits] + next_row))
                size += int(fits.sum())
            own = {f.name: pa.array(v.astype(t.to_pandas_dtype()), t) for f, v, t in zip(sums, of, _types(T.StructType(sums)))}
            place = np.arange(next_row, next_row + n)
            own |= {"part": pa.array(place % parts, pa.int32()), "row": pa.array(place, pa.int64()), "kind": pa.array(np.full(n, 2), pa.int32())}
            yield rows({**own, **{c: batch.column(batch.schema.get_field_index(c)) for c in inner}}, n, kinds, schema)
            next_row += n
            if size > GATHER // 4:
                yield out()
                size = 0
        if size:
            yield out()

    def share(batches: Batches) -> Batches:
        """The weights, packed; kind 0, words apart from longer grams."""
        kinds = _types(T.StructType(asked + blobs))
        for keys, logs, more in _gathered(batches, 3):
            found = []
            for word in (True, False):
                own = np.flatnonzero((logs > 0) == word)
                own = own[np.argsort(keys[own])]
                for part, at in _by_part(keys[own], parts):
                    at = own[at]
                    found.append((part, 0, 0, _packed(keys[at], True), _packed(more[at]), _packed(logs[at]) if word else None))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=[f.name for f in asked + blobs])

    def answer(batches: Batches) -> Batches:
        """Weights come first; then every row of keys becomes a row of sums per text."""
        given: dict[bool, list] = {True: [], False: []}
        tables = None
        for batch in batches:
            kinds = {f.name: f.type for f in batch.schema}
            kind = batch.column(batch.schema.get_field_index("kind")).to_numpy()
            of = lambda c: batch.column(batch.schema.get_field_index(c))
            for i in np.flatnonzero(kind < 2):
                keys, first, second = (of(c)[i].as_py() for c in ("keys", "first", "second"))
                if kind[i] == 0:
                    logs = None if second is None else _unpacked(second, np.float64)
                    given[second is not None].append((_unpacked(keys, ascending=True), _unpacked(first, np.float64), logs))
                    continue
                tables = tables or [_sorted(given.pop(k), k) for k in (True, False)]
                keys, owner = _unpacked(keys, ascending=True), _unpacked(first)
                n = int(owner.max()) + 1
                sum_of = np.zeros((3, n))
                for table_, more, logs in tables:
                    at = np.searchsorted(table_, keys)
                    there = table_[at] == keys
                    sum_of[2] += np.bincount(owner[there], more[at[there]], n)
                    if logs is not None:
                        sum_of[:2] += np.bincount(owner[there], minlength=n), np.bincount(owner[there], logs[at[there]], n)
                some = np.flatnonzero(np.bincount(owner, minlength=n))
                found = {"seen": pa.array(sum_of[0, some].astype(np.int64)), "logs": pa.array(sum_of[1, some]), "more": pa.array(sum_of[2, some]),
                         "row": pa.array(some + of("row")[i].as_py()), "kind": pa.array(np.full(len(some), 1), pa.int32())}
                yield rows(found, len(some), kinds, result)
            texts = pa.array(kind == 2)
            yield pa.RecordBatch.from_arrays([of(f.name).filter(texts) for f in result], names=result.names)

    cold = model.table.filter(~(F.col("key").between(1, _MASK))).select("key", "logs", "more")
    packed = cold.mapInArrow(share, T.StructType(asked + blobs))
    met = df.mapInArrow(ask, schema).unionByName(packed, allowMissingColumns=True).repartitionById(parts, "part").sortWithinPartitions("kind")
    found = met.mapInArrow(answer, result)
    text = F.first(F.when(F.col("kind") == 2, F.struct(*inner, "n_tokens")), ignorenulls=True)
    summed = found.groupBy("row").agg(text.alias("text"), *[F.sum(c).alias(c) for c in ("seen", "logs", "more")])
    return summed.select("text.*", "seen", "logs", "more")


def _sorted(given: list, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Keys in order with their weights, and one key at the end that no gram has."""
    if not given:
        return np.array([_LAST]), np.zeros(1), np.zeros(1) if words else None
    keys, more, logs = zip(*given)
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    ends = lambda x: np.append(np.concatenate(x)[order], 0.0)
    return np.append(keys[order], _LAST), ends(more), ends(logs) if words else None


def score(docs: DataFrame, model: GramTable | Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all, if None) with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    _prepare(docs.sparkSession)
    columns = without(docs.select(keep) if keep is not None else docs, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    inner = [f"c{i}" for i in range(len(columns))]
    df = docs.select(*[F.col(c).alias(i) for c, i in zip(columns, inner)], F.col(text).alias("text"))
    if isinstance(model, GramTable):
        found = _score_grams(df, model, inner)
        base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(model.total))
        return found.select(
            *[F.col(i).alias(c) for c, i in zip(columns, inner)], "n_tokens", F.col("seen").alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("more")).alias("score"),
        )
    found_in = _walk(model)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("seen", T.LongType()), T.StructField("logs", T.DoubleType()), T.StructField("more", T.DoubleType()), T.StructField("cold", _COLD)]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows, rare_words, rare_counts, offsets = [], [], [], [0]
            for row, rare in found_in(bytes_of(batch.column(batch.schema.get_field_index("text")))):
                rare_words += rare
                rare_counts += rare.values()
                offsets.append(len(rare_words))
                rows.append(row)
            cold = pa.StructArray.from_arrays([strings(rare_words), pa.array(rare_counts, pa.int64())], names=["word", "n"])
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            parts = {f.name: pa.array([r[k] for r in rows], kind) for k, (f, kind) in enumerate(zip(fields, kinds))}
            parts["cold"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cold)
            yield rows_to_batch(batch, inner, parts)

    schema = T.StructType([df.schema[c] for c in inner] + fields)
    walked = stage(df.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "walked")
    rare = walked.select("row", F.explode("cold").alias("cold")).select("row", "cold.word", "cold.n")
    # Words that training never saw add nothing, as log10(0 + 1) is 0: they need no partner.
    weights = model.words.filter(F.col("c") < model.least).select("word", F.log10(F.col("c") + 1).alias("log"))
    sums = rare.join(weights, "word").groupBy("row").agg(F.sum("n").alias("rare_seen"), F.sum(F.col("n") * F.col("log")).alias("rare_logs"))
    base = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(model.total))
    return walked.drop("cold").join(sums, "row", "left").select(
        *[F.col(i).alias(c) for c, i in zip(columns, inner)], "n_tokens", (F.col("seen") + F.coalesce("rare_seen", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("more")).alias("score"),
    )


@query("op6_lm_score")
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), FOLDS))
    return score(docs, train(docs.filter(~F.col("held_out"))), keep=["doc_id", "held_out"])
