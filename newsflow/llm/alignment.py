"""Alignment of two tokenizers over the same bytes.

Both tokenizers cut a text's bytes into tokens. The tokens of both sides are tables of (document, start, id), and
``pandas.merge_asof``, keyed by document, finds for every token start the token of the other side that covers it. The
union of both directions is the set of overlapping pairs, each once; offsets where tokens of both sides end cut the text into groups.

Texts are encoded in segments: a single space between two printable ASCII characters always ends a token on both sides (the byte-level
side starts its next word there; no piece of the other side goes on over a space, which is checked when the vocabulary is loaded). So a text has
the same tokens whole or by segment, and tokens of both sides end with it: no group and no link goes over its end. So a segment is a document of its own to the
joins, it is encoded and aligned once however often it comes, and a text's counts, groups and links are those of its segments put together,
in parts of bounded size for a long text.

Links between ids are counted corpus-wide: each document brings its distinct pairs with their counts, the sums meet each document's
pairs again in a lookup join, which broadcasts a small pair table and spares hot pairs the shuffle of a large one.

Defined results: a text that is null or empty, or whose tokens don't spell its bytes on both sides, has no tokens and zeros in all
counts; repeated rows are counted as often as they occur; an empty table gives no rows; further columns, whatever their names, are ignored unless kept.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsflow.llm.common import prepare, query, schema_with, stage, table, without
from newsflow.operators.lookup import lookup_join

TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at once, and segments that a worker remembers with their tokens.
PART_BYTES = 1 << 20
REMEMBERED = 1 << 18
#: New segments that are aligned at once.
ALIGNED = 1 << 15

_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
# Fixed value: the word rule of byte-level vocabularies.
_WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RESULT = [
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()),
    T.StructField("n_links", T.LongType()), T.StructField("groups", T.StringType()),
    T.StructField("pairs", T.ArrayType(T.StructType([
        T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("times", T.LongType()),
    ]))),
]


def _byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers from the contents of their files, and the bytes of every token."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        import sentencepiece
        import tiktoken
        import tokenizers

        self.a = tokenizers.Tokenizer.from_buffer(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        alphabet = _byte_alphabet()
        words = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in word) if all(c in alphabet for c in word) else word.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        # Where ids follow the order of the merges, ASCII text is encoded by rank, which gives the same ids in less time.
        rules = json.loads(byte_level)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in rules["model"]["merges"]]
        ranks = {self.a_bytes[i]: i for i in range(256 + len(merged))}
        cut = rules["pre_tokenizer"] or {}
        plain = rules["normalizer"] is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        ordered = plain and len(ranks) == 256 + len(merged) and all(words.get(w) == 256 + k for k, w in enumerate(merged))
        self.ranked = tiktoken.Encoding("ranked", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}) if ordered else None
        # Segments may be encoded alone if no piece goes on over a space.
        self.cuts = not any(b" " in p.lstrip(b" ") for p in self.b_bytes)
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.forget()

    def forget(self) -> None:
        """Numbers of the segments seen so far, those that are not spelt by their tokens, and for each what its alignment gave."""
        self.number: dict[str, int] = {}
        self.misspelt: set[int] = set()
        # Per segment the numbers of tokens, groups and links and its groups as text; its links as keys, one after another, and where each segment's end.
        self.counts = array("q")
        self.groups: list[bytes] = []
        self.keys, self.ends = array("q"), array("q", [0])

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, found: Iterable[str]) -> None:
        """Give every new segment a number, and align it."""
        new = [s for s in dict.fromkeys(found) if s not in self.number]
        for group in ([s for s in new if s.isascii()], [s for s in new if not s.isascii()]):
            if group and not self._encode_joined(group):
                for s in group:
                    if not self._encode_joined([s]):
                        self.misspelt.add(len(self.number))
                        self._add([s], [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2)

    def _byte_ids(self, text: str) -> list[int]:
        if self.ranked and text.isascii():
            return self.ranked.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def _encode_joined(self, new: list[str]) -> bool:
        """Encode segments as one text and cut it where they end; false, and nothing done, if its tokens don't spell it or don't end there."""
        text = " ".join(new)
        spelt = (" " + text).encode()
        stops = np.cumsum(np.fromiter((len(s) for s in new), np.int64, len(new)) if text.isascii() else [len(s.encode()) for s in new]) + np.arange(1, len(new) + 1)
        tokens, cuts = [], []
        for side, ids in enumerate((self._byte_ids(" " + text), self.b.encode(text))):
            own = np.array(ids, np.int32)
            ends = np.cumsum((self.a_size, self.b_size)[side][own])
            cut = np.searchsorted(ends, stops)
            if b"".join(map((self.a_bytes, self.b_bytes)[side].__getitem__, ids)) != spelt or not (ends[cut] == stops).all():
                return False
            tokens.append(own)
            cuts.append(cut + 1)
        self._add(new, tokens, cuts)
        return True

    def _add(self, new: list[str], tokens: list[np.ndarray], cuts: list[np.ndarray]) -> None:
        first = len(self.number)
        self.number.update(zip(new, range(first, first + len(new))))
        for at in range(0, len(new), ALIGNED):
            part = [c[at : at + ALIGNED] for c in cuts]
            begun = [int(c[at - 1]) if at else 0 for c in cuts]
            joined = {k: (tokens[k][begun[k] : int(part[k][-1])], np.diff(part[k], prepend=begun[k])) for k in (0, 1)}
            for counts, groups, keys in _aligned(joined, self.a_size, self.b_size):
                self.counts.extend(counts)
                self.groups.append(groups)
                self.keys.frombytes(keys.tobytes())
                self.ends.append(len(self.keys))

    def whole(self, numbers: list[int]) -> tuple[np.ndarray, bytes, np.ndarray]:
        """Counts, groups as text and link keys of the segments put together; the views end before new segments come."""
        own = np.array(numbers, np.int64)
        counts, ends, keys = np.frombuffer(self.counts, np.int64).reshape(-1, 4), np.frombuffer(self.ends, np.int64), np.frombuffer(self.keys, np.int64)
        sizes = ends[own + 1] - ends[own]
        first = np.cumsum(sizes) - sizes
        found = keys[np.repeat(ends[own] - first, sizes) + np.arange(int(sizes.sum()))] if len(keys) else keys[:0].copy()
        return counts[own].sum(0), b"".join(map(self.groups.__getitem__, numbers)), found


def segments(text: str, cuts: bool = True) -> list[str]:
    return _CUT.split(text) if cuts else [text]


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(document, a, b) of all overlapping tokens; both tables have (document, at, start, id), sorted by ``at``.

    ``at`` is a token's start in the joined bytes of all documents, so it is sorted over documents as well.
    """
    left, right = (x.rename(columns={"id": name, "start": f"{name}_start"}) for x, name in ((a, "a"), (b, "b")))
    of_a = pd.merge_asof(left, right, on="at", by="document", direction="backward")
    of_b = pd.merge_asof(right, left, on="at", by="document", direction="backward")
    # Starts that meet are found from both sides.
    of_b = of_b[of_b["a_start"] != of_b["b_start"]]
    return pd.concat([of_a[["document", "a", "b"]], of_b[["document", "a", "b"]]], ignore_index=True)


def _decimals(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in decimal, each with the separator that follows it, as one array of bytes, and where each one ends."""
    width = np.searchsorted(np.array([10, 100, 1000, 10000, 100000, 1000000]), ids, "right") + 1
    ends = np.cumsum(width + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    rest, at = ids.astype(np.int64), ends - 2
    out[ends - 1] = after
    alive = np.arange(len(ids))
    while len(alive):
        out[at] = 48 + rest % 10
        rest = rest // 10
        on = rest > 0
        alive, rest, at = alive[on], rest[on], at[on] - 1
    return out, ends


def _aligned(joined: dict[int, tuple[np.ndarray, np.ndarray]], a_size: np.ndarray, b_size: np.ndarray) -> Iterator[tuple[list[int], bytes, np.ndarray]]:
    """For every segment, from the tokens of both sides and how many each segment has: (n_a, n_b, n_groups, n_links), groups, link keys."""
    n = len(joined[0][1])
    tables, ends, owners = [], [], []
    for side, size in ((0, a_size), (1, b_size)):
        ids, sizes = joined[side]
        owner = np.repeat(np.arange(n), sizes)
        stop = np.cumsum(size[ids])
        start = stop - size[ids]
        ends.append(stop)
        owners.append(owner)
        tables.append(pd.DataFrame({"document": owner, "at": start, "start": start, "id": ids}))
    links = overlaps(*tables)
    # Groups end where tokens of both sides end.
    both = np.intersect1d(ends[0], ends[1], assume_unique=True)
    group_a, group_b = (np.searchsorted(both, e, "left") for e in ends)
    last = np.searchsorted(ends[0], both, "left")
    n_groups = np.bincount(owners[0][last], minlength=n)
    in_a, in_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
    # Text form: a group's ids of one side, then those of the other.
    place_a = np.arange(len(group_a)) + (np.cumsum(in_b) - in_b)[group_a]
    place_b = np.arange(len(group_b)) + np.cumsum(in_a)[group_b]
    ids = np.empty(len(place_a) + len(place_b), np.int64)
    after = np.full(len(ids), ord(","), np.uint8)
    ids[place_a], ids[place_b] = joined[0][0], joined[1][0]
    after[place_a[np.cumsum(in_a) - 1]] = ord("|")
    after[place_b[np.cumsum(in_b) - 1]] = ord(";")
    text, stops = _decimals(ids, after)
    n_a, n_b = joined[0][1], joined[1][1]
    stops = np.concatenate(([0], stops))[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
    owner = links["document"].to_numpy()
    order = np.argsort(owner, kind="stable")
    key = ((links["a"].to_numpy(np.int64) << 20) | links["b"].to_numpy(np.int64))[order]
    n_links = np.bincount(owner, minlength=n)
    bounds = np.concatenate(([0], np.cumsum(n_links))).tolist()
    counts = np.stack([n_a, n_b, n_groups, n_links], axis=1).tolist()
    body = text.tobytes()
    for k in range(n):
        yield counts[k], body[stops[k] : stops[k + 1]], key[bounds[k] : bounds[k + 1]]


def _parts(texts: list[str | None], cuts: bool) -> Iterator[list[tuple[int, list[str]]]]:
    """The texts as lists of (number, segments), each of about ``PART_BYTES``; a long text goes on in the next part."""
    part, size = [], 0
    for number, text in enumerate(texts):
        own = segments(text, cuts) if text else []
        at = 0
        while at < len(own):
            to = len(own)
            if len(text) > PART_BYTES:
                to, length = at, 0
                while to < len(own) and size + length < PART_BYTES:
                    length += len(own[to]) + 1
                    to += 1
                size += length
            else:
                size += len(text) + 1
            part.append((number, own[at:to] if at or to < len(own) else own))
            at = to
            if size >= PART_BYTES:
                yield part
                part, size = [], 0
    if part:
        yield part


def _align_batch(texts: list[str | None], known: Tokenizers) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups, a ids, b ids, times) per text."""
    found: dict[int, list] = {}
    dropped: set[int] = set()
    for part in _parts(texts, known.cuts):
        if len(known.number) > REMEMBERED:
            known.forget()
        known.encode(chain.from_iterable(own for _, own in part))
        numbered = [(number, [known.number[s] for s in own]) for number, own in part]
        if known.misspelt:
            dropped.update(number for number, own in numbered if not known.misspelt.isdisjoint(own))
        for number, own in numbered:
            if number not in dropped:
                counts, groups, keys = known.whole(own)
                found.setdefault(number, []).append((*counts.tolist(), groups, *np.unique(keys, return_counts=True)))
    return [_whole(found.get(i, []) if i not in dropped else []) for i in range(len(texts))]


def _whole(parts: list) -> tuple:
    """The parts of one text together."""
    if not parts:
        return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, times = parts[0][5], parts[0][6]
    if len(parts) > 1:
        keys, at = np.unique(np.concatenate([p[5] for p in parts]), return_inverse=True)
        times = np.bincount(at, np.concatenate([p[6] for p in parts])).astype(np.int64)
    groups = b"".join([p[4] for p in parts])[:-1].decode()
    return *[sum(p[i] for p in parts) for i in range(4)], groups, keys >> 20, keys & ((1 << 20) - 1), times


def _reader(files, text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokenizers(*files.value)
        for batch in batches:
            found = _align_batch(batch[text].to_pylist(), known)
            counts = [pa.array([f[i] for f in found], pa.int64()) for i in range(4)]
            offsets = np.concatenate(([0], np.cumsum([len(f[5]) for f in found]))).astype(np.int32)
            flat = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (5, 6, 7)]
            pairs = pa.StructArray.from_arrays(
                [pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.int32()), pa.array(flat[2], pa.int64())], names=["a", "b", "times"]
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in columns], *counts, pa.array([f[4] for f in found], pa.string()), pa.ListArray.from_arrays(offsets, pairs)],
                names=[*columns, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"],
            )

    return run


def _contents(spark: SparkSession, folder: str) -> tuple[bytes, bytes]:
    """The two files, read by Spark so that the folder may be any shared one."""
    return tuple(
        bytes(spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{name}").select("content").first()[0]) for name in (BYTE_LEVEL, PIECES)
    )


def align(docs: DataFrame, text: str = "text", keep: list[str] | None = None, folder: str = TOKENIZERS) -> DataFrame:
    """The ``keep`` columns (all, if None) with token, group and link counts, the groups as text and the distinct linked id pairs.

    Row-local: nothing is shuffled. ``groups`` reads ``a1,a2|b1;a3|b2,b3``; ``pairs`` has (a, b, times).
    """
    spark = docs.sparkSession
    prepare(spark)
    files = spark.sparkContext.broadcast(_contents(spark, folder))
    columns = without(docs.select(keep) if keep is not None else docs, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs")
    sent = docs.select(*columns, F.col(text).alias("_text"))
    return sent.mapInArrow(_reader(files, "_text", columns), schema_with(sent, columns, *_RESULT))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best) of ``pairs`` (pair, times): how many links hold a pair of ids, and whether no other pair of its B id has more."""
    sums = pairs.groupBy("pair").agg(F.sum("times").alias("count"))
    # Pairs of one B id are at most as many as there are A ids.
    most = F.max("count").over(Window.partitionBy(F.col("pair") % (1 << 20)))
    return sums.withColumn("best", F.col("count") == most)


def pair_of(a: Column, b: Column) -> Column:
    return a.cast("long") * (1 << 20) + b


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents"), keep=["doc_id"])
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    rows = stage(found.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs"
    ), "alignment")
    links = rows.select("row", F.inline("pairs")).select("row", pair_of(F.col("a"), F.col("b")).alias("pair"), "times")
    counts = stage(pair_counts(links.drop("row")), "pair-counts")
    sums = lookup_join(links, counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    )
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", whole("n_best"), whole("count_sum"), "groups_sha256"
    )
