"""SimHash near-dedup and benchmark decontamination."""

import os
import random

import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.broadcast import Broadcast
from pyspark.sql import functions as F

from newsflow.llm import decontaminate as D
from newsflow.llm import simhash as S
from tests.llm.helpers import PROSE, awkward, docs


def brute_classes(fps):
    """Smallest index reachable over links of at most four bits."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_golay_code_is_perfect():
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 1 << 23, 20_000)
    own = S.codewords(sample)
    # 20,000 words miss a codeword with a chance of e^-4.9 each.
    assert len(set(own[:, 0].tolist())) > 4000
    counts = (own >= 0).sum(axis=1)
    assert set(counts.tolist()) == {1, 6}


def test_two_bit_neighbours_share_a_codeword():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 23, 5000)
    b = a ^ (1 << rng.integers(0, 23, 5000)) ^ (1 << rng.integers(0, 23, 5000))
    for x, y in zip(S.codewords(a).tolist(), S.codewords(b).tolist()):
        assert ({*x} - {-1}) & ({*y} - {-1})


def test_four_bit_neighbours_share_a_key():
    rng = np.random.default_rng(5)
    a = rng.integers(-2**63, 2**63, 4000, dtype=np.int64)
    b = a.copy().view(np.uint64)
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    (ra, ka), (rb, kb) = S.golay_keys(a), S.golay_keys(b.view(np.int64))
    assert len({r for r, _ in set(zip(ra.tolist(), ka.tolist())) & set(zip(rb.tolist(), kb.tolist()))}) == len(a)


def test_fingerprint_matches_spark_hash(spark):
    text = "One two THREE four five six two three four five"
    words = text.lower().split()
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)]
    hashes = [r[0] for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    bits = [sum(h >> k & 1 for h in hashes) * 2 > len(hashes) for k in range(64)]
    assert S.fingerprint(text.encode()) & (2**64 - 1) == sum(1 << k for k in range(64) if bits[k])
    assert S.fingerprint(None) == S.fingerprint(b" \n") == 0


@pytest.mark.parametrize("block", [20_000, 40])
def test_components_against_brute_force(spark, block, monkeypatch):
    """Dense balls, chains and lone fingerprints; the small block sends hot keys through the second way."""
    monkeypatch.setattr(S, "GATHER", 64)
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(200)]
    for centre in fps[:3]:
        for _ in range(80):
            f = centre
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << bit
            fps.append(f)
    chain = fps[5]
    for _ in range(40):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.append(chain)
    signed = sorted({f - 2**64 if f >> 63 else f for f in fps})
    nodes = spark.createDataFrame([(f,) for f in signed], "fingerprint long")
    found = {r[0]: r[1] for r in S.components(S.golay_links(nodes, block=block)).collect()}
    expected = brute_classes(signed)
    assert [found.get(f, f) for f in signed] == [signed[k] for k in expected]


def test_near_duplicates_awkward(spark):
    rows = {(r[0], r[1], r[2]) for r in S.near_duplicates(docs(spark, awkward(), ["fingerprint", "key", "row"])).collect()}
    ids = {d: c for d, _, c in rows}
    assert ids[2] == 1 and ids[1] == 1 and ids[3] == 3 and ids[4] == 3 and ids[5] == 3
    assert len(S.near_duplicates(docs(spark, awkward())).collect()) == len(awkward())
    assert S.near_duplicates(docs(spark, [])).count() == 0


def test_drop_keeps_one_of_each(spark):
    source = docs(spark, awkward(), ["row", "Fingerprint", "c0"])
    kept = S.drop_near_duplicates(source)
    assert kept.columns == source.columns
    ids = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert [i for i, _ in ids] == [0, 1, 3, 6, 7, 8]
    assert S.drop_near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [S.BROADCAST_ROWS, 1])
def test_drop_stores_no_texts(spark, tmp_path, limit, monkeypatch):
    """What is stored stays far below the texts; equal rows, repeated ids and both joins keep one row of each group."""
    monkeypatch.setattr(S, "BROADCAST_ROWS", limit)
    rng = random.Random(3)
    body = lambda: " ".join(f"{rng.getrandbits(64):x}" for _ in range(400))
    texts = [body() for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(k + 100, texts[k]) for k in range(5)] + [(7, texts[7])] * 3 + [(7, texts[8]), (None, texts[9])]
    docs(spark, rows).write.parquet(str(tmp_path / "docs"))
    stored, stage = [], S.stage
    monkeypatch.setattr(S, "stage", lambda df, name: stored.append(stage(df, name)) or stored[-1])
    kept = S.drop_near_duplicates(spark.read.parquet(str(tmp_path / "docs"))).collect()
    # The row of the smallest id represents text 8, which id 7 has as well.
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(k, t) for k, t in enumerate(texts) if k != 8] + [(7, texts[8])])
    files = [f for df in stored for f in df.inputFiles()]
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in files) < sum(len(t) for _, t in rows) / 2


# --- decontamination ------------------------------------------------------

def brute_leaks(text, items, window=10):
    words = D.words_of(text.encode() if text is not None else None)
    hit, names = set(), set()
    for name, body in items:
        own = D.words_of(body.encode() if body is not None else None)
        k = min(window, len(own))
        windows = {tuple(own[p:p + k]) for p in range(len(own) - k + 1)} if own else set()
        for p in range(len(words) - k + 1 if own else 0):
            if tuple(words[p:p + k]) in windows:
                hit.update(range(p, p + k))
                names.add("" if name is None else str(name))
    return len(words), len(hit), sorted(names)


def random_case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "Dé", "e1"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 10, 11, 30])))) for k in range(8)]
    items += [(8, "a " * 25), (8, "unique words of a repeated id"), (None, "c b a c b a c b a c b a"), (9, None)]
    texts = [" ".join(word() for _ in range(rng.randint(0, 200))) for _ in range(25)]
    texts += [t + ". " + (items[rng.randrange(8)][1]) + "!" for t in texts[:8]] + [None, "", "a, " * 300]
    return items, texts


@pytest.mark.parametrize("shard_words,block_bytes", [(1_000_000, 1 << 25), (150, 1 << 25), (1_000_000, 120)])
def test_leaks_against_brute_force(spark, shard_words, block_bytes):
    items, texts = random_case(shard_words % 97 + block_bytes % 89)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_leaks(docs(spark, list(enumerate(texts)), ["leak", "n_words"]), bench, shard_words=shard_words, block_bytes=block_bytes)
    rows = {r["doc_id"]: r["leak"] for r in found.collect()}
    assert found.columns.count("leak") == 1 and "n_words" in found.columns
    for i, text in enumerate(texts):
        n, hit, names = brute_leaks(text, items)
        assert (rows[i]["n_words"], rows[i]["n_hit"], rows[i]["items"]) == (n, hit, names)
        assert sum(s["words"] for s in rows[i]["spans"]) == hit


def test_one_block_at_a_time(spark, monkeypatch):
    """A block's broadcast is gone before the next one is made."""
    live, counts = set(), []
    make, end = SparkContext.broadcast, Broadcast.destroy

    def broadcast(self, value):
        made = make(self, value)
        if isinstance(value, D.Suffixes):
            live.add(id(made))
            counts.append(len(live))
        return made

    def destroy(self, *a, **b):
        live.discard(id(self))
        return end(self, *a, **b)

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    items, texts = random_case(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_leaks(docs(spark, list(enumerate(texts)), ["row", "c0"]), bench, block_bytes=120)
    rows = {r["doc_id"]: r["leak"] for r in found.collect()}
    assert {i: (x["n_words"], x["n_hit"], x["items"]) for i, x in rows.items()} == {i: brute_leaks(t, items) for i, t in enumerate(texts)}
    cut = {tuple(r) for r in D.longest_matches(docs(spark, list(enumerate(texts))), bench, block_bytes=120).collect()}
    assert len(counts) > 4 and max(counts) == 1
    assert {tuple(r)[:4] for r in D.longest_matches(docs(spark, list(enumerate(texts))), bench).collect()} == {r[:4] for r in cut}


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(40))
    texts = ["x y " + " ".join(f"w{i}" for i in range(5, 20)), " ".join(f"w{i}" for i in range(3, 30)) + " z", "nothing"]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    leak = {r["doc_id"]: r["leak"] for r in D.find_leaks(docs(spark, list(enumerate(texts))), bench).collect()}
    assert (leak[0]["longest"], leak[0]["longest_start"], leak[0]["longest_item"]) == (15, 2, "1")
    assert (leak[1]["longest"], leak[1]["longest_start"]) == (27, 0) and leak[2]["longest"] == 0
    best = {r["item_start"]: (r["words"], r["n_locations"], r["doc_key"], r["doc_start"]) for r in D.longest_matches(docs(spark, list(enumerate(texts))), bench, shard_words=10).collect()}
    assert best[3] == (27, 1, "1", 0) and best[5] == (25, 1, "1", 2) and 25 not in best


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(9)
    ids = np.append(rng.integers(0, 4, 300), 0)

    def suffix(p):
        stop = p + int(np.flatnonzero(ids[p:] == 0)[0])
        return ids[p:stop].tolist()

    order = D.suffix_array(ids, 64)
    assert sorted(order.tolist()) == np.flatnonzero(ids).tolist()
    assert [suffix(p) for p in order] == sorted(suffix(p) for p in order)


def test_drop_leaked_awkward(spark):
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    source = docs(spark, awkward(), ["leak"])
    left = D.drop_leaked(source, bench)
    assert left.columns == source.columns and left.count() == len(awkward()) - 3
    assert D.drop_leaked(docs(spark, []), bench).count() == 0
    assert D.drop_leaked(source, bench.limit(0)).count() == len(awkward())
