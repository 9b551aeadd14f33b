"""Exact top-k search and the Merkle manifest against brute force in plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.llm import merkle, topk
from newsflow.llm.catalog import QUERIES
from newsflow.operators import lookup
from tests.llm.helpers import PROSE, awkward, docs

# --- top-k ------------------------------------------------------------------

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("row", T.StringType()), T.StructField("score", T.StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", None) for i, v in rows], VECTORS)


def brute(rows, k, asked, scale=1024):
    """A multiset of (query id, rank, id, score)."""
    sound = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
        if v is not None and all(x is not None and math.isfinite(float(np.float32(x))) for x in v)
    ]
    out = []
    for n, (i, q) in enumerate(sound):
        if asked(i):
            found = [(-sum(a * b for a, b in zip(q, x)), j is None, j or 0, j) for m, (j, x) in enumerate(sound) if m != n]
            out += [(i, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    assert [d[1] for d in df.dtypes] == ["bigint", "int", "bigint", "bigint"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clustered(n, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    # Half of all vectors are around one centre.
    rows = [(i, [x + rng.gauss(0, 0.03) for x in centres[0 if i % 2 else rng.randrange(12)]]) for i in range(n)]
    return rows + [(n + i, list(rows[1][1])) for i in range(60)]


@pytest.mark.parametrize("options", [{}, {"group_bytes": 300, "piece_bytes": 4000, "least_rows": 10, "pivots": 9, "witnesses": 40}, {"pivots": 1, "witnesses": 2}])
def test_top_k_agrees(spark, options, monkeypatch):
    if options:
        monkeypatch.setattr(topk, "TILE", 16)
    rows = clustered(600)
    asked = lambda i: i is not None and i % 7 == 0
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 7 == 0, 5, **options)
    assert found(got) == brute(rows, 5, asked)


def test_top_k_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", 0)
    rows = clustered(200)
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, 5, group_bytes=300, piece_bytes=2000, pivots=9)
    assert found(got) == brute(rows, 5, lambda i: i % 50 == 0)


def test_top_k_awkward_rows(spark):
    v = [0.5, -0.25, 1.0]
    rows = [
        (0, v), (0, v), (1, v), (2, None), (3, [None, 1.0, 1.0]), (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]), (100, []), (200, [0.0, 0.0, 0.0]),
        (None, v), (6, [2.0]), (7, [-0.0003, 0.5, 0.0]), (300, [1000.0, 1000.0, 1000.0]), (8, [-1.0, -1.0, -1.0]), (9, v), (9, v),
    ]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0)
    padded = [(i, x if x is None else [*x, *[0.0] * (3 - len(x))]) for i, x in rows]
    assert found(got) == brute(padded, 10, lambda i: i is not None and i % 100 == 0)


def test_top_k_large_components(spark):
    rows = [(0, [3e5, 1.0]), (1, [2e5, -1.0]), (2, [3e5, 0.99]), (100, [-3e5, 0.5])]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, 2)
    assert found(got) == brute(rows, 2, lambda i: i % 100 == 0)
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(vectors(spark, [(0, [1e30]), (1, [1e30])]), F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("rows", [[], [(0, None)], [(1, [1.0])], [(0, [1.0])]])
def test_top_k_of_nothing(spark, rows):
    assert found(topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0)) == []


def test_only_what_may_count_is_copied():
    """Bounds hold, and far cells are ruled out."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1000, (20, 16))
    x = np.floor(np.repeat(centres, 50, 0) + rng.normal(0, 20, (1000, 16)))
    space = topk.Space(np.arange(0, 1000, 10), x[::10], 20, 5)
    cell, b, h = space.cells(x)
    shell = np.floor(topk.SHELLS * np.log2(1 + np.hypot(b - space.norms[cell], h)))
    table = [(c, b[o].min(), b[o].max(), h[o].max(), o.sum()) for c in np.unique(cell) for s in np.unique(shell[cell == c]) for o in [(cell == c) & (shell == s)]]
    space.summarize(np.array(table))
    floors = space.floors(np.arange(1000), x)
    exact = x @ x.T
    np.fill_diagonal(exact, -np.inf)
    kth = -np.sort(-exact, 1)[:, 4]
    assert (floors <= kth).all() and (floors > -np.inf).all()
    along, off = space.split(x)
    bound = along[:, cell] * b + off[:, cell] * h
    assert (bound + 1e-3 >= x @ x.T).all()
    assert (bound >= floors[:, None]).mean() < 0.5


def test_groups_cover_all_cells():
    pivots = np.arange(10.0)[:, None]
    got = topk.packed(pivots, {0: 3, 1: 4, 2: 25, 5: 2, 9: 1}, 10)
    assert sorted(g[0] for g in got) == [0, 1, 2, 5, 9]
    assert {g[0]: g[2] for g in got}[2] == 3
    assert topk.packed(pivots, {}, 10) == []


# --- manifest ---------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    i, text, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def up(nodes):
    return [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]


def siblings(nodes, at):
    """Per level: those left of the node and those right of it."""
    out = []
    while len(nodes) > 1:
        lo = at - at % 3
        run = nodes[lo:lo + 3]
        out.append((run[:at - lo], run[at - lo + 1:]))
        nodes, at = up(nodes), at // 3
    return out, nodes[0]


def expected(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    tops = [siblings([leaf(r) for r in trees[s]], 0)[1] for s in sources]
    out = []
    for k, s in enumerate(sources):
        above, root = siblings(tops, k)
        for at, r in enumerate(trees[s]):
            own, subroot = siblings([leaf(x) for x in trees[s]], at)
            steps = own + above
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                changed = (r[0], r[1].replace("\n", ""), *r[2:])
            h = leaf(changed)
            for left, right in steps:
                h = sha("".join(left) + h + "".join(right))
            out.append((r[0], leaf(r), subroot, root, sha("".join("".join(a + b) for a, b in steps)), h, h == root))
    return sorted(out, key=repr)


def manifest(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_manifest"][0](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("limit", [None, 0])
def test_manifest_agrees(spark, tmp_path, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", limit)
    rows = [tuple(r) for r in awkward()]
    rows += [(100 + i * 3 % 700, f"{PROSE}\nline {i}", "en", "hot", i) for i in range(700)]
    rows += [(i, f"a\nb{i}", None, f"s{i % 40}", None) for i in range(82)] + [(None, "x\n", "en", "hot", 1)] * 90
    assert manifest(spark, tmp_path, docs(spark, rows, ["tree", "pos", "leaf", "root"])) == expected(rows)


@pytest.mark.parametrize("rows", [[(1, "only\none", "en", "a", 1)], [(2, None, None, None, None)], [(i, "t\n", "en", "a", i) for i in range(4)]])
def test_small_manifests(spark, tmp_path, rows):
    assert manifest(spark, tmp_path, docs(spark, rows)) == expected(rows)


def test_empty_manifest(spark, tmp_path):
    assert manifest(spark, tmp_path, docs(spark, [])) == []


def test_paths_inside_a_subtree():
    rows = [(i, f"t\n{i}", "en", "a" if i % 3 else "b", i) for i in range(100)]
    levels = merkle._levels([leaf(r) for r in rows[:9]], 2)
    assert [len(x) for x in levels] == [9, 3, 1]
    path = merkle._path(levels, 7)
    assert [s["at"] for s in path] == [1, 2] and [len(s["others"]) for s in path] == [2, 2]


def test_path_leads_to_the_root(spark):
    rows = [(i, f"t{i}", "en", "ab"[i % 2], i) for i in range(30)]
    table = docs(spark, rows)
    made = merkle.manifest(table, merkle.leaf_of(F.col("text")), keep={"text": F.col("text")})
    assert made.columns == ["doc_id", "text", "leaf", "subroot", "root", "path"]
    checked = made.select((merkle.fold_path(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert len(checked) == 30 and all(r["ok"] for r in checked)
    own = [sha(f"{len(f't{i}')}:t{i}") for i in range(30)]
    assert sorted(r["leaf"] for r in made.collect()) == sorted(own)
