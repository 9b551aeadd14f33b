"""Alignment of two tokenizers against whole-text encoding and plain loops."""

import collections
import hashlib

import numpy as np
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from newsflow.llm import alignment as A
from newsflow.llm.catalog import QUERIES
from newsflow.operators import lookup
from tests.llm.helpers import PROSE, awkward, docs

SMALL = "/root/testdata/sf0.001"
SHOWN = "".join(map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))


@pytest.fixture(scope="module")
def both():
    a = tokenizers.Tokenizer.from_file(f"{A.TOKENIZERS}/{A.BYTE_LEVEL}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{A.TOKENIZERS}/{A.PIECES}")


def byte_of(c):
    hidden = [b for b in range(256) if chr(b) not in SHOWN]
    return ord(c) if c in SHOWN else hidden[ord(c) - 256]


def plain(text, both):
    """(groups, links) of one text, encoded whole; None without tokens."""
    if not text:
        return None
    a, b = both
    xs = a.encode(" " + text, add_special_tokens=False).ids
    ys = b.encode(text)
    x_bytes = [bytes(byte_of(c) for c in a.id_to_token(i)) if i != 50256 else b"?" for i in xs]
    y_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ys]
    if not b"".join(x_bytes) == b"".join(y_bytes) == (" " + text).encode():
        return None
    spans = []
    for ids, parts in ((xs, x_bytes), (ys, y_bytes)):
        at = 0
        spans.append([(i, at, at := at + len(p)) for i, p in zip(ids, parts)])
    links, k = [], 0
    for i, lo, hi in spans[0]:
        while spans[1][k][2] <= lo:
            k += 1
        j = k
        while j < len(spans[1]) and spans[1][j][1] < hi:
            links.append((i, spans[1][j][0]))
            j += 1
    shared = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
    groups, left = [], [list(reversed(side)) for side in spans]
    for hi in shared:
        own = []
        for side in left:
            taken = []
            while side and side[-1][2] <= hi:
                taken.append(str(side.pop()[0]))
            own.append(",".join(taken))
        groups.append("|".join(own))
    return len(xs), len(ys), groups, links


def expected(rows, both):
    found = [(i, plain(text, both)) for i, text in rows]
    counts = collections.Counter(p for _, f in found if f for p in f[3])
    most = collections.defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        out.append((
            i, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


ODD = [
    (11, "  two  spaces  "), (12, "<|endoftext|> <s> </s> <0x41> <unk>"), (13, "tab\tand\nline breaks\r\n\n"), (14, "don't it's 12 345 6789 a1 b2!"), (15, "▁x▁"),
    (16, "ﬁne ① ﬀ"), (17, "日本語 のテキスト café 👍🏽 naïve"), (18, "x" * 3000), (19, "a b c d"), (20, " "), (21, " non breaking space"), (22, "é ́x"), (23, "\x00\x01 control"),
]


def check(df, rows, both):
    build, _ = QUERIES["op12_alignment"]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert df.columns == columns
    assert [d[1] for d in df.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == expected(rows, both)


@pytest.fixture
def query_on(spark, tmp_path):
    def run(df):
        df.write.parquet(f"{tmp_path}/documents.parquet")
        return QUERIES["op12_alignment"][0](spark, str(tmp_path))

    return run


def test_query_on_the_small_tables(spark, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op12_alignment"][0](spark, SMALL), rows, both)


@pytest.mark.parametrize("limit", [None, 0])
def test_awkward_texts(spark, both, query_on, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", limit)
    table = docs(spark, awkward() + [(i, t, "en", "a", 1) for i, t in ODD], ["n_a", "row", "pairs", "times"])
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    check(query_on(table), rows, both)


def test_empty_table(spark, query_on):
    assert query_on(docs(spark, [])).collect() == []


def test_parts_and_forgetting_change_nothing(both, monkeypatch):
    texts = [PROSE * 50, None, "", PROSE + " über straße " + PROSE, "no  tokens ① here " + PROSE, "q" * 500 + " " + PROSE]
    files = [open(f"{A.TOKENIZERS}/{n}", "rb").read() for n in (A.BYTE_LEVEL, A.PIECES)]
    known = A.Tokenizers(*files)
    assert known.cuts
    whole = A._align_batch(texts, known)
    monkeypatch.setattr(A, "PART_BYTES", 100)
    monkeypatch.setattr(A, "REMEMBERED", 3)
    parts = A._align_batch(texts, known)
    for x, y in zip(whole, parts):
        assert x[:5] == y[:5]
        assert all(np.array_equal(p, q) for p, q in zip(x[5:], y[5:]))


def test_extra_columns_stay(spark):
    found = A.align(docs(spark, [(1, "a b")], ["extra", "groups"]))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"]
    row = found.select("extra", "groups", F.size("pairs").alias("n")).first()
    assert row["extra"] == "clash" and row["groups"].count("|") == row["groups"].count(";") + 1 and row["n"] >= 2


def test_a_segment_is_aligned_once(monkeypatch):
    """Texts that repeat their words cost one alignment of each distinct segment, in whatever order new ones come."""
    rows = []
    overlaps = A.overlaps
    monkeypatch.setattr(A, "overlaps", lambda a, b: rows.append(len(a)) or overlaps(a, b))
    monkeypatch.setattr(A, "ALIGNED", 3)
    known = A.Tokenizers(*[open(f"{A.TOKENIZERS}/{name}", "rb").read() for name in (A.BYTE_LEVEL, A.PIECES)])
    words = ["alpha", "beta", "gamma", "delta", "naïve", "x"]
    texts = [" ".join(words[(i * k) % 6] for k in range(1, 200)) for i in range(1, 40)]
    found = A._align_batch(texts, known)
    assert sum(rows) <= 4 * len(words)
    alone = [A._align_batch([t], A.Tokenizers(*[open(f"{A.TOKENIZERS}/{name}", "rb").read() for name in (A.BYTE_LEVEL, A.PIECES)]))[0] for t in texts[:3]]
    for one, other in zip(found, alone):
        assert one[:5] == other[:5] and all((x == y).all() for x, y in zip(one[5:], other[5:]))
