"""Mixing, sharding, WARC archives, the registered queries and the pipeline."""

import base64
import collections
import gzip
import hashlib
import io
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsflow.llm import decontaminate, mixing, sharding, simhash, warc
from newsflow.llm.catalog import QUERIES
from newsflow.llm.common import DOCUMENT
from newsflow.session import staging_path
from tests.compare import compare, connect
from tests.llm.helpers import PROSE, awkward, docs

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, name):
    build, sql = QUERIES[name]
    result = compare(spark, SMALL, build, sql, connect(SMALL))
    assert not result["problems"], result["problems"]


def test_every_number_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


# --- mixing ---------------------------------------------------------------


def hot_rows(n=400):
    return [(i, "w " * (1 + i * 7 % 90), "en", "hot" if i % 3 == 0 else f"s{i % 5}" if i % 11 else None, 1) for i in range(n)]


def even_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        level = rest / max(1e-9, sum(weight[s] for s in names if s not in capped))
        over = [s for s in names if s not in capped and level * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in names}
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rows = hot_rows()
    sized = mixing.measured(docs(spark, rows, ["row", "size", "sid"]))
    sources = mixing.targets(sized)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    known = {r["source"]: (r["source_size"], r["target"], r["n"], r["q"]) for r in sources.collect()}
    expected = even_targets(sizes)
    assert {s: v[0] for s, v in known.items()} == dict(sizes)
    assert all(v[1] == pytest.approx(expected[s]) for s, v in known.items())
    pieces = mixing.mix(sized, sources).join(sources.select("sid", "source"), "sid").join(sized.select("row", "doc_id", "size"), "row").collect()
    taken, by_doc = collections.Counter(), collections.Counter()
    for p in pieces:
        taken[p["source"]] += p["words"]
        by_doc[p["doc_id"]] += p["words"]
        assert 0 <= p["first"] and p["first"] + p["words"] <= p["size"] and p["words"] <= mixing.BLOCK
    assert all(abs(taken[s] - v[1]) <= mixing.BLOCK for s, v in known.items())
    assert all(by_doc[r[0]] <= 2 * len(r[1].split()) for r in rows)
    # No block comes twice in a pass, and a second pass starts when the first is over.
    slots = mixing.slots(sources).collect()
    assert len({(s["sid"], s["pass"], s["block"]) for s in slots}) == len(slots) == sum(v[3] for v in known.values())
    again = mixing.mix(sized, sources).groupBy("row").agg(F.sum("words").alias("n")).join(sized, "row")
    assert {r["doc_id"]: r["n"] for r in again.collect()} == dict(by_doc)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1003])
def test_permutation_is_one_to_one(spark, n):
    df = spark.range(2 * n).selectExpr("5L AS sid", f"id div {n} AS pass", f"{n}L AS n", f"id % {n} AS x")
    rows = mixing.permuted(df).collect()
    for p in (0, 1):
        assert sorted(r["x"] for r in rows if r["pass"] == p) == list(range(n))


def test_permutation_mixes(spark):
    rows = mixing.permuted(spark.range(4096).selectExpr("5L AS sid", "0L AS pass", "4096L AS n", "id AS x", "id AS old")).collect()
    x, y = [r["old"] for r in rows], [r["x"] for r in rows]
    mean = 4095 / 2
    correlation = sum((a - mean) * (b - mean) for a, b in zip(x, y)) / sum((a - mean) ** 2 for a in x)
    assert abs(correlation) < 0.1 and sum(b == a + 1 for a, b in zip(y, y[1:])) < 20


def test_mixed_documents(spark):
    source = docs(spark, awkward() + hot_rows(60), ["row", "size", "pass"])
    mixed = mixing.mixed_documents(source)
    assert mixed.columns == source.columns and mixed.dtypes == source.dtypes
    words = {}
    for r in source.collect():
        words.setdefault(r["doc_id"], set()).add(r["text"])
    for r in mixed.collect():
        assert r["text"] in words[r["doc_id"]] or r["n_chars"] == len(r["text"])
    silent = mixed.filter("doc_id IN (3, 4, 5)").collect()
    assert {r["text"] for r in silent} >= {"", None, " \t\n "}
    assert mixing.mixed_documents(docs(spark, [])).count() == 0
    assert mixing.mixed_documents(docs(spark, [(1, None), (2, " ")])).count() == 2


# --- sharding -------------------------------------------------------------


def test_shards_are_even_and_keep_groups(spark):
    rows = [(i, f"text {i} " + "x" * (i * 37 % 400)) for i in range(1500)] + [(5000 + i, "copy " * 30) for i in range(60)] + [(None, None)] * 20
    got = sharding.shard(docs(spark, rows, ["shard", "key", "leaf", "own_id"])).collect()
    assert len(got) == len(rows)
    loads, slots, groups = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[r["text"]].add(r["shard"])
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) < 1000
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in groups.values())


def test_a_third_of_equal_texts_is_subdivided(spark):
    rows = [(i, "same text " * 4) for i in range(2000)] + [(9000 + i, f"other {i} " * 5) for i in range(3000)]
    got = sharding.shard(docs(spark, rows), ranges=8).groupBy("shard").agg(F.sum("size"), F.count("*"), F.min("slot"), F.max("slot")).collect()
    loads = [r[1] for r in got]
    assert len(got) == 8 and max(loads) < 1.1 * min(loads) and all((r[3], r[4]) == (0, r[2] - 1) for r in got)


def test_rows_that_repeat_in_every_column_are_dealt_one_by_one(spark):
    """Two fifths of all rows are one text under null ids, and some more rows repeat text and id; default settings."""
    rows = [(None, "the same short text")] * 6000 + [(7, "another text that repeats")] * 1500 + [(9000 + i, f"other {i} " * 3) for i in range(7500)]
    got = sharding.shard(docs(spark, rows)).groupBy("shard").agg(F.sum("size"), F.count("*"), F.min("slot"), F.max("slot"), F.count_distinct("slot")).collect()
    loads = [r[1] for r in got]
    assert len(got) == 8 and max(loads) < 1.1 * min(loads)
    assert all((r[3], r[4], r[5]) == (0, r[2] - 1, r[2]) for r in got)


def test_overfull_ranges_are_cut(spark, monkeypatch):
    """A poor sample leaves ranges that are too full; they are cut until none is."""
    monkeypatch.setattr(sharding, "_quantiles", lambda drawn, n: sharding.np.zeros(0, sharding.np.int64))
    rows = [(i, f"text {i}") for i in range(3000)]
    keys = docs(spark, rows).select(*sharding._keyed(docs(spark, rows), "doc_id", "text")).cache()
    layout = sharding.plan(keys, 4, ranges=16)
    size, _ = sharding._totals(keys, layout)
    assert len(layout.bounds) > 20 and size.max() <= 2 * -(-sum(len(t) + 1 for _, t in rows) // 64)


def test_sharding_awkward(spark):
    source = docs(spark, awkward(), ["size"])
    got = sharding.shard(source, 3)
    assert got.count() == len(awkward()) and got.columns.count("size") == 1
    assert sharding.shard(docs(spark, [])).count() == 0
    one = sharding.shard(source, 1).collect()
    assert sorted(r["slot"] for r in one) == list(range(len(awkward())))


# --- WARC -----------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark):
    big = "<p>" + "payload é " * 40
    rows = [(5, "http://a/5", big), (3, "http://a/3 x\r\ny", big), (9, None, big), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""),
            (None, "u", big), (7, "u", "x" * 99), (8, "u", "x" * 99), (10, "u", "y" * 100), (11, "u", "y" * 100), (12, "u", "z" * 3_000_000)]
    folder = staging_path(spark, "warc-test")
    archives = warc.write_warc(pages(spark, rows), folder, archive_bytes=2000)
    assert archives.agg(F.sum("records")).first()[0] == len(rows) and archives.count() > 1
    got = {r["page_id"]: r for r in warc.read_warc(archives).collect()}
    assert not [r["problem"] for r in got.values() if r["problem"]]
    for i, url, html in rows:
        r = got[None if i is None else str(i)]
        body = (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), warc.sha256(body))
        first = {5: "3", 9: "3", None: "3", 11: "10"}.get(i)
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if first else ("response", None))
        assert (bytes(r["payload"]) == body) if not first else r["payload"] is None
    assert got["3"]["target"] == "http://a/3%20x%0D%0Ay" and got["9"]["target"] is None
    assert warc.read_warc(warc.write_warc(pages(spark, []), staging_path(spark, "none"))).count() == 0


def test_members_can_be_read_by_gzip():
    data = b"".join(warc.record(str(k), "n", "u", b"body %d" % k, 6, warc.sha256(b"body %d" % k), None) for k in range(3))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3
    rows = list(warc.read_archive(io.BytesIO(data)))
    assert [r["payload"] for r in rows] == [b"body 0", b"body 1", b"body 2"] and not any(r["problem"] for r in rows)
    for row in rows:
        assert zlib.decompressobj(31).decompress(data[row["offset"]:]).startswith(b"WARC/1.1")


def test_damage_is_reported_and_passed_over():
    one = [warc.record(str(k), "n", "u", b"body %d" % k, 6, warc.sha256(b"body %d" % k), None) for k in range(4)]
    raw = zlib.decompress(one[1], 31)
    pack = lambda b: gzip.compress(b)
    cases = {
        "wrong block digest": pack(raw.replace(b"body 1", b"BODY 1")),
        "the record doesn't end after its block": pack(raw.replace(b"Content-Length: 6", b"Content-Length: 6", 1)[:-4]),
        "the block is shorter": pack(raw[:-8]),
        "damaged member": one[1][:30] + bytes(x ^ 255 for x in one[1][30:60]) + one[1][60:],
        "no WARC version line": pack(b"hello\r\n" + raw),
        "a header line has no colon": pack(raw.replace(b"WARC-Type: ", b"WARC-Type ")),
    }
    for problem, member in cases.items():
        rows = list(warc.read_archive(io.BytesIO(one[0] + member + one[2] + one[3])))
        assert [r["page_id"] for r in rows if not r["problem"]] == ["0", "2", "3"], problem
        assert [r["problem"] for r in rows if r["problem"]] and problem in [r["problem"] for r in rows if r["problem"]][0]
    rows = list(warc.read_archive(io.BytesIO(one[0] + one[1][:40])))
    assert [r["problem"] is None for r in rows] == [True, False]


# --- pipeline -------------------------------------------------------------


def test_pipeline_stages(spark):
    """Each stage against a plain Python version on its own input."""
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = source.unionByName(docs(spark, [(10_000, None), (10_001, "123 !"), (10_002, PROSE), (10_003, PROSE)]).select(*source.columns))
    states = {}
    for name, function in corpus_pipeline.STAGES:
        before, held = held, function(spark, held, SMALL).cache()
        states[name] = ({r["doc_id"]: r["text"] for r in before.collect()}, held.collect())
        assert name == "sharding" or held.columns == list(DOCUMENT)
    before, after = states["language"]
    letters = {i for i, t in before.items() if t and any(c.isalpha() for c in t)}
    assert {r["doc_id"] for r in after} == letters and len(after) == len(letters)
    before, after = states["near_copies"]
    ids = sorted(before)
    fps = [simhash.fingerprint(before[i].encode()) for i in ids]
    first = {}
    for k, i in enumerate(ids):
        first[i] = i
        for j in range(k):
            if bin((fps[k] ^ fps[j]) & (2**64 - 1)).count("1") <= 4:
                a, b = first[i], first[ids[j]]
                first = {x: min(a, b) if v in (a, b) else v for x, v in first.items()}
    assert sorted(r["doc_id"] for r in after) == sorted({*first.values()})
    before, after = states["benchmark_leaks"]
    windows = set()
    for (text,) in duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall():
        own = decontaminate.words_of(text.encode())
        windows |= {tuple(own[p:p + 10]) for p in range(max(1, len(own) - 9))} if own else set()
    clean = set()
    for i, text in before.items():
        own = decontaminate.words_of(text.encode())
        if not any(tuple(own[p:p + k]) in windows for k in {len(w) for w in windows} for p in range(len(own) - k + 1)):
            clean.add(i)
    assert {r["doc_id"] for r in after} == clean
    before, after = states["mixing"]
    assert {r["doc_id"] for r in after} <= set(before)
    total = sum(len(t.split()) for t in before.values())
    assert sum(len(r["text"].split()) for r in after) == pytest.approx(1.5 * total, rel=0.05)
    assert max(collections.Counter(r["doc_id"] for r in after).values()) <= 2
    rows = states["sharding"][1]
    assert len(rows) == len(after)
    loads = collections.Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert len(loads) == 8 and max(loads.values()) < 1.1 * min(loads.values())


@pytest.mark.parametrize("kind", ["md5", "sha1", "SHA-1", "sha256", "sha512"])
@pytest.mark.parametrize("form", ["hex", "HEX", "base32"])
def test_digests_of_public_archives(kind, form):
    """Archives carry SHA-1 in base32, most of all; right ones pass, wrong ones don't, and what can't be verified is said."""
    def archive(data_of_digest, kind=kind):
        name = kind.lower().replace("-", "")
        raw = hashlib.new(name if name in warc.DIGESTS else "sha1", data_of_digest).digest()
        value = {"hex": raw.hex(), "HEX": raw.hex().upper(), "base32": base64.b32encode(raw).decode()}[form]
        block = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nbody"
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: {kind}:{value}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
        return next(warc.read_archive(io.BytesIO(gzip.compress(head.encode() + block + b"\r\n\r\n"))))

    sound = archive(b"body")
    assert sound["problem"] is None and sound["payload"] == b"body"
    wrong = archive(b"Body")
    assert wrong["problem"] == "wrong payload digest" and "payload" not in wrong
    unknown = archive(b"body", "crc9")
    assert unknown["problem"] == "unknown kind of payload digest: crc9" and unknown["payload"] == b"body"
