"""Language ID, token counts, language model, secrets and quality on small tables."""

import base64
import bz2
import collections
import gzip
import lzma
import math
import random
import re
import urllib.parse
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from newsflow.llm import langid, lm, quality, secrets
from newsflow.llm import token_counts as K
from tests.llm.helpers import PROSE, awkward, docs

# --- language -------------------------------------------------------------


def languages():
    rng = random.Random(2)
    parts = {"en": ["the", "and", "ing", "tion", "er", "th"], "de": ["ung", "sch", "ein", "ß", "keit", "ü"], "fr": ["eau", "que", "é", "ment", "oi", "le"]}
    rows = []
    for lang, own in parts.items():
        for k in range(40):
            words = ["".join(rng.choice(own) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
            rows.append((len(rows), " ".join(words), lang, "s", 0))
    return rows


def test_rank_distance_by_hand():
    profiles = langid.Profiles([("x", 97, 5), ("x", 98, 3), ("y", 98, 9), ("y", 97, 1)], 10)
    # Text "a": grams a, _a, a_, _a_ of equal count share rank 1.5; only "a" is in the profiles, at ranks 0 and 1.
    assert profiles.nearest("a") == ("y", pytest.approx(1 - (0.5 + 30) / 40))
    assert profiles.nearest(None) == profiles.nearest("12 !") == ("und", 0.0)


def test_languages_are_found(spark):
    rows = languages()
    train = docs(spark, [r for r in rows if r[0] % 4])
    found = langid.identify(docs(spark, rows, ["score"]), langid.learn(train), keep=["doc_id", "score"])
    assert found.columns == ["doc_id", "lang_pred", "score"]
    got = {r["doc_id"]: r["lang_pred"] for r in found.collect()}
    assert all(got[r[0]] == r[2] for r in rows)


def test_profiles_against_brute_force(spark):
    rows = languages()[:30] + [(99, None, "en", "s", 0), (98, "x y", None, "s", 0)]
    learned = {(r["lang"], r["code"]): r["n"] for r in langid.learn(docs(spark, rows), size=10_000).collect()}
    expected = collections.Counter()
    for _, text, lang, _, _ in rows:
        if lang and text:
            padded = "\x01" + re.sub("[^a-zßüé]+", "\x01", text) + "\x01"
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    gram = padded[i:i + n]
                    if gram != "\x01":
                        expected[lang, sum(ord(c) << 21 * (n - 1 - k) for k, c in enumerate(gram))] += 1
    assert learned == expected


def test_long_texts_in_parts(monkeypatch):
    whole = langid.gram_counts(PROSE * 5)
    monkeypatch.setattr(langid, "LETTERS", 17)
    parts = langid.gram_counts(PROSE * 5)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_language_awkward(spark):
    source = docs(spark, awkward(), ["lang_pred", "c0"])
    kept = langid.keep_known(source)
    assert kept.columns == source.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1, 2, 6, 7]
    assert langid.keep_known(docs(spark, [])).count() == 0


def test_nothing_learned_keeps_texts_with_letters(spark):
    source = docs(spark, [(*r[:2], None, *r[3:]) for r in awkward()], ["lang_pred", "c0"])
    kept = langid.keep_known(source)
    assert kept.columns == source.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1, 2, 6, 7]


# --- token counts ---------------------------------------------------------


def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        size = next((k for k in range(len(word) - i, 0, -1) if word[i:i + k] in pieces), 0)
        if not size:
            return 1
        n, i = n + 1, i + size
    return n


def test_automaton_against_greedy():
    rng = random.Random(1)
    for _ in range(1500):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = K.LongestMatch(pieces)
        for _ in range(8):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
            assert automaton.count(word) == greedy(word, pieces)


@pytest.mark.parametrize("memory", [1, 1000])
def test_token_counts(spark, memory):
    vocabulary = K.read_vocabulary(K.vocabulary_path())
    pieces = set(vocabulary)
    found = {}
    for r in K.count_tokens(docs(spark, awkward(), ["n_tokens"]), vocabulary, memory=memory).collect():
        found[r["doc_id"], r["text"]] = (r["n_words"], r["n_bytes"], r["n_tokens"])
    for row in awkward():
        body = (row[1] or "").encode()
        words = body.split()
        assert found[row[0], row[1]] == (len(words), len(body), sum(greedy(b" " + w, pieces) for w in words))
    assert K.count_tokens(docs(spark, []), vocabulary).count() == 0


# --- language model -------------------------------------------------------


def test_base_scores_and_held_out_gain(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha beta", "gamma", "Delta delta epsilon", f"rare{i}"]) for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(500, None)]
    train = [r for r in rows if r[0] % 3]
    model = lm.train(docs(spark, train), word_share=0.004, gram_share=0.002)
    found = {r["doc_id"]: r for r in lm.score(docs(spark, rows, ["score", "row", "cold"]), model, keep=["doc_id", "row"]).collect()}
    counts = collections.Counter(t for _, text in train for t in lm.tokens_of(text.encode() if text else None))
    n, v = sum(counts.values()), len(counts)
    for i, text in rows:
        own = lm.tokens_of(text.encode() if text else None)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[t] > 0 for t in own), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] <= 0
    held = [found[i] for i, _ in rows if i % 3 == 0]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_automaton_is_a_distribution_and_walks_right(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdd") for _ in range(40))) for i in range(30)]
    model = lm.train(docs(spark, rows), word_share=1e-5, gram_share=0.02)
    states, words = model.automaton.value, model.frequent.value
    total = model.total
    unigram = {k: (int(words.counts[k]) + 1) / total for k in words.number.values()}
    states.adjustment([], -1)

    def probability(state, w):
        weight = 0.0
        while state:
            arc = states.arcs.get(state << 20 | w)
            if arc is not None:
                return 10 ** (weight + arc[0]) * unigram[w]
            weight += states.back[state]
            state = states.fail[state]
        return 10**weight * unigram[w]

    for state in range(len(states.back)):
        lost = 1.0
        s = state
        while s:
            lost *= 10 ** states.back[s]
            s = states.fail[s]
        # All words of the training are frequent here; one unknown word is left.
        assert sum(probability(state, w) for w in unigram) + lost / total == pytest.approx(1.0)
    assert max(states.fail) > 0 and len(states.back) > len(unigram) + 1


@pytest.mark.parametrize("share,bits", [(1e-5, 1 << 28), (0.01, 1 << 28), (2.0, 64)])
def test_weights_add_up_to_the_walk(spark, monkeypatch, share, bits):
    """The table of all grams gives what the automaton with all of them gives, however many are looked up in the task or pass the filter."""
    monkeypatch.setattr(lm, "HOT_SHARE", share)
    monkeypatch.setattr(lm, "FILTER_BITS", bits)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "Cé", "d", "d", f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 50)))) for i in range(60)] + [(500, None)]
    learned = [r for r in rows if r[0] % 3]
    counts = collections.Counter()
    for _, text in learned:
        own = [b"", *lm.tokens_of(text.encode() if text else None)]
        counts.update([(w,) for w in own[1:]] + list(zip(own, own[1:])) + list(zip(own, own[1:], own[2:])))
    words = sorted(g[0] for g in counts if len(g) == 1)
    number = {w: i for i, w in enumerate(words)}
    tokens = sum(counts[w,] for w in words)

    def arcs(k):
        times = collections.Counter(c for g, c in counts.items() if len(g) == k)
        kept = sorted((sum(number[w] << 20 * (k - 1 - i) for i, w in enumerate(g)), c) for g, c in counts.items() if len(g) == k and c >= 2)
        return *(np.array(x, np.int64) for x in zip(*kept)), times[1] / (times[1] + 2 * times[2])

    states = lm.Automaton(np.array([counts[w,] for w in words]), tokens + len(words) + 1, arcs(2), arcs(3))
    model = lm.train(docs(spark, learned))
    got = {r["doc_id"]: r for r in lm.score(docs(spark, rows), model).collect()}
    for i, text in rows:
        own = lm.tokens_of(text.encode() if text else None)
        base = sum(math.log10((counts[w,] + 1) / (tokens + len(words) + 1)) for w in own)
        more = states.adjustment([number.get(w, -1) for w in own], number[b""])
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(own), sum(w in number for w in own), tokens)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["score"] == pytest.approx(base + more)


def test_arcs_do_not_go_as_the_corpus_grows(spark):
    """A passage seen twice keeps its arcs in a corpus of 900,000 tokens, where 4e-6 of them is 4."""
    rows = [(0, PROSE), (1, PROSE)] + [(k + 2, f"filler{k % 7} " * 4500) for k in range(200)]
    model = lm.train(docs(spark, rows))
    grams = {r["gram"] for r in model.weights.collect()}
    words = PROSE.split()
    assert model.tokens > 900_000 and {" ".join(words[i:i + k]) for k in (2, 3) for i in range(len(words) - k + 1)} <= grams


@pytest.mark.parametrize("numbered,part,bits", [(0, 40, 1 << 20), (4, 40, 1 << 20), (4, 10**6, 64), (1 << 18, 40, 64)])
def test_words_without_a_number_count_the_same(spark, monkeypatch, numbered, part, bits):
    """Grams are counted and scored right whichever of their words have numbers, over however many parts."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["a", "b", "Cé", "d", "d", f"w{rng.randint(0, 40)}", f"once{i}"]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(500, None), (None, "a b d"), (501, ""), (7, "a b d d")]

    def scores():
        df = docs(spark, rows).withColumn("flag", F.coalesce(F.col("doc_id") % 3 > 0, F.lit(False)))
        assert not df.schema["flag"].nullable
        found = lm.score(df, lm.train(df.filter("flag")), keep=["doc_id", "flag"]).collect()
        return sorted(((r["doc_id"] or -1, r["n_tokens"]), r) for r in found)

    plain = scores()
    for name, value in (("NUMBERED", numbered), ("PART", part), ("FILTER_BITS", bits), ("MEETING", 50), ("GATHER", 100)):
        monkeypatch.setattr(lm, name, value)
    other = scores()
    assert len(plain) == len(other) == len(rows)
    for (key, a), (same, b) in zip(plain, other):
        assert key == same and (a["n_known"], a["train_tokens"], a["flag"]) == (b["n_known"], b["train_tokens"], b["flag"])
        assert b["base_score"] == pytest.approx(a["base_score"]) and b["score"] == pytest.approx(a["score"])


def test_words_are_split_and_looked_up_per_batch(spark, monkeypatch):
    """Words come out as ``tokens_of`` gives them, and each distinct one of a batch is looked up once."""
    import pyarrow as pa

    rng = random.Random(7)
    texts = [None, "", " ", "A\tB\x0b c\x1cD  e ", "x\u00c9 y Z", "\n", *["".join(rng.choice("aZ \t\n\u00e9\u3000") for _ in range(rng.randint(0, 30))) for _ in range(200)]]
    whole = pa.array(texts)
    for column in (whole, whole.slice(3, 50), pa.array(texts, pa.large_string()), pa.array([None], pa.string()), pa.array([], pa.string()), pa.array([b"\xff A \xc3", b"b"])):
        words, sizes = lm.split_words(column)
        want = [lm.tokens_of(b if isinstance(b, bytes) or b is None else b.encode())[:-1] for b in column.to_pylist()]
        assert words.to_pylist() == [w for own in want for w in own] and sizes.tolist() == [len(own) for own in want]
    known = lm.Words([b"", b"b", b"\xef\xbf\xbd"], [3, 2, 1])
    looked_up, hashed = [], lm._hashed
    monkeypatch.setattr(lm, "_hashed", lambda words: looked_up.append(len(words)) or hashed(words))
    ids, doc = known.keys(pa.array(["a B " * 500, None, "b"]))
    assert looked_up == [2] and len(ids) == 1007 and ids[[0, 2, 1001, 1002, 1003, 1004, 1005, 1006]].tolist() == [1, 2, 1, 1, 1, 1, 2, 1]
    assert (ids[1:1001:2] == ids[1]).all() and ids[1] < 0 and np.bincount(doc).tolist() == [1002, 2, 3]
    assert known.keys(pa.array([b"\xff"]))[0].tolist() == [1, 3, 1]


def test_weights_of_trigrams_are_not_stored_on_the_way(spark, monkeypatch):
    """Trigrams meet the bigrams that they begin with in one shuffle; between counts and weights only bigrams and the words' backoff weights are stored."""
    staged, stage = [], lm.stage
    monkeypatch.setattr(lm, "stage", lambda df, name: staged.append(name) or stage(df, name))
    lm.train(docs(spark, [(k, PROSE) for k in range(3)]))
    assert staged == ["words", "keys", "grams", "bigrams", "backoff"]


def test_training_keeps_only_the_weights(spark):
    """What is stored on the way to the weights goes, and grams are stored as numbers."""
    import pathlib

    from newsflow.session import shared_dir

    folder = pathlib.Path(shared_dir(spark).removeprefix("file:")) / "newsflow"
    held = lambda: {p.name for p in folder.iterdir()} if folder.exists() else set()
    before = held()
    model = lm.train(docs(spark, [(k, PROSE) for k in range(5)]))
    assert [name.split("-")[0] for name in held() - before] == ["weights"]
    assert dict(model.table.dtypes) == {"key": "bigint", "c": "bigint", "logs": "double", "more": "double"}


def test_language_model_awkward(spark):
    source = docs(spark, awkward())
    assert lm.score(source, lm.train(source)).count() == len(awkward())
    nothing = lm.train(docs(spark, []))
    assert {r["score"] for r in lm.score(source, nothing).collect()} == {0.0}
    assert lm.score(docs(spark, []), nothing).count() == 0


# --- secrets --------------------------------------------------------------


def test_base_rules():
    text = 'x token=short token: "abcdefghijkl" Password=secret:abcdefghijkl AKIAABCDEFGHIJKLMN AKIASHORT 0123456789abcdef0 0123456789ABCDEF'
    spans, complete = secrets.scan(text)
    got = [(s["kind"], text[s["start"]:s["end"]]) for s in spans if s["base"]]
    # "Password=secret" is too short a value, and takes the word "secret" with it.
    assert got == [("assign", 'token: "abcdefghijkl'), ("access", "AKIAABCDEFGHIJKLMN"), ("hex", "0123456789abcdef0")] and complete
    assert secrets.scan("ſecret=abcdefghijklmnop") == ([], True)


@pytest.mark.parametrize("seed", range(12))
def test_nested_encodings(seed):
    rng = random.Random(seed)
    inner = "note token=abcdefghijkl0123 end"
    wraps = {
        "base64": lambda t: base64.b64encode(t.encode()).decode(), "safe64": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
        "gzip": lambda t: base64.b64encode(gzip.compress(t.encode())).decode(), "zlib": lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
        "url": lambda t: urllib.parse.quote(t, safe=""), "all_url": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
        "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t), "entity": lambda t: "".join(f"&#{ord(c)};" for c in t),
    }
    coded = inner
    for _ in range(rng.randint(1, 4)):
        coded = wraps[rng.choice(list(wraps))](coded)
    text = f"é東 before {coded} after"
    spans, _ = secrets.scan(text)
    at = text.index(coded)
    found = [s for s in spans if s["kind"] == "assign"]
    assert found and all(at <= s["start"] < s["end"] <= at + len(coded) for s in found)


def test_escapes_map_exactly():
    text = "say %74oken=abc%41bcdefghijkl. \\u0041KIAABCDEFGHIJKLMNOP, done"
    spans, _ = secrets.scan(text)
    assert [text[s["start"]:s["end"]] for s in spans] == ["%74oken=abc%41bcdefghijkl.", "\\u0041KIAABCDEFGHIJKLMNOP"]


def test_bombs_and_cycles():
    bomb = base64.b64encode(zlib.compress(b"a " * 500_000)).decode()
    assert secrets.scan(f"x {bomb} token=abcdefghijklmnop", max_decoded=10_000)[1] is False
    assert [s["kind"] for s in secrets.scan(f"x {bomb} token=abcdefghijklmnop", max_decoded=10_000)[0]] == ["assign"]
    assert secrets.scan("%2525252525" * 50)[1] is True
    assert secrets.scan("clean text of ordinary words, 100% sure") == ([], True)


@pytest.mark.parametrize("escape,width", [("%{:02X}", 3), ("\\x{:02x}", 4)])
@pytest.mark.parametrize("bad", [b"\xff", b"\xc3", b"\xe2\x82", b"\x80\xff"])
def test_invalid_bytes_stay_escaped(escape, width, bad):
    """A run of escapes loses only what is no character."""
    secret = "token=abcdefghijklmnop"
    write = lambda data: "".join(escape.format(b) for b in data)
    for head, tail in ((b"", bad), (bad, b""), (bad, bad)):
        text = "see " + write(head) + write(secret.encode()) + write(tail) + "!"
        spans = [(s["kind"], s["start"], s["end"]) for s in secrets.scan(text)[0] if not s["base"]]
        start = 4 + width * len(head)
        assert spans == [("assign", start, start + width * len(secret))]
    assert [s for s in secrets.scan("x" + write(bad) + "y")[0] if not s["base"]] == []


def test_lone_halves_stay_escaped():
    text = "\\ud83d" + "".join(f"\\u{ord(c):04x}" for c in "secret=abcdefghijklm") + "\\udc4d"
    assert [(s["kind"], s["start"], s["end"]) for s in secrets.scan(text)[0] if not s["base"]] == [("assign", 6, len(text) - 6)]
    assert secrets.scan("&#55357; &#xD83D; \\U0000D83D \\u{d83d}")[1] is True


@pytest.mark.parametrize("before", ["", "x", "ab", "abc"])
@pytest.mark.parametrize("after", ["", "y"])
def test_characters_glued_to_base64(before, after):
    coded = base64.b64encode(b"password: abcdefghijklmnopqr").decode().rstrip("=")
    text = f"see {before}{coded}{after} there"
    found = [s for s in secrets.scan(text)[0] if s["kind"] == "assign"]
    assert found and all(s["start"] <= 4 + len(before) and s["end"] >= 4 + len(before) + len(coded) - 3 for s in found)


def test_bare_deflate():
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    coded = base64.b64encode(packer.compress(b"secret = abcdefghijklmnop, once more abcdefghijklmnop") + packer.flush()).decode()
    assert "assign" in {s["kind"] for s in secrets.scan(f"x {coded} y")[0]}
    assert secrets._bare(b"plain bytes", 100) is None and secrets._bare(b"", 100) is None


def test_one_secret_at_many_places():
    inner = b"note token=abcdefghijkl0123 end"
    plain, packed = base64.b64encode(inner).decode(), base64.b64encode(gzip.compress(inner)).decode()
    text = f"a {plain} b {packed} c {plain} d %{plain[:1].encode().hex()}{plain[1:]}"
    spans, complete = secrets.scan(text)
    places = [m.start() for m in re.finditer(re.escape(plain), text)] + [text.index(packed), text.index("%")]
    assert sorted(s["start"] for s in spans) == sorted(places) and complete
    # Twice inside a layer that itself stands twice.
    outer = base64.b64encode(f"x {plain} y {plain}".encode()).decode()
    assert [s["start"] for s in secrets.scan(f"{outer} and {outer}")[0]] == [0, len(outer) + 5]


@pytest.mark.parametrize("width,newline", [(64, "\n"), (76, "\r\n"), (76, "\n    ")])
@pytest.mark.parametrize("after", ["", "end of it", "\nword\n"])
def test_base64_over_lines(width, newline, after):
    rng = random.Random(width)
    noise = " ".join(str(rng.random()) for _ in range(60))
    for body in (gzip.compress(f"{noise} token=abcdefghijkl0123 {noise}".encode()), f"{'x' * 40} token=abcdefghijkl0123 {noise}".encode()):
        coded = base64.b64encode(body).decode()
        block = newline.join(coded[k:k + width] for k in range(0, len(coded), width))
        text = f"key: |\n{block}\n{after}"
        assert ("assign", text.index(block), text.index(block) + len(block)) in {(s["kind"], s["start"], s["end"]) for s in secrets.scan(text)[0]}


def test_base64_lines_stay_linear():
    assert secrets.scan("Zz" * 100_000 + "\n!") == ([], True)


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress])
def test_later_members(pack):
    coded = base64.b64encode(pack(b"first part ") + pack(b"token=abcdefghijkl0123 ") + pack(b"AKIAABCDEFGHIJKLMN")).decode()
    assert {s["kind"] for s in secrets.scan(f"x {coded} y")[0]} >= {"assign", "access"}
    assert secrets.unpacked(pack(b"one") + b"no member", 100) == b"one"


@pytest.mark.parametrize("body", [
    b"token=abcdefghijkl0123\0", b"\x1b[31mtoken=abcdefghijkl0123\x1b[0m", "token=abcdefghijkl0123".encode("utf-16"),
    "token=abcdefghijkl0123".encode("utf-16-le"), "token=abcdefghijkl0123".encode("utf-16-be"),
])
def test_control_characters_and_wide_text(body):
    coded = base64.b64encode(body).decode()
    for text in (coded, "".join(f"%{b:02X}" for b in body), base64.b64encode(gzip.compress(body)).decode()):
        assert "assign" in {s["kind"] for s in secrets.scan(f"x {text} y")[0]}


def test_secrets_awkward(spark):
    rows = awkward() + [(9, "token=abcdefghijkl"), (10, "x" * 300_000 + " token=abcdefghijkl")]
    got = {(r["doc_id"], r["text"]): r["secrets"] for r in secrets.find_secrets(docs(spark, rows, ["secrets", "kind"])).collect()}
    assert [(s["start"], s["end"]) for s in got[10, rows[-1][1]]] == [(300_001, 300_019)]
    assert got[4, None] == [] and secrets.find_secrets(docs(spark, [])).count() == 0


# --- quality --------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(n - 4))
    covered = {k for i in range(n - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("place", [(1 << 30) - 1, (1 << 62) - 1])
def test_statistics_against_brute_force(spark, monkeypatch, place):
    """The second mask leaves the hash one bit, so nearly every window meets others and the windows decide."""
    if place > 1 << 32:
        monkeypatch.setattr(quality, "_PLACE", (1 << 30) - 1)
        monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(0).cast("long"))
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "bé", "c#", "d\n", "東", "|"]) for _ in range(rng.randint(0, 40)))) for i in range(40)] + awkward()[:8] + awkward()[9:]
    got = {(r["doc_id"], r["text"]): (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
           for r in quality.statistics(docs(spark, rows, ["_words", "n_lines", "c0"])).collect()}
    for r in rows:
        assert got[r[0], r[1]] == brute_counts(r[1])


def python_em(patterns, n_rules, steps):
    prior, good, bad = quality.START[0], [quality.START[1]] * n_rules, [quality.START[2]] * n_rules
    for _ in range(steps):
        share = []
        for v, _ in patterns:
            odds = math.log(prior / (1 - prior))
            odds += sum(math.log(g / (1 - b)) if x == 1 else math.log((1 - g) / b) if x == -1 else 0 for x, g, b in zip(v, good, bad))
            share.append(1 / (1 + math.exp(-odds)))
        w = [(s * n, (1 - s) * n, v) for s, (v, n) in zip(share, patterns)]
        prior = (sum(x[0] for x in w) + 1) / (sum(x[0] + x[1] for x in w) + 2)
        good = [max(quality.LEAST_GOOD, (sum(g for g, _, v in w if v[k] == 1) + 1) / (sum(g for g, _, v in w if v[k]) + 2)) for k in range(n_rules)]
        bad = [max(quality.LEAST_BAD, (sum(b for _, b, v in w if v[k] == -1) + 1) / (sum(b for _, b, v in w if v[k]) + 2)) for k in range(n_rules)]
    return prior, good, bad


def test_em_against_python(spark):
    rng = random.Random(6)
    votes = [[rng.choice([1, 1, 1, 0, -1]) for _ in range(4)] if rng.random() < 0.3 else [1, 1, rng.choice([0, 1]), 1] for _ in range(300)]
    df = spark.createDataFrame([tuple(v) for v in votes], ", ".join(f"vote_r{k} int" for k in range(4)))
    got = quality.estimate(df, [f"r{k}" for k in range(4)]).first()
    patterns = sorted((list(v), n) for v, n in collections.Counter(map(tuple, votes)).items())
    prior, good, bad = python_em(patterns, 4, quality.STEPS)
    assert got["prior"] == pytest.approx(prior) and got["good"] == pytest.approx(good) and got["bad"] == pytest.approx(bad)


def test_quality_awkward(spark):
    judged = quality.judge(quality.statistics(docs(spark, awkward(), ["kept", "vote_lines"])))
    rows = {(r["doc_id"], r["text"]): r for r in judged.collect()}
    assert not rows[4, None]["kept"] and not rows[6, awkward()[8][1]]["kept"] and rows[2, PROSE]["kept"]
    assert quality.judge(quality.statistics(docs(spark, []))).count() == 0
