"""Operators on hand-made rows against brute force."""

import collections
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from newsflow.functions import text as X
from newsflow.operators import (
    batch, classify, cleaning, crawl, encode, features, labels, linear, lookup, metrics, rouge, summarize,
)
from newsflow.schemas import ARTICLE, CATEGORY, DOMAIN_LABELS
from newsflow.session import stage


def articles(spark, rows):
    return spark.createDataFrame([("12/20", str(i), t, d, f"u{i}", h) for i, (t, d, h) in enumerate(rows)], ARTICLE)


def test_clean_and_route(spark):
    df = articles(spark, [("x", "stock", "日報告"), ("", "stock", "t"), ("x", "", "t"), ("x", "other", "操作策略"), ("y", "gold", "t")])
    assert {r["id"] for r in cleaning.clean_for_domain(df).collect()} == {"0", "4"}
    assert {r["id"]: r["route"] for r in cleaning.route_by_title(df).collect()} == {
        "0": "no_title", "1": "clean", "2": "clean", "3": "no_title", "4": "clean"}
    assert cleaning.flag_empty_text(df).count() == 5
    assert cleaning.flag_empty_text(df, drop=True).count() == 4


def test_columns(spark):
    df = articles(spark, [("body", "gold", "head")])
    assert cleaning.select_text_summary(df).first() == ("body", "head")
    with pytest.raises(ValueError):
        cleaning.select_text_summary(df, dataset="xsum")
    renamed = cleaning.rename_for_classifier(df)
    assert {"sentence", "label"} <= set(renamed.columns)
    assert cleaning.pick_sentence_pair(renamed) == ("sentence", None)
    pair = spark.createDataFrame([("a", "b")], "sentence1 string, sentence2 string")
    assert cleaning.pick_sentence_pair(pair) == ("sentence1", "sentence2")
    numbers = spark.createDataFrame([(1, 1.0)], "c int, r double")
    assert cleaning.detect_task_type(numbers, "c") == "classification"
    assert cleaning.detect_task_type(numbers, "r") == "regression"


def test_labels(spark):
    table = labels.label_table(spark, DOMAIN_LABELS)
    rows = spark.createDataFrame([(1, "gold"), (2, None), (3, "stock")], "id int, label string")
    coded = labels.encode_label(rows, table)
    assert {r["id"]: r["label"] for r in coded.collect()} == {1: 6, 2: 0, 3: 9}
    assert {r["id"]: r["t"] for r in labels.decode_label(coded, table, "label", "t").collect()} == {1: "gold", 2: "system", 3: "stock"}
    odd = spark.createDataFrame([(1, "nope")], "id int, label string")
    assert labels.encode_label(odd, table, unknown="null").first()["label"] is None
    with pytest.raises(Exception, match="unknown label: nope"):
        labels.encode_label(odd, table).collect()
    maps = spark.createDataFrame([('{"a": 1, "b": 0}',)], "value string")
    assert {tuple(r) for r in labels.label_map_rows("value", maps).collect()} == {("a", 1), ("b", 0)}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_lookup_join_under_skew(spark, monkeypatch, limit):
    """The same rows with the broadcast and with the hot/cold shuffle join."""
    monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", limit)
    monkeypatch.setattr(lookup, "HOT_KEYS", 4)
    keys = ["hot"] * 300 + [f"k{i % 50}" for i in range(200)] + ["absent", None]
    facts = spark.createDataFrame(list(enumerate(keys)), "row bigint, key string")
    counts = collections.Counter(k for k in keys if k and k != "absent")
    table = stage(spark.createDataFrame([(k, n, k.upper()) for k, n in counts.items()], "key string, n bigint, value string"), "t")
    got = {r["row"]: r["value"] for r in lookup.lookup_join(facts, table.drop("n"), "key").collect()}
    assert got == {i: (k.upper() if k in counts else None) for i, k in enumerate(keys)}


@pytest.mark.parametrize("stored", [True, False])
def test_lookup_join_spreads_a_hot_key(spark, monkeypatch, stored):
    """One key holds 80% of the facts, once stored and once absent; no broadcast by size, no adaptive plan."""
    monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", 0)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        key = F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 20_011).cast("string")))
        facts = spark.range(0, 200_000, 1, 8).withColumn("key", key)
        table = facts.select("key").distinct().filter(F.lit(stored) | (F.col("key") != "hot")).withColumn("value", F.upper("key"))
        joined = lookup.lookup_join(facts, stage(table, "t"), "key")
        assert joined.filter(F.col("value").isNull()).count() == (0 if stored else 160_000)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 200_000
        # Hot rows stay in the facts' partitions, the others are dealt over the shuffle's.
        assert max(s for s in sizes) <= 2 * 200_000 / 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_counted(spark):
    rows = [(1, ["b", "a", "b", ""]), (2, []), (3, ["x"])]
    df = spark.createDataFrame(rows, "id bigint, t array<string>")
    got = {(r["id"], r["term"]): r["tf"] for r in features.term_counts(df, F.col("t")).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 2, (1, ""): 1, (3, "x"): 1}


def test_vocabulary_ties(spark):
    words = [f"{a}{b}{c}" for a in "ab" for b in "xy" for c in "123"] * 2 + ["top"] * 5 + ["zz"]
    df = spark.createDataFrame([(1, words)], "id bigint, t array<string>")
    expected = [w for w, _ in sorted(collections.Counter(words).items(), key=lambda x: (-x[1], x[0]))]
    for size in (1, 2, 5, 9, 13, 14, 50):
        rows = encode.build_vocab(df, F.col("t"), size).orderBy("token_id").collect()
        assert [r["token"] for r in rows] == expected[:size] and [r["token_id"] for r in rows] == list(range(2, 2 + len(rows)))


def test_blocking_in_rank_order(spark):
    # The second repeats the first and goes; the third shares only with the second and stays; the fourth repeats itself.
    c = spark.createDataFrame([(1, 0, "a b c", 0.9), (1, 1, "a b d e", 0.8), (1, 2, "d e f", 0.7), (1, 3, "x y x y", 0.6)],
                              "id bigint, pos int, sentence string, score double")
    assert sorted(r["pos"] for r in summarize.block_repeat_ngrams(c, 2).collect()) == [0, 2]


TEXTS = ["the cat sat", "the dog", "", "cat cat [tag] dog sat", "only here"]


def brute_tfidf(texts, stop=()):
    docs = [[t for t in x.split() if t not in stop] for x in texts]
    df = collections.Counter(t for d in docs for t in set(d))
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}
    out = {}
    for i, d in enumerate(docs):
        raw = {t: n * idf[t] for t, n in collections.Counter(d).items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out.update({(i, t): w / norm for t, w in raw.items()})
    return idf, out


@pytest.mark.parametrize("limit", [10**6, 0])
def test_tfidf(spark, monkeypatch, limit):
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", limit)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")
    tokens = features.svm_tokens(F.col("text"), ["the"])
    model = features.tfidf_model(df, tokens)
    idf, weights = brute_tfidf(TEXTS, {"the"})
    assert {r["term"]: r["idf"] for r in model.collect()} == pytest.approx(idf)
    got = {(r["id"], r["term"]): r["weight"] for r in features.tfidf_transform(df, tokens, model).collect()}
    assert got == pytest.approx(weights)
    new = spark.createDataFrame([(7, "cat unseen cat")], "id bigint, text string")
    assert [(r["term"], r["tf"], r["doc_freq"]) for r in features.vocab_lookup(new, tokens, model).collect()] == [("cat", 2, 2)]


def test_encode_and_decode(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, "c zz b")], "id bigint, text string")
    tokens = X.pattern_tokens(F.col("text"))
    vocab = stage(encode.build_vocab(df, tokens, 2), "v")
    assert {r["token"]: r["token_id"] for r in vocab.collect()} == {"b": 2, "a": 3}
    ids = encode.encode_tokens(df, tokens, vocab)
    assert {r["id"]: r["ids"] for r in ids.collect()} == {1: [2, 3, 2], 2: [], 3: [1, 1, 2]}
    assert {r["id"]: r["text"] for r in encode.decode_ids(ids, vocab).collect()} == {1: "b a b", 2: "", 3: "b"}
    padded = {r["id"]: (r["batch"], r["input_ids"], r["attention_mask"]) for r in encode.pad_batches(ids, 2, multiple=2).collect()}
    assert padded == {1: (0, [2, 3, 2, 0], [1, 1, 1, 0]), 2: (0, [0] * 4, [0] * 4), 3: (1, [1, 1, 2, 0], [1, 1, 1, 0])}
    with pytest.raises(ValueError):
        encode.build_vocab(df, tokens, encode.MAX_VOCABULARY + 1)


def test_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, pred int")
    got = {r["class"]: tuple(r)[1:] for r in metrics.classification_report(df).collect()}
    assert got["2"] == (0.0, 0.0, 0.0, 1)
    assert got["1"] == pytest.approx((1 / 3, 1.0, 0.5, 1))
    assert got["micro avg"][0] == pytest.approx(0.5)
    assert got["weighted avg"][2] == pytest.approx((2 * (2 / 3) + 0.5 + 0) / 4)
    only = {r["class"] for r in metrics.classification_report(df, classes=[0, 1]).collect()}
    assert "2" not in only


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_rouge(spark):
    rng = random.Random(3)
    pairs = [([], []), ([], ["a"]), (["a"], []), (["a", "b"], ["a", "b"]), (["a"] * 5, ["a", "b", "a"]), (["x"], ["y"])]
    pairs += [([rng.choice("abcd") for _ in range(rng.randint(0, 40))], [rng.choice("abcde") for _ in range(rng.randint(0, 90))])
              for _ in range(60)]
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], "id bigint, pred_tokens array<string>, ref_tokens array<string>")

    def prf(overlap, n_pred, n_ref):
        p, r = (overlap / n_pred if n_pred else 0.0), (overlap / n_ref if n_ref else 0.0)
        return p, r, 2 * p * r / (p + r + 1e-8)

    def grams(t, n):
        return [tuple(t[i:i + n]) for i in range(len(t) - n + 1)]

    longest = {r["id"]: (r["rougel_p"], r["rougel_r"], r["rougel_f"]) for r in rouge.rouge_l(df).collect()}
    for i, (p, r) in enumerate(pairs):
        assert longest[i] == pytest.approx(prf(brute_lcs(p, r), len(p), len(r)))
    for n in (1, 2):
        sets = {r["id"]: (r[f"rouge{n}_p"], r[f"rouge{n}_r"], r[f"rouge{n}_f"]) for r in rouge.rouge_n(df, n).collect()}
        clipped = {r["id"]: (r[f"clipped{n}_p"], r[f"clipped{n}_r"], r[f"clipped{n}_f"]) for r in rouge.rouge_clipped(df, n).collect()}
        for i, (p, r) in enumerate(pairs):
            a, b = grams(p, n), grams(r, n)
            assert sets[i] == pytest.approx(prf(len(set(a) & set(b)), len(set(a)), len(set(b))))
            both = sum((collections.Counter(a) & collections.Counter(b)).values())
            assert clipped[i] == pytest.approx(prf(both, len(a), len(b)))


def candidates(spark, rows):
    return spark.createDataFrame(rows, "id bigint, pos int, sentence string, score double")


def test_selection(spark):
    c = candidates(spark, [(1, 0, "a b c", 0.1), (1, 1, "d e", 0.9), (1, 2, "b c x", 0.5), (1, 3, "q d e", 0.5), (2, 0, "z", 0.0)])
    assert {(r["id"], r["pos"]) for r in summarize.select_greedy(c).collect()} == {(1, 1), (2, 0)}
    assert {(r["id"], r["pos"]) for r in summarize.select_top_k(c, 2).collect()} == {(1, 1), (1, 2), (2, 0)}
    assert {r["id"]: r["summary"] for r in summarize.extractive_summary(c, 2).collect()} == {1: "d e b c x", 2: "z"}
    weights = {(r["id"], r["pos"]): r["weight"] for r in summarize.temperature_weights(c, 0.5).collect()}
    total = sum(math.exp(s / 0.5) for s in (0.1, 0.9, 0.5, 0.5))
    assert weights[(1, 1)] == pytest.approx(math.exp(1.8) / total)
    assert weights[(2, 0)] == 1.0
    assert {(r["id"], r["pos"]) for r in summarize.select_top_p(c, 0.3).collect()} == {(1, 1), (2, 0)}
    kept = {(r["id"], r["pos"]) for r in summarize.block_repeat_ngrams(c, 2).collect()}
    assert kept == {(1, 1), (1, 2), (2, 0)}


def test_sampling_matches_runs(spark):
    c = candidates(spark, [(i, p, f"s{p}", ((i * 7 + p * 3) % 10) / 10) for i in range(40) for p in range(6)])
    draws = summarize.sample_candidate(summarize.temperature_weights(c, 0.5)).collect()
    assert len(draws) == 40 and len({r["pos"] for r in draws}) > 1
    runs = summarize.decoding_runs(c, [("greedy", 1.0, 1, None), ("nucleus", 1.0, None, 1e-9), ("all", 0.5, None, None)])
    got = {(r["id"], r["run"]): r["pos"] for r in runs.collect()}
    best = {r["id"]: r["pos"] for r in summarize.select_greedy(c).collect()}
    assert len(got) == 120
    assert all(got[(i, "greedy")] == got[(i, "nucleus")] == best[i] for i in range(40))


def test_sentence_scores(spark):
    text = "cat sat. dog sat sat! the"
    df = spark.createDataFrame([(1, text), (2, "cat. bird"), (3, "")], "id bigint, maintext string")
    model = features.tfidf_model(df, features.svm_tokens(F.col("maintext"), ["the"]))
    _, w = brute_tfidf(["cat sat dog sat sat", "cat bird", ""])
    got = {(r["id"], r["pos"]): r["score"] for r in summarize.score_sentences(df, model, ["the"]).collect()}
    expected = {(1, 0): (w[0, "cat"] + w[0, "sat"]) / 2, (1, 1): (w[0, "dog"] + 2 * w[0, "sat"]) / 3, (1, 2): 0.0,
                (2, 0): w[1, "cat"], (2, 1): w[1, "bird"]}
    assert got == pytest.approx(expected, abs=1e-6)


def test_naive_bayes(spark):
    rows = [(1, "a a b", "x"), (2, "b c", "y"), (3, "a", "x"), (4, "zz", "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, label string")
    tokens = X.pattern_tokens(F.col("text"))
    model = classify.train_naive_bayes(df.filter("id < 4"), tokens)
    got = {r["id"]: (r["pred"], r["score"]) for r in classify.predict_naive_bayes(df, tokens, model).collect()}
    log = math.log
    scores = lambda t: {
        "x": log(2 / 3) + sum(log(({"a": 3, "b": 1}.get(u, 0) + 1) / 7) for u in t),
        "y": log(1 / 3) + sum(log(({"b": 1, "c": 1}.get(u, 0) + 1) / 5) for u in t),
    }
    for i, text, _ in rows:
        s = scores([u for u in text.split() if u in "abc"])
        assert got[i] == (max(s, key=s.get), pytest.approx(max(s.values()), abs=1e-6))


def test_learned_models_beat_majority(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        label = int(i % 3 == 0)
        words = [rng.choice(["good", "rise", "gain"] if label else ["bad", "fall", "loss"]) for _ in range(4)]
        words += [rng.choice("abcdefgh") for _ in range(6)]
        rows.append((i, words, label))
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>, label int")
    train, test = df.filter("id % 5 > 0"), df.filter("id % 5 = 0")
    tokens = F.col("tokens")
    svm, logistic = linear.fit_svm(train, tokens), linear.fit_logistic(train, tokens, 2)
    for model, pred in ((svm, (F.col("scores")[0] >= 0).cast("int")), (logistic, linear.best_output(F.col("scores")))):
        scored = test.join(model.scores(test, tokens), "id").withColumn("pred", pred)
        assert scored.agg(metrics.accuracy()).first()[0] > 0.9
    odd = spark.createDataFrame([(1, []), (2, ["never", "seen"])], "id bigint, tokens array<string>")
    assert {tuple(r["scores"]) for r in svm.scores(odd, tokens).collect()} == {(round(svm.bias[0], 6),)}


def test_social_tokens(spark):
    df = spark.createDataFrame([("我 @bob 不 好 Go",)], "t string")
    assert df.select(classify.social_tokens(F.col("t"), ("不",))).first()[0] == ["我", "不好", "go"]


def test_frontier(spark):
    lists = [([f"https://news.example/{name}/{k}?page={{}}" for k in range(n)], name) for name, n in (("gold", 2), ("bond", 5))]
    frontier = crawl.crawl_frontier(spark.createDataFrame(lists, CATEGORY))
    assert frontier.count() == 35
    assert frontier.filter("source_domain = 'bond'").count() == 25
    chunks = crawl.chunked_frontier(spark.createDataFrame([("https://news.example/list/{}",)], "template string"))
    pages = [r["page"] for r in chunks.collect()]
    assert len(pages) == 360 and min(pages) == 10 and max(pages) == 399 and 105 not in pages


def test_links(spark):
    html = '<ul><li><a href="/head">h</a></li><li><a href="/2">x</a></li><li>no link</li></ul>'
    pages = spark.createDataFrame(
        [(1, "http://a.org/1", html), (2, "http://a.org/2/", "<li>only header</li>"), (3, "https://A.org/2", "")],
        "page_id bigint, url string, html string",
    )
    links = crawl.resolve_links(crawl.extract_links(pages))
    assert [(r["page_id"], r["pos"], r["link"]) for r in links.collect()] == [(1, 1, "http://a.org/2")]
    assert [r["target_id"] for r in crawl.link_page_join(links, pages).collect()] == [2]
    assert crawl.links_to_fetch(links, pages.filter("page_id = 1")).count() == 1


def test_batches(spark):
    df = spark.range(10).repartition(3)
    doubled = batch.map_batches(df, lambda b: b * 2, "id bigint")
    assert sorted(r["id"] for r in doubled.collect()) == list(range(0, 20, 2))

    def load():
        return lambda b: b.assign(y=b["id"] % 2)

    assert batch.batch_inference(df, load, "id bigint, y bigint").filter("y = 1").count() == 5


def planted_texts(spark, n=120, seed=5):
    """Rows of two classes that share most words; a third of the rows has one word in common."""
    import random

    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.8)
        own = rng.sample(words, 8) + (["good"] if label else ["bad"]) * rng.randint(1, 2)
        rng.shuffle(own)
        rows.append((i, " ".join(own), label))
    return rows, spark.createDataFrame(rows, "id bigint, text string, label int").withColumn("tokens", F.split("text", " "))


def dense(rows):
    """Unit TF-IDF vectors of the rows, and their terms."""
    import collections
    import math

    import numpy as np

    counts = [collections.Counter(t.split()) for _, t, _ in rows]
    df = collections.Counter(w for c in counts for w in c)
    terms = sorted(df)
    x = np.array([[c[w] * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w in terms] for c in counts])
    return x / np.sqrt((x**2).sum(1, keepdims=True)), terms


@pytest.mark.parametrize("limit", [None, 0])
def test_svm_converges(spark, monkeypatch, limit):
    """The objective of a long run of plain descent is met, classes that can be told apart are, in both ways of meeting the terms."""
    import numpy as np

    from newsflow.operators import linear, lookup

    if limit is not None:
        monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", limit)
    rows, df = planted_texts(spark)
    model = linear.fit_svm(df, F.col("tokens"))
    x, terms = dense(rows)
    sign = np.array([1.0 if r[2] else -1.0 for r in rows])
    reg, w, b = 1 / len(rows), np.zeros(len(terms)), 0.0
    value = lambda w, b: reg / 2 * w @ w + np.mean(np.maximum(0, 1 - sign * (x @ w + b)) ** 2)
    for _ in range(20_000):
        e = -2 * sign * np.maximum(0, 1 - sign * (x @ w + b)) / len(rows)
        w, b = w - 0.24 * (reg * w + x.T @ e), b - 0.24 * e.sum()
    found = {r["term"]: r["coefs"][0] for r in model.terms.collect()}
    ours = value(np.array([found[t] for t in terms]), model.bias[0])
    assert abs(ours - model.objective) < 1e-6
    assert value(w, b) <= ours * (1 + 1e-9) and ours <= value(w, b) * 1.01
    assert model.gap <= linear.GAP and model.steps < linear.MAX_STEPS
    scored = df.join(model.scores(df, F.col("tokens")), "id").select("label", (F.col("scores")[0] >= 0).cast("int").alias("pred")).collect()
    assert all(r["label"] == r["pred"] for r in scored)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("weights_by")]


def test_logistic_regression_converges(spark):
    import numpy as np

    from newsflow.operators import linear

    rows, df = planted_texts(spark, 90, seed=8)
    rows = [(i, t, i % 3 if i % 5 else 0) for i, t, _ in rows]
    df = spark.createDataFrame(rows, "id bigint, text string, label int").withColumn("tokens", F.split("text", " "))
    model = linear.fit_logistic(df, F.col("tokens"), 3, reg=1e-2)
    x, terms = dense(rows)
    y = np.eye(3)[[r[2] for r in rows]]
    w, b = np.zeros((len(terms), 3)), np.zeros(3)

    def loss(w, b):
        m = x @ w + b
        m -= m.max(1, keepdims=True)
        return np.mean(np.log(np.exp(m).sum(1)) - (m * y).sum(1)) + 5e-3 * (w**2).sum()

    for _ in range(5_000):
        m = np.exp(x @ w + b)
        e = (m / m.sum(1, keepdims=True) - y) / len(rows)
        w, b = w - 0.9 * (1e-2 * w + x.T @ e), b - 0.9 * e.sum(0)
    assert loss(w, b) <= model.objective * (1 + 1e-9) and model.objective <= loss(w, b) * 1.01


@pytest.mark.parametrize("rows", [[], [(1, ["a"], 1)], [(1, ["a"], 1), (2, [], 0)], [(1, None, 1), (2, ["b", "b"], 0), (2, ["b"], 1)]])
def test_svm_of_few_rows(spark, rows):
    from newsflow.operators import linear

    df = spark.createDataFrame(rows, "id bigint, tokens array<string>, label int")
    model = linear.fit_svm(df, F.col("tokens"))
    assert model.scores(df.dropDuplicates(["id"]), F.col("tokens")).count() == len({r[0] for r in rows})


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_encoding_moves_no_document(spark):
    from newsflow.operators import encode

    df = spark.createDataFrame([(1, ["b", "a", "zz"]), (2, None), (3, []), (3, ["a", None])], "id bigint, t array<string>")
    vocab = stage(encode.build_vocab(df.filter("id <> 3"), F.col("t"), 2), "v")
    ids = encode.encode_tokens(df, F.col("t"), vocab)
    texts = encode.decode_ids(ids, vocab)
    assert exchanges(ids) == 0 and exchanges(texts) == 0
    assert [tuple(r) for r in ids.orderBy("id", F.size("ids")).collect()] == [(1, [3, 2, 1]), (2, []), (3, []), (3, [2, 1])]
    assert sorted(r["text"] for r in texts.collect()) == ["", "", "a", "b a"]
    pairs = encode.encode_pairs(df, F.col("t"), F.reverse("t"), vocab)
    assert exchanges(pairs) == 0 and pairs.filter("id = 1").first()["ids2"] == [1, 2, 3]


def test_sentence_scores_move_no_text(spark):
    from newsflow.operators import features, summarize

    df = spark.createDataFrame([(1, "Gold rises. Gold falls again! New words only."), (2, None), (3, ""), (4, "Gold.")], "id bigint, maintext string")
    model = stage(features.tfidf_fit(df.filter("id <> 4 OR id = 4"), features.svm_tokens(F.regexp_replace("maintext", "New words only", ""))), "m")
    near = summarize.score_sentences(df, model)
    far = summarize._score_by_join(df, model, (), "maintext", "id")
    assert exchanges(near) == 0
    rows = sorted(tuple(r) for r in near.collect())
    assert rows == sorted(tuple(r) for r in far.collect()) and len(rows) == 4 and rows[2][3] == 0.0


def test_blocking_is_linear(spark):
    """An article of 20,000 sentences, most of them repeats."""
    from newsflow.operators import summarize

    rows = [(1, i, f"a{i % 5000} b{i % 5000} c{i % 5000}", 1.0 - i * 1e-6) for i in range(20_000)] + [(2, 0, "x y x y", 0.5), (2, 1, "x y", 0.4), (2, 2, "", 0.3)]
    df = spark.createDataFrame(rows, "id bigint, pos int, sentence string, score double")
    kept = summarize.block_repeat_ngrams(df.withColumn("sentence", F.translate("sentence", "0123456789", "qrstuvwxyz")), 2)
    assert kept.filter("id = 1").agg(F.count(F.lit(1)), F.max("pos"), F.max("rank")).first() == (5000, 4999, 5000)
    assert sorted((r["pos"], r["rank"]) for r in kept.filter("id = 2").collect()) == [(1, 2), (2, 3)]


def test_runs_agree_with_windows(spark):
    """Each run alone, by the window operators, takes the same sentence."""
    from newsflow.operators import summarize

    rng = random.Random(4)
    rows = [(i, p, f"s{p}", round(rng.random(), 2)) for i in range(40) for p in range(1 + i % 9)]
    df = spark.createDataFrame(rows, "id bigint, pos int, sentence string, score double")
    runs = (("greedy", 1.0, 1, None), ("cool", 0.1, None, None), ("some", 1.0, 3, None), ("mass", 0.5, None, 0.6))
    got = {(r["id"], r["run"]): r["pos"] for r in summarize.decoding_runs(df, runs).collect()}
    assert len(got) == 160
    best = {r["id"]: r["pos"] for r in summarize.select_greedy(df).collect()}
    assert all(got[i, "greedy"] == p for i, p in best.items())
    for name, t, k, p in runs[1:]:
        kept = summarize.select_top_k(df, k) if k else summarize.select_top_p(df, p, t) if p else summarize.rank_candidates(df)
        weighted = summarize.temperature_weights(kept.drop("rank", "weight"), t)
        upto = {}
        for r in summarize.rank_candidates(weighted).select("id", "pos", "rank", "weight", summarize.uniform_draw(42, F.concat_ws(":", F.lit(name), F.col("id").cast("string"))).alias("u")).orderBy("id", "rank").collect():
            before, done = upto.get(r["id"], (0.0, None))
            upto[r["id"]] = (before + r["weight"], r["pos"] if done is None and before + r["weight"] >= r["u"] else done)
        assert {i: x[1] for i, x in upto.items()} == {i: got[i, name] for i in upto}


def common_words(ref, pred):
    """One longest common subsequence by plain recursion over prefixes."""
    from functools import lru_cache

    @lru_cache(None)
    def size(i, j):
        if not i or not j:
            return 0
        return size(i - 1, j - 1) + 1 if ref[i - 1] == pred[j - 1] else max(size(i - 1, j), size(i, j - 1))

    def back(i, j):
        if not i or not j:
            return []
        if ref[i - 1] == pred[j - 1]:
            return back(i - 1, j - 1) + [ref[i - 1]]
        return back(i - 1, j) if size(i - 1, j) > size(i, j - 1) else back(i, j - 1)

    found = back(len(ref), len(pred))
    assert len(found) == size(len(ref), len(pred))
    return set(found)


def test_rouge_l_union(spark):
    from newsflow.operators import rouge

    rng = random.Random(6)
    text = lambda: [[rng.choice("abcdef") for _ in range(rng.randrange(7))] for _ in range(rng.randrange(4))]
    rows = [(i, text(), text()) for i in range(60)] + [(90, None, [["a"]]), (91, [], []), (92, [["a", "b"]], [["a", "b"]])]
    df = spark.createDataFrame(rows, "id int, pred_sentences array<array<string>>, ref_sentences array<array<string>>")
    for r in rouge.rouge_l_union(df).collect():
        p, q = r["pred_sentences"] or [], r["ref_sentences"]
        both = len(set().union(*(common_words(tuple(y), tuple(x)) for x in p for y in q)))
        n_p, n_q = len(set().union(*p)), len(set().union(*q))
        precision, recall = both / n_p if n_p else 0.0, both / n_q if n_q else 0.0
        assert (r["rougelu_p"], r["rougelu_r"]) == pytest.approx((precision, recall))
        assert r["rougelu_f"] == pytest.approx(2 * precision * recall / (precision + recall + 1e-8))


def test_phrases_leftmost_longest(spark):
    """Against a plain walk, with phrases inside and across each other and replacements that look like phrases."""
    from newsflow.operators import crawl

    phrases = {"ab": "<x>", "abc": "ab", "b": "cc", "ca": "b", "[": "]", "漢字": "汉字", "": "never"}
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc[漢字 ") for _ in range(rng.randrange(30))) for _ in range(200)] + ["", None, "x" * 100_000 + "abc"]

    def plain(t):
        out, i = "", 0
        while i < len(t):
            own = max((p for p in phrases if p and t.startswith(p, i)), key=len, default=None)
            out, i = (out + phrases[own], i + len(own)) if own else (out + t[i], i + 1)
        return out

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: r["t"] for r in df.select("id", crawl.convert_phrases(F.col("t"), phrases).alias("t")).collect()}
    assert got == {i: None if t is None else plain(t) for i, t in enumerate(texts)}


def test_training_takes_few_jobs(spark):
    """A step is one pass over the rows, two at most, and rare terms don't make it take many steps."""
    from newsflow.operators import linear

    rows = [(i, int(i % 3 == 0), [f"w{i % 7}", f"w{i * i % 11}", f"rare{i}", "yes" if i % 3 == 0 and i % 5 else "no"]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, label int, tokens array<string>")
    context = spark.sparkContext
    context.setJobGroup("few-jobs", "training")
    model = linear.fit_svm(df, F.col("tokens"))
    jobs = len(context.statusTracker().getJobIdsForGroup("few-jobs"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert model.gap <= linear.GAP
    assert jobs <= 40 + 4 * model.steps and model.steps <= 60


def test_rows_that_share_an_id_train_alike_on_both_paths(spark, monkeypatch):
    """Repeated and null ids, a row without terms: broadcast coefficients and tables of terms reach the same objective."""
    from newsflow.operators import linear

    rows = [(i % 40 if i % 9 else None, i % 2, [f"w{i % 5}", f"x{i % 2}"] if i % 13 else []) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, label int, tokens array<string>")
    found = []
    for limit in (lookup.MAX_BROADCAST_BYTES, 0):
        monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", limit)
        found.append(linear.fit_svm(df, F.col("tokens"), gap=1e-5))
    assert all(m.gap <= 1e-5 for m in found)
    assert abs(found[0].objective - found[1].objective) <= 2e-5 * found[1].objective


def test_training_rows_need_a_label(spark):
    from newsflow.operators import linear

    df = spark.createDataFrame([(1, 1, ["a"]), (2, None, ["b"]), (3, 0, ["c"])], "id long, label int, tokens array<string>")
    with pytest.raises(Exception, match="without a label"):
        linear.fit_svm(df, F.col("tokens"))


def test_terms_in_slices_take_few_jobs(spark, monkeypatch):
    """Coefficients beyond a broadcast: a step is at most four jobs, several slices and ranges give the minimum of plain descent, nothing is left behind."""
    import numpy as np

    from newsflow.operators import linear

    monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(linear, "LEAST_ENTRIES", 300)
    monkeypatch.setattr(linear, "RANGE_ROWS", 16)
    rows, df = planted_texts(spark, 90, seed=8)
    rows = [(i, t, i % 3 if i % 5 else 0) for i, t, _ in rows]
    df = spark.createDataFrame(rows, "id bigint, text string, label int").withColumn("tokens", F.split("text", " "))
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getConf().get('spark.checkpoint.dir')}/newsflow"
    folder = folder.removeprefix("file://")
    context = spark.sparkContext
    context.setJobGroup("sliced-jobs", "training")
    model = linear.fit_logistic(df, F.col("tokens"), 3, reg=1e-2, gap=1e-4)
    jobs = len(context.statusTracker().getJobIdsForGroup("sliced-jobs"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 40 + 4 * model.steps and model.steps <= 60 and model.gap <= 1e-4
    assert not [x for x in os.listdir(folder) if x.startswith(("linear_slices", "linear_state"))]
    x, terms = dense(rows)
    y = np.eye(3)[[r[2] for r in rows]]
    w, b = np.zeros((len(terms), 3)), np.zeros(3)
    for _ in range(5_000):
        m = np.exp(x @ w + b)
        e = (m / m.sum(1, keepdims=True) - y) / len(rows)
        w, b = w - 0.9 * (1e-2 * w + x.T @ e), b - 0.9 * e.sum(0)
    m = x @ w + b
    least = np.mean(np.log(np.exp(m).sum(1)) - (m * y).sum(1)) + 5e-3 * (w**2).sum()
    assert least <= model.objective * (1 + 1e-9) and model.objective <= least * 1.0002
    found = {r["term"]: r["coefs"] for r in model.terms.collect()}
    assert np.allclose([found[t] for t in terms], w, atol=0.02)


def test_slices_of_rows_without_ids_terms_or_labels(spark, monkeypatch):
    """The idf of other rows, repeated and null ids and empty rows: as with broadcast coefficients. A row needs a label."""
    from newsflow.operators import linear

    rows = [(i % 40 if i % 9 else None, i % 2, [f"w{i % 5}", f"x{i % 2}", f"x{i % 2}", f"only{i}"] if i % 13 else []) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, label int, tokens array<string>")
    other = df.filter("id % 3 > 0").unionByName(spark.createDataFrame([(99, 0, ["new"]), (100, 1, ["w1", None])], df.schema))
    found = []
    for limit in (lookup.MAX_BROADCAST_BYTES, 0):
        monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", limit)
        monkeypatch.setattr(linear, "LEAST_ENTRIES", 20)
        found.append(linear.fit_linear(df, F.col("tokens"), 1, linear.squared_hinge, 1e-2, idf_rows=other, gap=1e-6))
    assert abs(found[0].objective - found[1].objective) <= 2e-6 * found[1].objective
    one, two = ({r["term"]: r["coefs"][0] for r in m.terms.collect()} for m in found)
    assert one.keys() == two.keys() and all(abs(one[t] - two[t]) < 1e-2 for t in one) and two["new"] == 0.0
    with pytest.raises(Exception, match="without a label"):
        linear.fit_svm(spark.createDataFrame([(1, 1, ["a"]), (2, None, ["b"])], df.schema), F.col("tokens"))
