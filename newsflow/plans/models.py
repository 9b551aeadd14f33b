"""Queries: TF-IDF, classifiers, summaries, ROUGE."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.functions import text as X
from newsflow.operators import classify, features, labels, linear, metrics, ordering, rouge, summarize
from newsflow.plans.prep import STRATIFIED_SQL
from newsflow.plans.registry import query
from newsflow.plans.scoring import DOMAIN_SQL
from newsflow.plans.tables import (
    ART, CAND, LATIN_NEGATORS, STOPWORDS, TF, articles, documents, labelled, sql_sentences, sql_tokens, sql_words, table, text_tasks, texts, with_,
)
from newsflow.schemas import DOMAIN_LABELS, SENTIMENT_LABELS
from newsflow.session import stage, staging_path
from newsflow.sources import writers

SUMMARY_SENTENCES = 3
# (name, temperature, top-k, top-p) of the compared decoding settings.
RUNS = (
    ("greedy", 1.0, 1, None),
    ("temperature_0.5", 0.5, None, None),
    ("temperature_0.8", 0.8, None, None),
    ("top_k_30", 1.0, 30, None),
    ("top_k_50", 1.0, 50, None),
    ("top_p_0.5", 1.0, None, 0.5),
    ("top_p_0.9", 1.0, None, 0.9),
)


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE" + with_(*parts)[4:]


def stopped_tokens(column="maintext"):
    return features.svm_tokens(F.col(column), STOPWORDS)


def docs(spark, sf, tasks=None):
    return documents(spark, sf, tasks).withColumnRenamed("text", "maintext")


# --- TF-IDF ------------------------------------------------------------------


@query("tfidf_fit", with_(*TF, "SELECT term, df, round(idf, 6) AS idf FROM idf"))
def tfidf_fit(spark, sf):
    return features.tfidf_fit(docs(spark, sf), stopped_tokens()).withColumn("idf", F.round("idf", 6))


@query("tfidf_transform", with_(*TF, "SELECT id, term, tf, round(weight, 6) AS weight FROM w"))
def tfidf_transform(spark, sf):
    model = features.tfidf_model(docs(spark, sf), stopped_tokens())
    return features.tfidf_transform(docs(spark, sf), stopped_tokens(), model).select(
        "id", "term", "tf", F.round("weight", 6).alias("weight")
    )


@query("vocab_lookup", with_(*TF,
       f"new AS (SELECT page_id AS id, unnest({sql_tokens('html', stop=True)}) AS term FROM pages)",
       "SELECT n.id, n.term, n.tf, idf.df AS doc_freq, round(idf.idf, 6) AS idf FROM (SELECT id, term, count(*) AS tf FROM new GROUP BY ALL) n "
       "JOIN idf USING (term)"))
def vocab_lookup(spark, sf):
    """Terms of new texts (pages) found in the vocabulary of the documents."""
    model = features.tfidf_model(docs(spark, sf), stopped_tokens())
    pages = texts(spark, sf, "pages", "page_id").select(F.col("page_id").alias("id"), "html")
    found = features.vocab_lookup(pages, stopped_tokens("html"), model)
    return found.select("id", "term", "tf", "doc_freq", F.round("idf", 6).alias("idf"))


# --- classifiers -------------------------------------------------------------

NB_SQL = (
    f"ntok AS (SELECT doc_id AS id, lang AS label, {sql_tokens('text', stop=True)} AS ts FROM documents)",
)


def nb_sql(train: str) -> tuple[str, ...]:
    """Naive Bayes on the rows of ``ntok`` that satisfy ``train``."""
    return (
        *NB_SQL,
        f"tr AS (SELECT * FROM ntok WHERE {train})",
        "prior AS (SELECT label, ln(count(*) / (SELECT count(*) FROM tr)) AS lp, sum(len(ts)) AS total FROM tr GROUP BY label)",
        "occ AS (SELECT label, unnest(ts) AS term FROM tr)",
        "cnt AS (SELECT label, term, count(*) AS c FROM occ GROUP BY ALL)",
        "vocab AS (SELECT term, CAST(sum(c) AS BIGINT) AS n FROM cnt GROUP BY term)",
        "nb AS (SELECT v.term, v.n, p.label, ln((coalesce(c.c, 0) + 1.0) / (p.total + (SELECT count(*) FROM vocab))) AS logp "
        "FROM vocab v CROSS JOIN prior p LEFT JOIN cnt c ON c.term = v.term AND c.label = p.label)",
    )


NB_SCORE_SQL = (
    "uses AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM ntok) GROUP BY ALL)",
    "part AS (SELECT u.id, nb.label, sum(u.tf * nb.logp) AS s FROM uses u JOIN nb USING (term) GROUP BY ALL)",
    "score AS (SELECT k.id, p.label, round(coalesce(part.s, 0.0) + p.lp, 6) AS score FROM ntok k CROSS JOIN prior p "
    "LEFT JOIN part ON part.id = k.id AND part.label = p.label)",
    "best AS (SELECT id, label AS pred, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS k "
    "FROM score) WHERE k = 1)",
)


def language_rows(spark, sf):
    docs_ = texts(spark, sf, "documents", "doc_id")
    return docs_.select(F.col("doc_id").alias("id"), F.col("text").alias("maintext"), F.col("lang").alias("label"))


@query("domain_classifier_train", with_(*nb_sql("TRUE"), "SELECT term, label, round(logp, 6) AS logp FROM nb"))
def domain_classifier_train(spark, sf):
    model = classify.train_naive_bayes(language_rows(spark, sf), stopped_tokens())
    return model.term_rows().withColumn("logp", F.round("logp", 6))


@query("domain_classifier_predict", with_(*nb_sql("TRUE"), *NB_SCORE_SQL,
       "SELECT 'test-' || (row_number() OVER (ORDER BY id) - 1) AS id, pred AS source_domain, score FROM best"))
def domain_classifier_predict(spark, sf):
    rows = language_rows(spark, sf)
    model = classify.train_naive_bayes(rows, stopped_tokens())
    scored = stage(classify.predict_naive_bayes(rows.drop("label"), stopped_tokens(), model), "predictions")
    numbered = ordering.assign_ordinal(scored, "id")
    return numbered.select(
        writers.format_row_id("ordinal").alias("id"), F.col("pred").alias("source_domain"), "score"
    )


@query("classifier_evaluate", with_(
       ART, *STRATIFIED_SQL, *nb_sql("id IN (SELECT id FROM strat WHERE split = 'train')"), *NB_SCORE_SQL,
       "ev AS (SELECT b.pred, s.lang AS label FROM best b JOIN strat s USING (id) WHERE s.split = 'valid')",
       "cls AS (SELECT DISTINCT label AS c FROM ev UNION SELECT DISTINCT pred FROM ev)",
       "per AS (SELECT c, (SELECT count(*) FROM ev WHERE label = c AND pred = c) AS h, (SELECT count(*) FROM ev WHERE pred = c) AS pr, "
       "(SELECT count(*) FROM ev WHERE label = c) AS su FROM cls)",
       "fs AS (SELECT *, CASE WHEN h = 0 THEN 0.0 ELSE 2 * (h / pr) * (h / su) / (h / pr + h / su) END AS f FROM per)",
       "SELECT 'accuracy' AS metric, round(sum(h) / sum(su), 6) AS value FROM fs UNION ALL SELECT 'f1', round(avg(f), 6) FROM fs "
       "UNION ALL SELECT 'eval_samples', CAST(sum(su) AS DOUBLE) FROM fs"))
def classifier_evaluate(spark, sf):
    """Train on the stratified train part, score the rest."""
    parts = stage(ordering.split_stratified(language_rows(spark, sf), "label"), "split")
    train, valid = (parts.filter(F.col("split") == s) for s in ("train", "valid"))
    model = classify.train_naive_bayes(train, stopped_tokens())
    predicted = classify.predict_naive_bayes(valid, stopped_tokens(), model)
    scored = valid.select("id", "label").join(predicted, "id")
    row = metrics.class_scores(scored).agg(
        F.round(F.sum("hits") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("f1"),
        F.sum("support").cast("double").alias("eval_samples"),
    )
    return metrics.long_metrics(row, ["accuracy", "f1", "eval_samples"])


# Accelerated gradient steps of the check; enough for the tables it runs on.
CHECK_STEPS = 800


def linear_sql(kind: str, train: str, classes: str, reg: str) -> tuple[str, ...]:
    """A linear model on ``ltok(id, label, ts)``: ``cf`` (term, k, c) and ``bs`` (k, b).

    Another way to the same minimum: coefficients as a combination of the training rows, whose weights ``a`` take accelerated gradient steps
    over the matrix of inner products. ``train`` selects rows; ``classes`` lists the outputs; ``reg`` is the ridge.
    """
    if kind == "hinge":
        curve, target = 2.0, "CASE WHEN label = 1 THEN 1.0 ELSE -1.0 END"
        slopes = "list_transform(list_zip(m, y), lambda z: list_transform(list_zip(z[1], z[2]), lambda q: -2.0 * q[2] * greatest(0.0, 1.0 - q[2] * q[1])))"
    else:
        curve, target = 0.5, "CASE WHEN label = k THEN 1.0 ELSE 0.0 END"
        raised = "list_transform(m, lambda r: list_transform(r, lambda x: exp(x)))"
        total = f"list_reduce({raised}, lambda x, w: list_transform(list_zip(x, w), lambda z: z[1] + z[2]))"
        slopes = (
            "list_transform(list_zip(ex, y), lambda z: list_transform(list_zip(z[1], z[2], tot), lambda q: q[1] / q[3] - q[2])) "
            f"FROM (SELECT *, {raised} AS ex, {total} AS tot FROM mg)"
        )
    mix = lambda x, w, f: f"list_transform(list_zip({x}, {w}), lambda z: list_transform(list_zip(z[1], z[2]), lambda q: {f}))"
    flat = lambda x, w, f: f"list_transform(list_zip({x}, {w}), lambda q: {f})"
    step = f"(1.0 / (2.0 * {curve} + reg))"
    pull = "((1.0 - sqrt(reg * " + step + ")) / (1.0 + sqrt(reg * " + step + ")))"
    return (
        f"ltr AS MATERIALIZED (SELECT id, label, ts, row_number() OVER (ORDER BY id) AS i FROM ltok WHERE {train})", f"ln_ AS (SELECT count(*)::DOUBLE AS n, {reg} AS reg FROM ltr)",
        "ltf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM ltr) GROUP BY ALL)",
        "lidf AS MATERIALIZED (SELECT term, ln((1.0::DOUBLE + (SELECT n FROM ln_)) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM ltf GROUP BY term)",
        "lw AS MATERIALIZED (SELECT id, term, tf * idf / sqrt(sum(tf * idf * (tf * idf)) OVER (PARTITION BY id)) AS w FROM ltf JOIN lidf USING (term))",
        "lx_ AS MATERIALIZED (SELECT i, term, w FROM lw JOIN ltr USING (id))",
        "dots AS (SELECT p.i, q.i AS j, sum(p.w * q.w) AS v FROM lx_ p JOIN lx_ q USING (term) GROUP BY ALL)",
        "km AS MATERIALIZED (SELECT list(r ORDER BY i) AS kk FROM (SELECT p.i, list(coalesce(v, 0.0) ORDER BY q.i) AS r FROM ltr p CROSS JOIN ltr q LEFT JOIN dots d ON d.i = p.i AND d.j = q.i GROUP BY p.i))",
        f"outs AS (SELECT unnest({classes}) AS k)",
        f"ys AS MATERIALIZED (SELECT list(r ORDER BY k) AS y FROM (SELECT k, list({target}::DOUBLE ORDER BY i) AS r FROM ltr CROSS JOIN outs GROUP BY k))",
        "start AS (SELECT list_transform(y, lambda r: list_transform(r, lambda x: 0.0::DOUBLE)) AS a, list_transform(y, lambda r: 0.0::DOUBLE) AS b FROM ys)",
        # a, b: the point; v, u: the point that momentum leads to.
        "descent AS (SELECT 0 AS s, a, b, a AS v, b AS u FROM start UNION ALL "
        f"SELECT s + 1, na, nb, {mix('na', 'a', f'q[1] + {pull} * (q[1] - q[2])')}, {flat('nb', 'b', f'q[1] + {pull} * (q[1] - q[2])')} FROM ("
        f"SELECT s, a, b, reg, {mix('v', 'e', f'q[1] - {step} * (reg * q[1] + q[2] / n)')} AS na, {flat('u', 'e', f'q[1] - {step} * list_sum(q[2]) / n')} AS nb FROM ("
        + ("SELECT *, " + slopes.replace(" FROM (", " AS e FROM (", 1) if " FROM (" in slopes else "SELECT *, " + slopes + " AS e FROM mg").replace(
            "FROM mg", "FROM (SELECT f.*, y, reg, n, list_transform(list_zip(v, u), lambda o: list_transform(kk, lambda r: list_inner_product(r, o[1]) + o[2])) AS m "
            f"FROM descent f, km, ys, ln_ WHERE s < {CHECK_STEPS})", 1)
        + ")))",
        f"done AS MATERIALIZED (SELECT a, b FROM descent WHERE s = {CHECK_STEPS})",
        "pos AS (SELECT k, row_number() OVER (ORDER BY k) AS o FROM outs)",
        "cf AS MATERIALIZED (SELECT term, k, sum(w * a[o][i]) AS c FROM lx_, pos, done GROUP BY term, k)", "bs AS (SELECT k, b[o] AS b FROM pos, done)",
    )


def linear_scores_sql(source: str) -> tuple[str, ...]:
    """Scores of the rows ``source(id, ts)`` by ``cf`` and ``bs``."""
    return (
        f"ntf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM {source}) GROUP BY ALL)",
        "nkn AS (SELECT id, term, tf * idf AS x FROM ntf JOIN lidf USING (term))",
        "nsc AS (SELECT id, k, sum(x * c) AS s FROM nkn JOIN cf USING (term) GROUP BY ALL)",
        "nno AS (SELECT id, sqrt(sum(x * x)) AS norm FROM nkn GROUP BY id)",
        f"sco AS (SELECT r.id, o.k, round(coalesce(s / norm, 0.0) + o.b, 6) AS score FROM {source} r CROSS JOIN bs o "
        "LEFT JOIN nsc ON nsc.id = r.id AND nsc.k = o.k LEFT JOIN nno ON nno.id = r.id)",
    )


LR_SQL = (
    ART, *STRATIFIED_SQL, "lx AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT lang FROM art))",
    f"ltok AS MATERIALIZED (SELECT s.id, lx.code AS label, s.split, {sql_tokens('maintext', stop=True)} AS ts FROM strat s JOIN lx USING (lang))",
    *linear_sql("softmax", "split = 'train'", "(SELECT list(code) FROM lx)", "0.0001::DOUBLE"),
    "held AS (SELECT id, label, ts FROM ltok WHERE split = 'valid')", *linear_scores_sql("held"),
    "bst AS (SELECT id, k AS pred FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, k) AS r FROM sco) WHERE r = 1)",
)


@query("domain_classifier_train_lr", recursive(*LR_SQL,
       "SELECT id, label, pred, lx.lang AS pred_label FROM held JOIN bst USING (id) JOIN lx ON lx.code = bst.pred"))
def domain_classifier_train_lr(spark, sf):
    """Multinomial logistic regression on the same features; predictions of the held-out part."""
    # Tokens are made while the texts are dealt by their length; the staged rows are dealt by their bytes.
    rows = language_rows(spark, sf).withColumn("tokens", stopped_tokens()).drop("maintext")
    parts = stage(ordering.split_stratified(rows, "label"), "split")
    index = stage(labels.label_index(parts), "labels")
    coded = labels.encode_label(parts, index)
    train, valid = (coded.filter(F.col("split") == s) for s in ("train", "valid"))
    model = linear.fit_logistic(train, F.col("tokens"), index.count())
    scored = model.scores(valid, F.col("tokens")).select("id", linear.best_output(F.col("scores")).alias("pred"))
    found = valid.select("id", "label").join(scored, "id")
    return labels.decode_label(found, index, "pred", "pred_label").select("id", "label", "pred", "pred_label")


SVM_SQL = (
    "lab0 AS (SELECT d.doc_id AS id, d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id))",
    f"ltok AS MATERIALIZED (SELECT id, label, {sql_tokens('text', stop=True)} AS ts, CASE WHEN row_number() OVER (ORDER BY md5('0:' || id)) "
    "<= ceil(count(*) OVER () * 0.1) THEN 'valid' ELSE 'train' END AS split FROM lab0)",
    *linear_sql("hinge", "split = 'train'", "[0]", "1.0::DOUBLE / count(*)"),
)


@query("sentiment_svm_train", recursive(*SVM_SQL, "held AS (SELECT id, label, ts FROM ltok WHERE split = 'valid')", *linear_scores_sql("held"),
       "SELECT id, label, CAST(score >= 0 AS INTEGER) AS pred FROM held JOIN sco USING (id)"))
def sentiment_svm_train(spark, sf):
    """A linear SVM on the labelled texts: held-out labels and predictions; idf and model see the train part only."""
    _, scored = classify.train_sentiment(labelled(spark, sf), LATIN_NEGATORS, STOPWORDS)
    return scored.select("id", "label", "pred")


SOCIAL_SQL = (
    r"cln AS (SELECT conv_id, turn, replace(regexp_replace(regexp_replace(text, '\{%[^\n]+?%\}', ' ', 'g'), "
    r"'@[^\n]+?(?: |(\n?)\z)', ' \1', 'g'), chr(8203), ' ') AS text FROM conversations)",
    f"glu AS (SELECT conv_id, turn, regexp_replace(array_to_string({sql_words('text')}, ' '), "
    rf"'(^| )({'|'.join(LATIN_NEGATORS)}) ([^ ]+)', '\1\2\3', 'g') AS text FROM cln)",
    f"new AS (SELECT conv_id || '-' || turn AS id, conv_id, turn, {sql_tokens('text', stop=True)} AS ts FROM glu)",
)


@query("sentiment_svm_predict", recursive(*SVM_SQL, *SOCIAL_SQL, *linear_scores_sql("new"),
       "SELECT conv_id, turn, CAST(score >= 0 AS INTEGER) AS pred FROM new JOIN sco USING (id)"))
def sentiment_svm_predict(spark, sf):
    """New texts (conversation turns): social clean-up, negation gluing, vectors, SVM."""
    model, _ = classify.train_sentiment(labelled(spark, sf), LATIN_NEGATORS, STOPWORDS)
    turns = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", "text")
    return model.predict(turns).select("conv_id", "turn", "pred")


MEANS_SQL = (
    *TF,
    "lw AS (SELECT w.*, l.quality AS label FROM w JOIN labels l ON w.id = l.doc_id)",
    "nl AS (SELECT count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality = 0) AS neg FROM labels)",
    "coef AS (SELECT term, sum(CASE WHEN label = 1 THEN weight ELSE 0 END) / any_value(pos) "
    "- sum(CASE WHEN label = 0 THEN weight ELSE 0 END) / any_value(neg) AS c FROM lw, nl GROUP BY term)",
    "s AS (SELECT w.id, sum(w.weight * coalesce(coef.c, 0)) AS s FROM w LEFT JOIN coef USING (term) GROUP BY w.id)",
    "lin AS (SELECT d.doc_id AS id, round(coalesce(s, 0.0), 6) AS score, CAST(round(coalesce(s, 0.0), 6) >= 0 AS INTEGER) AS pred "
    "FROM documents d LEFT JOIN s ON s.id = d.doc_id)",
)


@query("sentiment_linear_score", with_(*MEANS_SQL, "SELECT id, score, pred FROM lin"))
def sentiment_linear_score(spark, sf):
    """A linear model as a coefficient table: difference of the mean vectors of both classes."""
    model = features.tfidf_model(docs(spark, sf), stopped_tokens())
    weights = stage(features.tfidf_transform(docs(spark, sf), stopped_tokens(), model), "weights")
    label = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    pos, neg = label.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    signed = F.when(F.col("label") == 1, F.col("weight") / pos).otherwise(-F.col("weight") / neg)
    coefficients = stage(
        weights.join(label, "id").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(signed).alias("coef")), "coef"
    )
    return classify.linear_scores(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), weights, coefficients)


@query("write_sentiment_predictions", with_(*MEANS_SQL,
       "names(pred, name) AS (VALUES " + ", ".join(f"({i}, '{n}')" for n, i in SENTIMENT_LABELS.items()) + ")",
       "SELECT 'test-' || (row_number() OVER (ORDER BY id) - 1) AS id, name AS source_domain FROM lin JOIN names USING (pred)"))
def write_sentiment_predictions(spark, sf):
    """Sentiment of every document as the label's text, in the file format of predictions, read back."""
    scored = stage(sentiment_linear_score(spark, sf), "sentiment-scores")
    named = labels.decode_label(scored, labels.label_table(spark, SENTIMENT_LABELS), "pred", "sentiment")
    path = staging_path(spark, "sentiment-predictions")
    writers.write_domain_predictions(named, "sentiment", path)
    return spark.read.schema("id string, source_domain string").option("header", True).csv(path)


# --- summaries ---------------------------------------------------------------


def candidates(spark, sf, by_article=False):
    """Scored sentences; ``by_article`` dealt for work on all sentences of an article.

    Rows that come from Python have no known placement, so that work moves them anyway, over as many tasks as the session's
    shuffle setting says. Dealt here, they go over as many as their texts need, and are not moved again.
    """
    tasks = text_tasks(spark, sf, "documents")
    articles_ = docs(spark, sf, tasks)
    model = features.tfidf_model(articles_, stopped_tokens())
    scored = summarize.score_sentences(articles_, model, STOPWORDS)
    return scored.repartition(tasks, "id") if by_article else scored


SUMMARY_SQL = (
    *CAND,
    f"best AS (SELECT id, string_agg(sentence, ' ' ORDER BY pos) AS summary FROM ranked WHERE rank <= {SUMMARY_SENTENCES} GROUP BY id)",
    "summ AS (SELECT doc_id AS id, coalesce(summary, '') AS summary FROM documents LEFT JOIN best ON best.id = doc_id)",
)


@query("score_sentences", with_(*CAND, "SELECT id, pos, sentence, score FROM cand"))
def score_sentences(spark, sf):
    return candidates(spark, sf)


@query("extractive_summary", with_(*SUMMARY_SQL, "SELECT id, summary FROM summ"))
def extractive_summary(spark, sf):
    return summarize.extractive_summary(candidates(spark, sf), SUMMARY_SENTENCES, articles=docs(spark, sf))


@query("lead_summary", f"SELECT doc_id AS id, array_to_string(({sql_sentences('text')})[1:{SUMMARY_SENTENCES}], ' ') AS summary FROM documents")
def lead_summary(spark, sf):
    return summarize.lead_summary(docs(spark, sf), SUMMARY_SENTENCES)


@query("select_greedy", with_(*CAND, "SELECT id, pos, sentence FROM ranked WHERE rank = 1"))
def select_greedy(spark, sf):
    return summarize.select_greedy(candidates(spark, sf)).select("id", "pos", "sentence")


@query("select_top_k", with_(*CAND, "SELECT id, pos, rank FROM ranked WHERE rank <= 30"))
def select_top_k(spark, sf):
    return summarize.select_top_k(candidates(spark, sf, by_article=True), 30).select("id", "pos", "rank")


SOFTMAX_SQL = (
    "ex AS (SELECT *, exp((score - max(score) OVER (PARTITION BY id)) / {t}) AS e FROM ranked)",
    "wt AS (SELECT *, e / sum(e) OVER (PARTITION BY id) AS weight FROM ex)",
)


def softmax_sql(t: float) -> tuple[str, ...]:
    return tuple(s.format(t=t) for s in SOFTMAX_SQL)


@query("temperature_weights", with_(*CAND, *softmax_sql(0.5), "SELECT id, pos, round(weight, 6) AS weight FROM wt"))
def temperature_weights(spark, sf):
    weighted = summarize.temperature_weights(candidates(spark, sf, by_article=True), 0.5)
    return weighted.select("id", "pos", F.round("weight", 6).alias("weight"))


@query("select_top_p", with_(*CAND, *softmax_sql(1.0),
       "cum AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM wt)",
       "SELECT id, pos, rank FROM cum WHERE before < 0.9"))
def select_top_p(spark, sf):
    return summarize.select_top_p(candidates(spark, sf, by_article=True), 0.9).select("id", "pos", "rank")


DRAW_SQL = "CAST(('0x' || substr(md5('42:' || {key}), 1, 8)) AS BIGINT) / 4294967296.0"


@query("sample_candidate", with_(*CAND, *softmax_sql(0.8),
       f"cu AS (SELECT *, sum(weight) OVER (PARTITION BY id ORDER BY rank) AS c, {DRAW_SQL.format(key='id')} AS u FROM wt)",
       "pk AS (SELECT *, least(sum(CASE WHEN c < u THEN 1 ELSE 0 END) OVER (PARTITION BY id) + 1, max(rank) OVER (PARTITION BY id)) AS pick FROM cu)",
       "SELECT id, pos, sentence FROM pk WHERE rank = pick"))
def sample_candidate(spark, sf):
    weighted = summarize.temperature_weights(candidates(spark, sf, by_article=True), 0.8)
    return summarize.sample_candidate(weighted).select("id", "pos", "sentence")


@query("block_repeat_ngrams", "WITH RECURSIVE " + with_(*CAND,
       r"sw AS (SELECT id, rank, regexp_extract_all(lower(sentence), '\p{L}+') AS ws FROM ranked)",
       "so AS (SELECT id, rank, generate_subscripts(ws, 1) AS i, unnest(ws) AS wd FROM sw)",
       "gr AS (SELECT id, rank, wd || ' ' || lead(wd) OVER (PARTITION BY id, rank ORDER BY i) AS gram FROM so)",
       "gl AS MATERIALIZED (SELECT r.id, r.rank, r.pos, coalesce(list(gram) FILTER (WHERE gram IS NOT NULL), []) AS g FROM ranked r LEFT JOIN gr USING (id, rank) GROUP BY ALL)",
       "fold AS (SELECT DISTINCT id, CAST(0 AS INTEGER) AS rank, CAST(NULL AS INTEGER) AS pos, CAST([] AS VARCHAR[]) AS seen, FALSE AS ok FROM gl UNION ALL "
       "SELECT id, rank, pos, CASE WHEN ok THEN list_concat(seen, g) ELSE seen END, ok FROM (SELECT gl.*, f.seen, "
       "len(list_distinct(g)) = len(g) AND NOT list_has_any(f.seen, g) AS ok FROM fold f JOIN gl ON gl.id = f.id AND gl.rank = f.rank + 1))",
       "SELECT id, pos, rank FROM fold WHERE ok")[5:])
def block_repeat_ngrams(spark, sf):
    return summarize.block_repeat_ngrams(candidates(spark, sf, by_article=True), 2).select("id", "pos", "rank")


# --- predictions against references, ROUGE -----------------------------------


def summary_pairs(spark, sf):
    """``(id, predictions, references)``: extractive summary against title, joined by id."""
    predictions = summarize.extractive_summary(candidates(spark, sf), SUMMARY_SENTENCES).withColumnRenamed("summary", "predictions")
    references = articles(spark, sf).select("id", F.col("title").alias("references"))
    return writers.zip_predictions(predictions, references)


def token_pairs(spark, sf):
    """The same pairs as token arrays."""
    return summary_pairs(spark, sf).select(
        "id", X.pattern_tokens(F.col("predictions")).alias("pred_tokens"), X.pattern_tokens(F.col("references")).alias("ref_tokens")
    )


PAIR_SQL = (
    ART,
    *SUMMARY_SQL,
    "pair AS (SELECT art.id, summary AS predictions, title AS refs FROM art JOIN summ USING (id))",
    f"ptok AS (SELECT id, {sql_tokens('predictions')} AS p, {sql_tokens('refs')} AS r FROM pair)",
    "po AS (SELECT id, generate_subscripts(p, 1) AS i, unnest(p) AS t FROM ptok)",
    "ro AS (SELECT id, generate_subscripts(r, 1) AS i, unnest(r) AS t FROM ptok)",
    "pg AS (SELECT id, 1 AS n, t AS g FROM po UNION ALL SELECT id, 2, t || ' ' || lead(t) OVER (PARTITION BY id ORDER BY i) FROM po)",
    "rg AS (SELECT id, 1 AS n, t AS g FROM ro UNION ALL SELECT id, 2, t || ' ' || lead(t) OVER (PARTITION BY id ORDER BY i) FROM ro)",
    "pc AS (SELECT id, n, g, count(*) AS c FROM pg WHERE g IS NOT NULL GROUP BY ALL)",
    "rc AS (SELECT id, n, g, count(*) AS c FROM rg WHERE g IS NOT NULL GROUP BY ALL)",
    "base AS (SELECT id, n FROM pair, (VALUES (1), (2)) v(n))",
    "ov AS (SELECT pc.id, pc.n, count(*) AS o, sum(least(pc.c, rc.c)) AS oc FROM pc JOIN rc ON pc.id = rc.id AND pc.n = rc.n AND pc.g = rc.g GROUP BY ALL)",
    "ps AS (SELECT id, n, count(*) AS k, sum(c) AS kc FROM pc GROUP BY ALL)",
    "rs AS (SELECT id, n, count(*) AS k, sum(c) AS kc FROM rc GROUP BY ALL)",
    "pr AS (SELECT b.id, b.n, CASE WHEN ps.k IS NULL THEN 0.0 ELSE coalesce(o, 0) / ps.k END AS p, "
    "CASE WHEN rs.k IS NULL THEN 0.0 ELSE coalesce(o, 0) / rs.k END AS r, "
    "CASE WHEN ps.k IS NULL THEN 0.0 ELSE coalesce(oc, 0) / ps.kc END AS cp, CASE WHEN rs.k IS NULL THEN 0.0 ELSE coalesce(oc, 0) / rs.kc END AS cr "
    "FROM base b LEFT JOIN ov ON ov.id = b.id AND ov.n = b.n LEFT JOIN ps ON ps.id = b.id AND ps.n = b.n LEFT JOIN rs ON rs.id = b.id AND rs.n = b.n)",
    "fs AS (SELECT *, 2.0 * p * r / (p + r + 1e-8) AS f, 2.0 * cp * cr / (cp + cr + 1e-8) AS cf FROM pr)",
)


def rounded(df, *keep):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


@query("zip_predictions", with_(*PAIR_SQL[:len(SUMMARY_SQL) + 2], 'SELECT id, predictions, refs AS "references" FROM pair'))
def zip_predictions(spark, sf):
    return summary_pairs(spark, sf)


@query("write_eval_predictions", with_(*PAIR_SQL[:len(SUMMARY_SQL) + 2], 'SELECT id, predictions, refs AS "references" FROM pair'))
def write_eval_predictions(spark, sf):
    predictions = summarize.extractive_summary(candidates(spark, sf), SUMMARY_SENTENCES).withColumnRenamed("summary", "predictions")
    references = articles(spark, sf).select("id", F.col("title").alias("references"))
    path = staging_path(spark, "eval-predictions")
    writers.write_eval_predictions(predictions, references, path)
    return (
        spark.read.schema("id bigint, predictions string, references string")
        .option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    )


ROUGE_N_SQL = ", ".join(
    f"round(max(CASE WHEN n = {n} THEN {c} END), 6) AS rouge{n}_{c}" for n in (1, 2) for c in ("p", "r", "f")
)
CLIPPED_SQL = ", ".join(
    f"round(max(CASE WHEN n = {n} THEN c{c} END), 6) AS clipped{n}_{c}" for n in (1, 2) for c in ("p", "r", "f")
)


@query("rouge_n", with_(*PAIR_SQL, f"SELECT id, {ROUGE_N_SQL} FROM fs GROUP BY id"))
def rouge_n(spark, sf):
    scored = rouge.rouge_n(rouge.rouge_n(token_pairs(spark, sf), 1), 2)
    return rounded(scored.drop("pred_tokens", "ref_tokens"), "id")


@query("rouge_clipped", with_(*PAIR_SQL, f"SELECT id, {CLIPPED_SQL} FROM fs GROUP BY id"))
def rouge_clipped(spark, sf):
    pairs = token_pairs(spark, sf)
    # A row per article on both sides: they grow alike, so neither is broadcast.
    return rounded(rouge.rouge_clipped(pairs, 1).join(rouge.rouge_clipped(pairs, 2).hint("merge"), "id"), "id")


LCS_SQL = (
    # Equal texts are their own common subsequence; tokens found on one side only are never part of one.
    "differ AS (SELECT id FROM ptok WHERE p <> r)",
    "pk AS MATERIALIZED (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY i) AS i FROM po SEMI JOIN differ USING (id) "
    "SEMI JOIN ro USING (id, t))",
    # One row of the LCS table per step: the prefix maximum over the reference positions.
    "walk AS (SELECT id, CAST(0 AS BIGINT) AS step, i, t, CAST(0 AS BIGINT) AS v FROM ro SEMI JOIN differ USING (id) SEMI JOIN po USING (id, t) "
    "UNION ALL SELECT w.id, w.step + 1, w.i, w.t, max(greatest(w.v, CASE WHEN w.t = pk.t THEN w.d + 1 ELSE 0 END)) "
    "OVER (PARTITION BY w.id ORDER BY w.i) FROM (SELECT id, step, i, t, v, coalesce(lag(v) OVER (PARTITION BY id ORDER BY i), 0) AS d FROM walk) w "
    "JOIN pk ON pk.id = w.id AND pk.i = w.step + 1)",
    "lcs AS (SELECT id, max(v) AS l FROM walk GROUP BY id UNION ALL SELECT id, len(p) FROM ptok WHERE p = r)",
    "lp AS (SELECT t.id, CASE WHEN len(p) = 0 THEN 0.0 ELSE coalesce(l, 0) / len(p) END AS p, "
    "CASE WHEN len(r) = 0 THEN 0.0 ELSE coalesce(l, 0) / len(r) END AS r FROM ptok t LEFT JOIN lcs USING (id))",
    "lf AS (SELECT *, 2.0 * p * r / (p + r + 1e-8) AS f FROM lp)",
)


@query("rouge_corpus", "WITH RECURSIVE " + with_(*PAIR_SQL, *LCS_SQL,
       "kept AS (SELECT id FROM ptok WHERE len(p) > 0 AND len(r) > 0)",
       "SELECT " + ", ".join(f'round(avg(CASE WHEN n = {n} THEN f END) * 100, 4) AS "rouge-{n}", '
                             f'round(avg(CASE WHEN n = {n} THEN f END) FILTER (WHERE id IN (SELECT id FROM kept)) * 100, 4) '
                             f'AS "rouge-{n}-kept"' for n in (1, 2))
       + ', (SELECT round(avg(f) * 100, 4) FROM lf) AS "rouge-l", (SELECT round(avg(f) * 100, 4) FROM lf WHERE id IN (SELECT id FROM kept)) AS "rouge-l-kept" FROM fs')[5:])
def rouge_corpus(spark, sf):
    """Corpus scores over all pairs, and without empty pairs, in one pass."""
    scored = rouge.rouge_l(rouge.rouge_n(rouge.rouge_n(token_pairs(spark, sf), 1), 2))
    names = {"rouge-1": "rouge1_f", "rouge-2": "rouge2_f", "rouge-l": "rougel_f"}
    return scored.agg(
        *rouge.corpus_means(names), *rouge.corpus_means({f"{k}-kept": v for k, v in names.items()}, rouge.not_empty()),
    )


@query("rouge_l", "WITH RECURSIVE " + with_(*PAIR_SQL, *LCS_SQL, "SELECT id, round(p, 6) AS rougel_p, round(r, 6) AS rougel_r, round(f, 6) AS rougel_f FROM lf")[5:])
def rouge_l(spark, sf):
    scored = rouge.rouge_l(token_pairs(spark, sf))
    return rounded(scored.drop("pred_tokens", "ref_tokens"), "id")


@query("rouge_l_union")
def rouge_l_union(spark, sf):
    """Summaries against titles, sentence by sentence; the words of all common subsequences are united."""
    words = lambda c: F.transform(X.sentences(F.col(c)), lambda s: X.pattern_tokens(s))
    pairs = summary_pairs(spark, sf).select("id", words("predictions").alias("pred_sentences"), words("references").alias("ref_sentences"))
    return rounded(rouge.rouge_l_union(pairs).drop("pred_sentences", "ref_sentences"), "id")


RUN_SQL = (
    "runs(run, t, k, p) AS (VALUES " + ", ".join(
        f"('{n}', {t}, {k if k is not None else 'NULL'}, {p if p is not None else 'NULL'})" for n, t, k, p in RUNS) + ")",
    "rx AS (SELECT r.*, runs.run, runs.t, runs.k, runs.p FROM ranked r, runs WHERE runs.k IS NULL OR r.rank <= runs.k)",
    "re AS (SELECT *, exp((score - max(score) OVER (PARTITION BY id, run)) / t) AS e FROM rx)",
    "rw AS (SELECT *, e / sum(e) OVER (PARTITION BY id, run) AS weight FROM re)",
    "rb AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY id, run ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rw)",
    "rn AS (SELECT * FROM rb WHERE p IS NULL OR before < p)",
    f"rk AS (SELECT *, sum(weight) OVER (PARTITION BY id, run ORDER BY rank) / sum(weight) OVER (PARTITION BY id, run) AS c, "
    f"{DRAW_SQL.format(key=chr(39).join(['run || ', ':', ' || id']))} AS u FROM rn)",
    "rp AS (SELECT *, least(sum(CASE WHEN c < u THEN 1 ELSE 0 END) OVER (PARTITION BY id, run) + 1, max(rank) OVER (PARTITION BY id, run)) AS pick FROM rk)",
    "chosen AS (SELECT id, run, sentence FROM rp WHERE rank = pick)",
)


@query("compare_runs", recursive(ART, *CAND, *RUN_SQL,
       f"ctok AS MATERIALIZED (SELECT c.run, c.id, {sql_tokens('sentence')} AS p1, {sql_tokens('title')} AS r1 FROM chosen c JOIN art USING (id))",
       "ct AS (SELECT run, id, list_distinct(p1) AS p1, list_distinct(r1) AS r1, "
       "list_distinct(list_transform(range(1, len(p1)), lambda i: p1[i] || ' ' || p1[i + 1])) AS p2, "
       "list_distinct(list_transform(range(1, len(r1)), lambda i: r1[i] || ' ' || r1[i + 1])) AS r2 FROM ctok)",
       "cs AS (SELECT run, " + ", ".join(
           f"CASE WHEN len(p{n}) = 0 THEN 0.0 ELSE len(list_intersect(p{n}, r{n})) / len(p{n}) END AS a{n}, "
           f"CASE WHEN len(r{n}) = 0 THEN 0.0 ELSE len(list_intersect(p{n}, r{n})) / len(r{n}) END AS b{n}" for n in (1, 2)) + " FROM ct)",
       "ptok AS MATERIALIZED (SELECT run || ':' || id AS id, p1 AS p, r1 AS r FROM ctok)",
       "po AS (SELECT id, generate_subscripts(p, 1) AS i, unnest(p) AS t FROM ptok)", "ro AS (SELECT id, generate_subscripts(r, 1) AS i, unnest(r) AS t FROM ptok)",
       *LCS_SQL,
       "ll AS (SELECT split_part(id, ':', 1) AS run, round(avg(f) * 100, 4) AS rougel_f FROM lf GROUP BY 1)",
       "cm AS (SELECT run, " + ", ".join(f"round(avg(2.0 * a{n} * b{n} / (a{n} + b{n} + 1e-8)) * 100, 4) AS rouge{n}_f" for n in (1, 2))
       + ", count(*) AS n FROM cs GROUP BY run)",
       "SELECT run, rouge1_f, rouge2_f, rougel_f, n, CAST(row_number() OVER (ORDER BY rouge1_f DESC, run) AS INTEGER) AS rank FROM cm JOIN ll USING (run)"))
def compare_runs(spark, sf):
    """ROUGE-1, ROUGE-2 and ROUGE-L of one sentence per article under every decoding setting, against the title."""
    chosen = summarize.decoding_runs(candidates(spark, sf, by_article=True), RUNS)
    titles = articles(spark, sf).select("id", X.pattern_tokens(F.col("title")).alias("ref_tokens"))
    pairs = chosen.select("id", "run", X.pattern_tokens(F.col("sentence")).alias("pred_tokens")).join(titles.hint("merge"), "id")
    scored = rouge.rouge_l(rouge.rouge_n(rouge.rouge_n(pairs, 1), 2))
    return metrics.compare_runs(scored, "run", ["rouge1_f", "rouge2_f", "rougel_f"])
