"""Queries: labels, class scores, metrics, prediction files."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.functions import arrays as A
from newsflow.operators import batch, cleaning, labels, metrics
from newsflow.plans.registry import query
from newsflow.plans.tables import ART, LOGITS, PREDICTED, articles, logits, table, with_
from newsflow.schemas import DOMAIN_LABELS
from newsflow.session import stage, staging_path
from newsflow.sources import writers

DOMAIN_SQL = "dom(label_text, label_id) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in DOMAIN_LABELS.items()) + ")"
CELLS_SQL = (
    "classes AS (SELECT DISTINCT label AS class FROM pred UNION SELECT DISTINCT pred FROM pred)",
    "per AS (SELECT class, (SELECT count(*) FROM pred WHERE label = class AND pred = class) AS hits, "
    "(SELECT count(*) FROM pred WHERE pred = class) AS predicted, "
    "(SELECT count(*) FROM pred WHERE label = class) AS support FROM classes)",
    "pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE hits / predicted END AS p, "
    "CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS r FROM per)",
    "sc AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM pr)",
)


def predicted(spark, sf):
    """``(id, label, pred)`` by argmax over the class scores."""
    return logits(spark, sf).select("id", "label", A.argmax(F.col("scores")).alias("pred"))


# --- labels ------------------------------------------------------------------


@query("label_distribution", with_(ART, "SELECT source_domain, lang, count(*) AS n FROM art WHERE maintext <> '' GROUP BY 1, 2"))
def label_distribution(spark, sf):
    kept = articles(spark, sf).filter(F.col("maintext") != "")
    return labels.label_distribution(kept, "source_domain", "lang")


@query("distinct_labels", with_(ART, "s AS (SELECT DISTINCT source_domain FROM art)",
       "SELECT source_domain AS label_text, CAST(row_number() OVER (ORDER BY source_domain) - 1 AS INTEGER) AS label_id, "
       "count(*) OVER () AS num_labels FROM s"))
def distinct_labels(spark, sf):
    index = stage(labels.label_index(articles(spark, sf), label="source_domain"), "labels")
    return index.withColumn("num_labels", F.lit(index.count()).cast("bigint"))


@query("build_label_index", with_("u AS (SELECT lang AS l FROM documents UNION SELECT role FROM conversations)",
       "SELECT l AS label_text, CAST(row_number() OVER (ORDER BY l) - 1 AS INTEGER) AS label_id FROM u"))
def build_label_index(spark, sf):
    """One index over the labels of two parts."""
    first = table(spark, sf, "documents").select(F.col("lang").alias("label"))
    second = table(spark, sf, "conversations").select(F.col("role").alias("label"))
    return labels.label_index(first, second)


@query("encode_label", with_(ART, "s AS (SELECT source_domain, CAST(row_number() OVER (ORDER BY source_domain) - 1 AS INTEGER) AS label "
       "FROM (SELECT DISTINCT source_domain FROM art))", "SELECT id, title, label FROM art JOIN s USING (source_domain)"))
def encode_label(spark, sf):
    rows = cleaning.rename_for_classifier(articles(spark, sf)).select("id", "title", "label")
    index = stage(labels.label_index(rows), "labels")
    return labels.encode_label(rows, index)


@query("encode_label_quarantine", with_(ART, "SELECT id, source_domain AS label, 'unknown label' AS reason FROM art "
       "WHERE source_domain NOT IN ('src0', 'src1', 'src2', 'src3', 'src4')"))
def encode_label_quarantine(spark, sf):
    """Rows whose label is outside the map, kept apart with the reason."""
    rows = cleaning.rename_for_classifier(articles(spark, sf)).select("id", "label", F.col("label").alias("raw"))
    known = labels.label_table(spark, {f"src{i}": i for i in range(5)})
    coded = labels.encode_label(rows, known, unknown="null")
    return coded.filter(F.col("label").isNull()).select("id", F.col("raw").alias("label"), F.lit("unknown label").alias("reason"))


@query("decode_label", with_(DOMAIN_SQL, "SELECT vec_id AS id, label_text AS source_domain FROM embeddings JOIN dom ON label = label_id"))
def decode_label(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return labels.decode_label(rows, labels.label_table(spark, DOMAIN_LABELS), "label", "source_domain").drop("label")


# --- class scores ------------------------------------------------------------


@query("argmax", with_(LOGITS, PREDICTED, "SELECT id, pred FROM pred"))
def argmax(spark, sf):
    return predicted(spark, sf).select("id", "pred")


@query("format_row_id", "SELECT 'test-' || vec_id AS id, label FROM embeddings")
def format_row_id(spark, sf):
    return table(spark, sf, "embeddings").select(writers.format_row_id("vec_id").alias("id"), "label")


@query("write_domain_predictions", with_(LOGITS, PREDICTED, DOMAIN_SQL,
       "SELECT 'test-' || (row_number() OVER (ORDER BY id) - 1) AS id, label_text AS source_domain FROM pred JOIN dom ON pred = label_id"))
def write_domain_predictions(spark, sf):
    named = labels.decode_label(predicted(spark, sf), labels.label_table(spark, DOMAIN_LABELS), "pred", "domain")
    path = staging_path(spark, "domain-predictions")
    writers.write_domain_predictions(named, "domain", path)
    return spark.read.schema("id string, source_domain string").option("header", True).csv(path)


# --- metrics -----------------------------------------------------------------


@query("accuracy", with_(LOGITS, PREDICTED, "SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred"))
def accuracy(spark, sf):
    return predicted(spark, sf).agg(F.round(metrics.accuracy(), 6).alias("accuracy"))


@query("mse", with_(LOGITS, "SELECT round(avg((p - label) * (p - label)), 6) AS mse FROM "
       "(SELECT label, " + " + ".join(f"scores[{k}]" for k in range(1, 11)) + " AS p FROM logit)"))
def mse(spark, sf):
    rows = logits(spark, sf).select(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("pred"), "label")
    return rows.agg(F.round(metrics.mse(), 6).alias("mse"))


@query("combined_score", with_(LOGITS, PREDICTED, *CELLS_SQL,
       "m AS (SELECT (SELECT avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) FROM pred) AS accuracy, avg(f) AS f1 FROM sc)",
       "SELECT round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round((accuracy + f1) / 2, 6) AS combined_score FROM m"))
def combined_score(spark, sf):
    """Accuracy and macro F1 from one confusion table, and their mean."""
    per_class = metrics.class_scores(predicted(spark, sf))
    scores = per_class.agg((F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1"))
    both = metrics.combined_score(scores, ["accuracy", "f1"])
    return both.select(*[F.round(c, 6).alias(c) for c in both.columns])


@query("classification_report", with_(LOGITS, PREDICTED, *CELLS_SQL,
       "rep AS (SELECT CAST(class AS VARCHAR) AS class, p, r, f, support FROM sc "
       "UNION ALL SELECT 'micro avg', sum(hits) / sum(predicted), sum(hits) / sum(support), "
       "CASE WHEN sum(hits) = 0 THEN 0.0 ELSE 2 * (sum(hits) / sum(predicted)) * (sum(hits) / sum(support)) "
       "/ (sum(hits) / sum(predicted) + sum(hits) / sum(support)) END, sum(support) FROM sc "
       "UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM sc "
       "UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), "
       "sum(f * support) / sum(support), sum(support) FROM sc)",
       "SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep"))
def classification_report(spark, sf):
    report = metrics.classification_report(predicted(spark, sf))
    return report.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("confusion_matrix", with_(LOGITS, PREDICTED, "SELECT label, " + ", ".join(
       f"count(*) FILTER (WHERE pred = {c}) AS pred_{c}" for c in range(10)) + ", count(*) FILTER (WHERE pred NOT BETWEEN 0 AND 9) AS pred_other FROM pred GROUP BY label"))
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(predicted(spark, sf), range(10))


@query("metrics_by_slice", with_(LOGITS, PREDICTED,
       "sl AS (SELECT CASE WHEN id % 2 = 0 THEN 'matched' ELSE 'mismatched' END AS slice, "
       "avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS samples FROM pred GROUP BY 1)",
       "SELECT round(max(CASE WHEN slice = 'matched' THEN accuracy END), 6) AS accuracy, "
       "max(CASE WHEN slice = 'matched' THEN samples END) AS samples, "
       "round(max(CASE WHEN slice = 'mismatched' THEN accuracy END), 6) AS accuracy_mm, "
       "max(CASE WHEN slice = 'mismatched' THEN samples END) AS samples_mm FROM sl"))
def metrics_by_slice(spark, sf):
    """Two evaluation sets in one table: matched and mismatched rows by parity."""
    rows = predicted(spark, sf).withColumn("slice", F.when(F.col("id") % 2 == 0, "matched").otherwise("mismatched"))
    return metrics.metrics_by_slice(rows, "slice", "matched", "mismatched", [
        F.round(metrics.accuracy(), 6).alias("accuracy"), F.count(F.lit(1)).alias("samples"),
    ])


@query("round_scores", with_(LOGITS, PREDICTED,
       "SELECT label, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) * 100, 4) AS score FROM pred GROUP BY label"))
def round_scores(spark, sf):
    return predicted(spark, sf).groupBy("label").agg(metrics.round_scores(metrics.accuracy()).alias("score"))


@query("write_metrics", with_(LOGITS, PREDICTED,
       "SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS eval_accuracy, count(*) AS eval_samples FROM pred"))
def write_metrics(spark, sf):
    path = staging_path(spark, "metrics")
    row = predicted(spark, sf).agg(F.round(metrics.accuracy(), 6).alias("accuracy"), F.count(F.lit(1)).alias("samples"))
    writers.write_metrics(row, path, prefix="eval_")
    return spark.read.schema("eval_accuracy double, eval_samples bigint").json(path)


@query("metric_callback", with_(LOGITS, PREDICTED,
       "SELECT 'accuracy' AS metric, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS value FROM pred "
       "UNION ALL SELECT 'mse', round(avg(pow(CAST(pred AS DOUBLE) - label, 2)), 6) FROM pred"))
def metric_callback(spark, sf):
    def both(rows):
        row = rows.agg(F.round(metrics.accuracy(), 6).alias("accuracy"), F.round(metrics.mse(), 6).alias("mse"))
        return metrics.long_metrics(row, ["accuracy", "mse"])

    return batch.metric_callback(predicted(spark, sf), both)


# --- user functions ----------------------------------------------------------


@query("map_batches", "SELECT doc_id AS id, length(text) AS chars FROM documents")
def map_batches(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")

    def lengths(pdf):
        return pdf.assign(chars=pdf["text"].str.len())[["id", "chars"]]

    return batch.map_batches(docs, lengths, "id bigint, chars bigint")


@query("batch_inference", "SELECT doc_id AS id, CASE WHEN length(text) - length(replace(text, ' ', '')) >= 200 THEN 'long' "
       "ELSE 'short' END AS pred FROM documents")
def batch_inference(spark, sf):
    """A toy model (blank count against a threshold), loaded once per task."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")

    def load():
        threshold, names = 200, {True: "long", False: "short"}
        return lambda pdf: pdf.assign(pred=(pdf["text"].str.count(" ") >= threshold).map(names))[["id", "pred"]]

    return batch.batch_inference(docs, load, "id bigint, pred string")
