"""End-to-end jobs over files: raw drops in, split and encoded tables or predictions out.

Every output is a folder of part files. Each stage that is read more than once is
written to the shared folder first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions import text as X
from newsflow.operators import classify, cleaning, crawl, features, labels, metrics, ordering, rouge, summarize
from newsflow.schemas import DOMAIN_LABELS, NEGATORS, ROUTING_KEYWORDS
from newsflow.session import job, stage
from newsflow.sources import readers, writers


@job
def crawl_articles(pages: DataFrame, links: DataFrame, category: Column, out: str) -> None:
    """From stored pages ``(page_id, url, html)`` and resolved links to article files.

    Writes ``articles``, one folder per category, of the pages that some link leads to, ``rejected`` with the reason of each bad page, and
    ``to_fetch``, the addresses that no stored page covers.
    """
    reached = crawl.link_page_join(links, pages).filter("target_id IS NOT NULL").select(F.col("target_id").alias("page_id")).distinct()
    marked = stage(crawl.mark_bad_pages(pages.join(reached, "page_id", "left_semi")), "marked-pages")
    writers.write_by_category(crawl.assemble_articles(marked.filter("reason IS NULL"), category), f"{out}/articles")
    marked.filter("reason IS NOT NULL").select("page_id", "url", "reason").write.parquet(f"{out}/rejected")
    crawl.links_to_fetch(links, pages).write.parquet(f"{out}/to_fetch")


def load_articles(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Article files in the listed order, numbered over all rows in file then row order."""
    union = None
    for number, path in enumerate(paths):
        part = readers.scan_json_array(spark, path, positions=True).withColumn("_file_no", F.lit(number))
        union = part if union is None else union.unionByName(part)
    if union is None:
        raise ValueError("no article files")
    return ordering.number_in_file_order(stage(union.drop("id"), "articles"))


@job
def prepare_summary_data(
    spark: SparkSession,
    paths: Sequence[str],
    out: str,
    keywords: Sequence[str] = ROUTING_KEYWORDS,
    seed: int = 42,
    drop_last: bool = False,
) -> DataFrame:
    """Route by title, split 80/10/10, write ``train``, ``valid``, ``test`` and ``no_title``; returns the counts.

    Rows routed away are written as well instead of being lost.
    """
    routed = stage(cleaning.route_by_title(load_articles(spark, paths), keywords), "routed")
    clean = routed.filter(F.col("route") == "clean").drop("route")
    rest = routed.filter(F.col("route") == "no_title").drop("route").withColumn("split", F.lit("no_title"))
    parts = stage(ordering.split_fractions(clean, seed=seed, drop_last=drop_last).unionByName(rest), "summary-splits")
    return _write_parts(parts, out, ("train", "valid", "test", "no_title"))


@job
def prepare_domain_data(
    spark: SparkSession,
    paths: Sequence[str],
    out: str,
    label_map: Mapping[str, int] = DOMAIN_LABELS,
    seed: int = 42,
    test_size: float = 0.1,
) -> DataFrame:
    """Clean, split by class, rename, encode labels, renumber; writes ``train`` and ``valid``."""
    clean = stage(cleaning.clean_for_domain(load_articles(spark, paths), tuple(label_map)), "clean")
    parts = stage(ordering.split_stratified(clean, "source_domain", seed=seed, test_size=test_size), "domain-splits")
    table = labels.label_table(spark, label_map)
    encoded = None
    for name in ("train", "valid"):
        rows = cleaning.rename_for_classifier(parts.filter(F.col("split") == name))
        part = cleaning.drop_metadata(labels.encode_label(rows, table))
        encoded = part if encoded is None else encoded.unionByName(part)
    return _write_parts(stage(encoded, "domain-encoded"), out, ("train", "valid"))


@job
def prepare_sentiment_data(
    spark: SparkSession, raw: str, out: str, seed: int = 42, test_size: float = 0.1
) -> DataFrame:
    """Labelled lines to rows, split by class; writes ``train`` and ``valid``."""
    lines = stage(readers.file_positions(spark.read.text(raw)), "lines")
    rows = ordering.number_in_file_order(stage(readers.parse_labelled_lines(lines), "labelled"))
    kept = stage(cleaning.keep_text_rows(rows), "sentences")
    parts = stage(ordering.split_stratified(kept, "label", seed=seed, test_size=test_size), "sentiment-splits")
    return _write_parts(parts, out, ("train", "valid"))


def run_sentiment_baseline(
    spark: SparkSession, csv: str, stopwords: Sequence[str] = (), negators: tuple[str, ...] = NEGATORS, **options
) -> tuple[classify.SentimentModel, DataFrame]:
    """Linear SVM on a ``text,label`` CSV; returns the model and the hold-out report."""
    schema = "text string, label int"
    rows = stage(readers.file_positions(readers.scan_csv_labelled(spark, csv, schema)), "sentiment-rows")
    numbered = stage(ordering.number_in_file_order(cleaning.drop_incomplete(rows)), "sentiment-numbered")
    model, scored = classify.train_sentiment(numbered, negators, tuple(stopwords), **options)
    return model, metrics.classification_report(scored, classes=[0, 1])


@job
def run_domain_classifier(
    train: DataFrame,
    valid: DataFrame,
    test: DataFrame,
    out: str,
    label_map: Mapping[str, int] = DOMAIN_LABELS,
    stopwords: Sequence[str] = (),
    max_eval_samples: int | None = None,
) -> DataFrame:
    """Train on ``(id, sentence, label)``, score ``valid``, write ``id,source_domain`` for ``test``.

    Returns one row of evaluation metrics.
    """
    tokens = features.svm_tokens(F.col("sentence"), stopwords)
    model = classify.train_naive_bayes(train, tokens)
    held_out = stage(ordering.head(valid, max_eval_samples), "held-out")
    scored = held_out.select("id", "label").join(classify.predict_naive_bayes(held_out, tokens, model), "id")
    predicted = stage(classify.predict_naive_bayes(cleaning.drop_label(test), tokens, model), "predicted")
    named = labels.decode_label(predicted, labels.label_table(test.sparkSession, label_map), "pred", "domain")
    writers.write_domain_predictions(named, "domain", f"{out}/predictions")
    return scored.agg(
        metrics.accuracy().alias("accuracy"), metrics.capped_sample_count(max_eval_samples).alias("eval_samples")
    )


@job
def summarize_articles(
    articles: DataFrame,
    out: str,
    stopwords: Sequence[str] = (),
    sentences: int = 1,
    block_ngrams: int | None = 2,
) -> DataFrame:
    """Title-like summaries of ``(id, maintext, title)``: writes ``{title, id}`` lines and id-paired CSV.

    Returns one row of corpus ROUGE against the given titles.
    """
    tokens = features.svm_tokens(F.col("maintext"), stopwords)
    model = features.tfidf_model(articles, tokens)
    candidates = stage(summarize.score_sentences(articles, model, stopwords), "candidates")
    if block_ngrams:
        candidates = summarize.block_repeat_ngrams(candidates, block_ngrams).drop("rank")
    best = summarize.extractive_summary(candidates, sentences)
    # An article without a sentence keeps an empty summary.
    summaries = stage(
        articles.select("id", "title").join(best, "id", "left").select(
            "id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("title", F.lit("")).alias("title")
        ),
        "summaries",
    )
    predictions = summaries.select("id", X.one_sentence_per_line(F.col("summary")).alias("predictions"))
    references = summaries.select("id", X.one_sentence_per_line(F.col("title")).alias("references"))
    writers.write_title_jsonl(summaries.select("id", F.col("summary").alias("title")), f"{out}/titles")
    writers.write_eval_predictions(predictions, references, f"{out}/predictions")
    scored = rouge.rouge_l(rouge.rouge_n(rouge.rouge_n(summaries.select(
        "id", X.words(F.col("summary")).alias("pred_tokens"), X.words(F.col("title")).alias("ref_tokens")
    ), 1), 2))
    result = rouge.rouge_corpus(scored, {"rouge-1": "rouge1_f", "rouge-2": "rouge2_f", "rouge-l": "rougel_f"})
    return stage(result, "rouge-corpus")


def _write_parts(parts: DataFrame, out: str, names: Sequence[str]) -> DataFrame:
    for name in names:
        writers.write_json_records(parts.filter(F.col("split") == name).drop("split"), f"{out}/{name}")
    return labels.label_distribution(parts, "split")
