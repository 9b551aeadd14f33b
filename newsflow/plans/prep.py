"""Queries: sources, cleaning, routing, numbering, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.functions import html as H
from newsflow.functions import text as X
from newsflow.operators import cleaning, labels, metrics, ordering
from newsflow.plans.registry import query
from newsflow.plans.tables import (
    ALLOWED_SOURCES, ART, LABELLED, LATIN_KEYWORDS, LOGITS, SQL_MAINTEXT, SQL_TITLE, articles, in_list, labelled, logits,
    sql_tokens, table, with_,
)
from newsflow.schemas import ARTICLE
from newsflow.session import stage, staging_path
from newsflow.sources import json_arrays, readers, writers
from newsflow.streaming import ingest


def six_fields(spark, sf):
    """Articles with exactly the fields of a crawl record."""
    return articles(spark, sf, dealt=True).select(
        F.lit("").alias("date_publish"), F.col("id").cast("string").alias("id"), "maintext", "source_domain",
        F.concat(F.lit("https://news.example.org/"), F.col("id").cast("string")).alias("url"), "title",
    )


SIX_SQL = (
    "six AS (SELECT '' AS date_publish, CAST(id AS VARCHAR) AS id, maintext, source_domain, "
    "'https://news.example.org/' || id AS url, title FROM art)"
)
SPLIT_SQL = (
    "hashed AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id)) AS rn, count(*) OVER () AS n FROM art)",
    "parts AS (SELECT *, CASE WHEN rn <= floor(n * 0.8) THEN 'train' "
    "WHEN rn <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM hashed)",
)
STRATIFIED_SQL = (
    "sizes AS (SELECT lang, count(*) AS n FROM art GROUP BY lang)",
    "tot AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) - ceil(sum(n) * 0.1) AS BIGINT) AS train FROM sizes)",
    "shares AS (SELECT lang, n, (n * train) // total AS base, (n * train) % total AS rem, train FROM sizes, tot)",
    "quota AS (SELECT lang, n - base - CASE WHEN row_number() OVER (ORDER BY rem DESC, lang) "
    "<= train - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM shares)",
    "strat AS (SELECT art.*, CASE WHEN row_number() OVER (PARTITION BY art.lang ORDER BY md5('42:' || id)) <= k "
    "THEN 'valid' ELSE 'train' END AS split FROM art JOIN quota ON art.lang = quota.lang)",
)


# --- sources -----------------------------------------------------------------


@query("scan_json_array", with_(ART, SIX_SQL, "SELECT * FROM six"))
def scan_json_array(spark, sf):
    path = staging_path(spark, "json-arrays")
    json_arrays.write_json_array(six_fields(spark, sf), path)
    return readers.scan_json_array(spark, path).select(*ARTICLE.fieldNames())


@query(
    "union_sources",
    with_(
        ART,
        "u AS (SELECT 'documents' AS origin, 0 AS origin_no, CAST(id AS VARCHAR) AS id, title, maintext, source_domain FROM art "
        f"UNION ALL SELECT 'pages', 1, CAST(page_id AS VARCHAR), {SQL_TITLE}, {SQL_MAINTEXT}, NULL FROM pages "
        "UNION ALL SELECT 'conversations', 2, conv_id || '-' || turn, NULL, text, role FROM conversations)",
        "SELECT origin, origin_no, id, title, source_domain, md5(maintext) AS text_md5 FROM u",
    ),
)
def union_sources(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("id"), H.title(F.col("html")).alias("title"),
        H.maintext(F.col("html")).alias("maintext"),
    )
    talks = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("maintext"), F.col("role").alias("source_domain"),
    )
    docs = articles(spark, sf).withColumn("id", F.col("id").cast("string")).drop("lang")
    union = readers.union_sources({"documents": docs, "pages": pages, "conversations": talks})
    return union.select("origin", "origin_no", "id", "title", "source_domain", F.md5("maintext").alias("text_md5"))


@query("scan_csv_labelled", with_(LABELLED, "SELECT CAST(label AS VARCHAR) AS label, text FROM lab"))
def scan_csv_labelled(spark, sf):
    path = staging_path(spark, "csv")
    writers.write_labelled_csv(labelled(spark, sf), path)
    return readers.scan_csv_labelled(spark, path)


@query("write_labelled_csv", with_(LABELLED, "SELECT CAST(label AS VARCHAR) AS label, count(*) AS n, "
       "CAST(sum(length(text)) AS BIGINT) AS chars FROM lab GROUP BY 1"))
def write_labelled_csv(spark, sf):
    path = staging_path(spark, "csv")
    writers.write_labelled_csv(labelled(spark, sf), path)
    return readers.scan_csv_labelled(spark, path).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )


LINES_SQL = (
    "l0 AS (SELECT d.doc_id AS id, string_split(d.text, chr(10)) AS ls, q.quality FROM documents d LEFT JOIN labels q USING (doc_id))",
    "raw AS (SELECT id, generate_subscripts(ls, 1) - 1 AS pos, "
    "CASE WHEN quality IS NULL THEN unnest(ls) ELSE quality || ',' || unnest(ls) END AS line FROM l0)",
)


@query(
    "parse_labelled_lines",
    with_(
        *LINES_SQL,
        "SELECT id, CAST(pos AS INTEGER) AS pos, line[1:1] AS label, CASE WHEN line[3:3] = '\"' THEN line[3:] || '\"' "
        "ELSE line[3:] END AS text FROM raw WHERE regexp_matches(line, '^[01],')",
    ),
)
def parse_labelled_lines(spark, sf):
    """Labelled documents give well-formed lines, the others give malformed ones."""
    lines = labelled(spark, sf, "left").select("id", "label", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    prefixed = F.when(F.col("label").isNull(), F.col("line")).otherwise(
        F.concat(F.col("label").cast("string"), F.lit(","), F.col("line"))
    )
    return readers.parse_labelled_lines(lines.select("id", "pos", prefixed.alias("value")))


@query("load_splits", with_(ART, *SPLIT_SQL, "SELECT id, maintext, lang, split FROM parts"))
def load_splits(spark, sf):
    parts = stage(ordering.split_fractions(articles(spark, sf)).select("id", "maintext", "lang", "split"), "splits")
    files = {}
    for name, extension in (("train", "parquet"), ("valid", "csv"), ("test", "jsonl")):
        files[name] = f"{staging_path(spark, name)}.{extension}"
        part = parts.filter(F.col("split") == name).drop("split")
        if extension == "csv":
            writers.write_quoted_csv(part, files[name], "errorifexists")
        else:
            part.write.format(readers.EXTENSIONS[extension]).save(files[name])
    return readers.load_splits(spark, files, parts.drop("split").schema)


@query(
    "load_stopwords",
    with_(
        f"tok AS (SELECT unnest({sql_tokens('text')}) AS word FROM documents)",
        "SELECT DISTINCT word FROM (SELECT translate(word, 'àáâäçèéêëíîïñóôöùúûü', 'aaaaceeeeiiinooouuuu') AS word "
        "FROM (SELECT DISTINCT word FROM tok)) WHERE word <> ''",
    ),
)
def load_stopwords(spark, sf):
    """A word file made of all words, with blanks around them and every word twice."""
    tokens = table(spark, sf, "documents").select(F.explode(X.pattern_tokens(F.col("text"))).alias("word"))
    path = staging_path(spark, "stopwords")
    padded = F.concat(F.lit("  "), F.col("word"), F.lit("\t"))
    tokens.distinct().select(F.explode(F.array(padded, F.col("word"))).alias("value")).write.text(path)
    return readers.load_stopwords(spark, path, "àáâäçèéêëíîïñóôöùúûü", "aaaaceeeeiiinooouuuu")


@query(
    "load_label_map",
    with_(ART, "s AS (SELECT DISTINCT source_domain FROM art)",
          "SELECT source_domain AS label_text, CAST(row_number() OVER (ORDER BY source_domain) - 1 AS INTEGER) AS label_id FROM s"),
)
def load_label_map(spark, sf):
    """Write the label map of the corpus as one JSON object and load it back."""
    index = labels.label_index(articles(spark, sf), label="source_domain")
    path = staging_path(spark, "labels")
    entries = F.map_from_entries(F.collect_list(F.struct("label_text", "label_id")))
    index.agg(F.to_json(entries).alias("value")).coalesce(1).write.text(path)
    return readers.load_label_map(spark, path)


# --- sinks -------------------------------------------------------------------


@query("write_json_records", with_(ART, SIX_SQL, "SELECT * FROM six"))
def write_json_records(spark, sf):
    path = staging_path(spark, "records")
    writers.write_json_records(six_fields(spark, sf), path)
    return spark.read.schema(ARTICLE).json(path)


@query("write_by_category", with_(ART, "SELECT source_domain, count(*) AS n FROM art GROUP BY 1"))
def write_by_category(spark, sf):
    path = staging_path(spark, "by-category")
    writers.write_by_category(articles(spark, sf), path)
    return labels.label_distribution(spark.read.parquet(path), "source_domain")


@query("write_title_jsonl", with_(ART, "SELECT title, id FROM art"))
def write_title_jsonl(spark, sf):
    path = staging_path(spark, "titles")
    writers.write_title_jsonl(articles(spark, sf), path)
    return spark.read.schema("title string, id bigint").json(path)


@query("read_through_cache", with_(ART, "SELECT lang, count(*) AS n FROM art GROUP BY 1"))
def read_through_cache(spark, sf):
    path = staging_path(spark, "cache")
    build = lambda: labels.label_distribution(articles(spark, sf), "lang")
    writers.read_through_cache(spark, path, build, overwrite=True)
    return writers.read_through_cache(spark, path, build)


# --- filters and projections -------------------------------------------------


@query("clean_for_domain", with_(ART, f"SELECT id, title, maintext, source_domain FROM art WHERE maintext <> '' "
       f"AND source_domain <> '' AND source_domain IN {in_list(ALLOWED_SOURCES)}"))
def clean_for_domain(spark, sf):
    return cleaning.clean_for_domain(articles(spark, sf), ALLOWED_SOURCES).select("id", "title", "maintext", "source_domain")


@query("route_by_title", with_(ART, f"SELECT id, CASE WHEN {' OR '.join(f'contains(title, {chr(39)}{k}{chr(39)})' for k in LATIN_KEYWORDS)} "
       "THEN 'no_title' ELSE 'clean' END AS route FROM art"))
def route_by_title(spark, sf):
    return cleaning.route_by_title(articles(spark, sf), LATIN_KEYWORDS).select("id", "route")


@query(
    "flag_empty_text",
    with_(
        "blank AS (SELECT doc_id AS id, text AS maintext FROM documents UNION ALL "
        "SELECT -1 - doc_id, CASE WHEN length(text) % 2 = 0 THEN '' ELSE chr(9) || ' ' END FROM documents)",
        "SELECT id, trim(maintext, ' ' || chr(9)) = '' AS is_empty FROM blank",
    ),
)
def flag_empty_text(spark, sf):
    docs = articles(spark, sf).select("id", "maintext")
    blanks = docs.select(
        (-1 - F.col("id")).alias("id"), F.when(F.length("maintext") % 2 == 0, "").otherwise("\t ").alias("maintext")
    )
    return cleaning.flag_empty_text(docs.unionByName(blanks)).select("id", "is_empty")


@query("dropna_any", with_("j AS (SELECT d.doc_id AS id, text, quality AS label FROM documents d LEFT JOIN labels USING (doc_id))",
       "SELECT * FROM j WHERE id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL"))
def dropna_any(spark, sf):
    return cleaning.drop_incomplete(labelled(spark, sf, "left"))


@query("keep_string_text", with_("j AS (SELECT l.doc_id AS id, CASE WHEN l.toxic = 0 THEN d.text END AS text, quality AS label "
       "FROM labels l JOIN documents d USING (doc_id))",
       "SELECT id, text AS sentence, CAST(label AS VARCHAR) AS label FROM j WHERE text IS NOT NULL"))
def keep_string_text(spark, sf):
    labels_ = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    joined = docs.join(labels_, "id").select(
        "id", F.when(F.col("toxic") == 0, F.col("text")).alias("text"), F.col("quality").alias("label")
    )
    return cleaning.keep_text_rows(joined)


@query("rename_for_classifier", with_(ART, "SELECT id, maintext AS sentence, title, source_domain AS label, lang FROM art"))
def rename_for_classifier(spark, sf):
    return cleaning.rename_for_classifier(articles(spark, sf))


@query(
    "drop_metadata",
    with_(ART, f"SELECT row_number() OVER (ORDER BY id) - 1 AS id, title, maintext AS sentence, source_domain AS label "
          f"FROM art WHERE source_domain IN {in_list(ALLOWED_SOURCES)}"),
)
def drop_metadata(spark, sf):
    raw = six_fields(spark, sf).withColumn("id", F.col("id").cast("bigint"))
    return cleaning.drop_metadata(cleaning.rename_for_classifier(cleaning.clean_for_domain(raw, ALLOWED_SOURCES)))


@query("select_text_summary", with_(ART, "SELECT id, maintext AS text, title AS summary FROM art"))
def select_text_summary(spark, sf):
    return cleaning.select_text_summary(articles(spark, sf), keep=["id"])


@query("drop_label", with_(LOGITS, "SELECT id, array_to_string(list_transform(scores, "
       "lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ' ') AS scores FROM logit"))
def drop_label(spark, sf):
    kept = cleaning.drop_label(logits(spark, sf))
    micros = F.transform("scores", lambda x: F.round(x.cast("double") * 1000000).cast("bigint"))
    return kept.select("id", F.array_join(micros, " ").alias("scores"))


@query(
    "pick_sentence_pair",
    "SELECT a.conv_id || '-' || a.turn AS id, a.text AS first, b.text AS second "
    "FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
)
def pick_sentence_pair(spark, sf):
    """Each turn with the next one: an equi join on (conversation, turn)."""
    turns = table(spark, sf, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sentence2"))
    pairs = turns.withColumnRenamed("text", "sentence1").join(following, ["conv_id", "turn"])
    first, second = cleaning.pick_sentence_pair(pairs)
    return pairs.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col(first).alias("first"), F.col(second).alias("second"),
    )


@query("add_source_prefix", "SELECT doc_id AS id, 'summarize: ' || text AS text FROM documents")
def add_source_prefix(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return cleaning.add_source_prefix(docs, "summarize: ")


@query("default_missing_label", "SELECT d.doc_id AS id, coalesce(quality, 0) AS label FROM documents d LEFT JOIN labels USING (doc_id)")
def default_missing_label(spark, sf):
    return cleaning.default_missing_label(labelled(spark, sf, "left").select("id", "label"))


@query(
    "detect_task_type",
    "SELECT 'classification' AS task, count(*) AS n, CAST(min(quality) AS DOUBLE) AS lo, CAST(max(quality) AS DOUBLE) AS hi FROM labels "
    "UNION ALL SELECT 'regression', count(*), min(l_discount), max(l_discount) FROM lineitem",
)
def detect_task_type(spark, sf):
    """Task by label type, with the label range it implies."""
    parts = [
        table(spark, sf, "labels").select(F.col("quality").alias("label")),
        table(spark, sf, "lineitem").select(F.col("l_discount").alias("label")),
    ]
    ranges = [
        p.agg(F.lit(cleaning.detect_task_type(p)).alias("task"), F.count(F.lit(1)).alias("n"),
              F.min("label").cast("double").alias("lo"), F.max("label").cast("double").alias("hi"))
        for p in parts
    ]
    return ranges[0].unionByName(ranges[1])


# --- numbering, splits, samples ----------------------------------------------


@query("assign_ordinal", with_(ART, f"SELECT id, source_domain, row_number() OVER (ORDER BY id) - 1 AS ordinal FROM art "
       f"WHERE source_domain IN {in_list(ALLOWED_SOURCES)}"))
def assign_ordinal(spark, sf):
    kept = cleaning.clean_for_domain(articles(spark, sf), ALLOWED_SOURCES).select("id", "source_domain")
    return ordering.assign_ordinal(kept, "id")


@query("split_80_10_10", with_(ART, *SPLIT_SQL, "SELECT id, split FROM parts"))
def split_80_10_10(spark, sf):
    return ordering.split_fractions(articles(spark, sf)).select("id", "split")


@query("split_80_10_10_drop_last", with_(ART, *SPLIT_SQL, "SELECT id, split FROM parts WHERE rn < n"))
def split_80_10_10_drop_last(spark, sf):
    return ordering.split_fractions(articles(spark, sf), drop_last=True).select("id", "split")


@query("split_stratified", with_(ART, *STRATIFIED_SQL, "SELECT id, lang, split FROM strat"))
def split_stratified(spark, sf):
    return ordering.split_stratified(articles(spark, sf), "lang").select("id", "lang", "split")


@query("split_random", with_(ART, "r AS (SELECT id, row_number() OVER (ORDER BY md5('0:' || id)) AS rn, count(*) OVER () AS n FROM art)",
       "SELECT id, CASE WHEN rn <= ceil(n * 0.1) THEN 'valid' ELSE 'train' END AS split FROM r"))
def split_random(spark, sf):
    return ordering.split_random(articles(spark, sf)).select("id", "split")


@query("sample_rows", with_(ART, "SELECT id, title FROM art ORDER BY md5('42:' || id), id LIMIT 3"))
def sample_rows(spark, sf):
    return ordering.sample_rows(articles(spark, sf), 3).select("id", "title")


@query("head_n", with_(ART, *SPLIT_SQL, "SELECT id, split FROM (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY id) AS k FROM parts) WHERE k <= 50"))
def head_n(spark, sf):
    """First rows of each split, each part cut on its own."""
    parts = ordering.split_fractions(articles(spark, sf)).select("id", "split")
    heads = [ordering.head(parts.filter(F.col("split") == s), 50) for s in ("train", "valid", "test")]
    return heads[0].unionByName(heads[1]).unionByName(heads[2])


@query("seed_control", with_(ART, "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5('7:' || id)) AS a, "
       "row_number() OVER (ORDER BY md5('8:' || id)) AS b, count(*) OVER () AS n FROM art) WHERE a <= ceil(n * 0.1) AND b <= ceil(n * 0.1)"))
def seed_control(spark, sf):
    """Rows chosen by two different seeds: the draw depends on the seed and the id only."""
    docs = articles(spark, sf).select("id")
    chosen = [ordering.split_random(docs, seed=s).filter(F.col("split") == "valid").select("id") for s in (7, 8)]
    return chosen[0].join(chosen[1], "id", "left_semi")


@query("assign_batches", with_(ART, "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 16 AS batch FROM art"))
def assign_batches(spark, sf):
    return ordering.assign_batches(articles(spark, sf).select("id"), 16)


@query(
    "stage_counts",
    with_(
        ART, *STRATIFIED_SQL,
        "clean AS (SELECT * FROM strat WHERE source_domain IN " + in_list(ALLOWED_SOURCES) + ")",
        "SELECT 'raw' AS stage, count(*) AS n FROM art UNION ALL SELECT 'clean', count(*) FROM clean "
        "UNION ALL SELECT split, count(*) FROM strat GROUP BY split",
    ),
)
def stage_counts(spark, sf):
    """Row counts after load, clean and split, in one pass."""
    parts = ordering.split_stratified(articles(spark, sf).select("id", "lang", "source_domain", F.length("maintext").alias("chars")), "lang")
    counts = parts.agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if((F.col("chars") > 0) & F.col("source_domain").isin(*ALLOWED_SOURCES)).alias("clean"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "valid").alias("valid"),
    )
    return counts.unpivot([], ["raw", "clean", "train", "valid"], "stage", "n")


@query("capped_sample_count", "SELECT least(300, count(*)) AS eval_samples, count(*) AS n FROM documents")
def capped_sample_count(spark, sf):
    return table(spark, sf, "documents").agg(metrics.capped_sample_count(300).alias("eval_samples"), F.count(F.lit(1)).alias("n"))


# --- streaming ---------------------------------------------------------------


@query("stream_ingest_articles", with_(ART, f"SELECT id, title, maintext, source_domain FROM art WHERE maintext <> '' "
       f"AND source_domain IN {in_list(ALLOWED_SOURCES)}"))
def stream_ingest_articles(spark, sf):
    drops, sink, checkpoint = (staging_path(spark, p) for p in ("drops", "ingested", "stream-checkpoint"))
    writers.write_json_records(six_fields(spark, sf).repartition(4), drops)
    ingest.stream_ingest_articles(spark, drops, sink, checkpoint, ALLOWED_SOURCES, files_per_trigger=2)
    return spark.read.schema(ARTICLE).parquet(sink).select(F.col("id").cast("bigint").alias("id"), "title", "maintext", "source_domain")
