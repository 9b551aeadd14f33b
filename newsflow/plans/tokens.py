"""Queries: text functions, vocabulary, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.functions import arrays as A
from newsflow.functions import text as X
from newsflow.operators import encode, features, summarize
from newsflow.plans.registry import query
from newsflow.plans.tables import (
    LATIN_NEGATORS, SENT, STOPWORDS, documents, in_list, sql_sentences, sql_strip, sql_tokens, sql_words, table, with_,
)
from newsflow.session import stage
from newsflow.sources import readers

VOCABULARY = 5_000
MAX_LENGTH = 128
PAIR_LENGTH = 64

# Marks for the social clean-up, put around every text.
MARK_SQL = "marked AS (SELECT doc_id AS id, '{%place%} ' || text || chr(8203) || ' @reader' AS text FROM documents)"
CLEAN_SQL = (
    MARK_SQL,
    r"clean AS (SELECT id, replace(regexp_replace(regexp_replace(text, '\{%[^\n]+?%\}', ' ', 'g'), "
    r"'@[^\n]+?(?: |(\n?)\z)', ' \1', 'g'), chr(8203), ' ') AS text FROM marked)",
)
VOCAB_SQL = (
    f"tokens AS (SELECT doc_id AS id, {sql_tokens('text')} AS ts FROM documents)",
    "occ AS (SELECT id, generate_subscripts(ts, 1) AS pos, unnest(ts) AS token FROM tokens)",
    f"vocab AS (SELECT token, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS INTEGER) AS token_id "
    f"FROM occ GROUP BY token ORDER BY n DESC, token LIMIT {VOCABULARY})",
    "enc AS (SELECT t.id, coalesce(list(coalesce(v.token_id, 1) ORDER BY o.pos) FILTER (WHERE o.pos IS NOT NULL), []) AS ids "
    "FROM tokens t LEFT JOIN occ o USING (id) LEFT JOIN vocab v USING (token) GROUP BY t.id)",
)


def tokens():
    return X.pattern_tokens(F.col("text"))


def vocabulary(spark, sf):
    return stage(encode.build_vocab(documents(spark, sf), tokens(), VOCABULARY), "vocab")


def encoded(spark, sf):
    return encode.encode_tokens(documents(spark, sf), tokens(), vocabulary(spark, sf))


def joined(ids):
    return F.array_join(F.col(ids).cast("array<string>"), " ")


# --- text functions ----------------------------------------------------------


@query("clean_social_text", with_(*CLEAN_SQL, "SELECT id, text FROM clean"))
def clean_social_text(spark, sf):
    marked = documents(spark, sf).withColumn("text", F.concat(F.lit("{%place%} "), "text", F.lit("\u200b @reader")))
    return marked.withColumn("text", X.clean_social(F.col("text")))


@query("tokenize_words", f"SELECT doc_id AS id, array_to_string({sql_words('lower(text)')}, ' ') AS words FROM documents")
def tokenize_words(spark, sf):
    return documents(spark, sf).select("id", F.array_join(X.words(F.col("text")), " ").alias("words"))


NEGATION = "|".join(LATIN_NEGATORS)


@query(
    "merge_negation",
    with_(
        f"t AS (SELECT doc_id AS id, {sql_words('lower(text)')} AS ts FROM documents)",
        "o AS (SELECT id, generate_subscripts(ts, 1) AS pos, unnest(ts) AS tok FROM t)",
        f"f AS (SELECT *, tok IN {in_list(LATIN_NEGATORS)} AS neg FROM o)",
        # Within a run of negators every second one starts a pair.
        "g AS (SELECT *, pos - row_number() OVER (PARTITION BY id, neg ORDER BY pos) AS island FROM f)",
        "r AS (SELECT *, CASE WHEN neg THEN row_number() OVER (PARTITION BY id, neg, island ORDER BY pos) % 2 = 1 ELSE FALSE END AS opens FROM g)",
        "j AS (SELECT id, string_agg(tok || CASE WHEN opens THEN '' ELSE ' ' END, '' ORDER BY pos) AS merged FROM r GROUP BY id)",
        "SELECT t.id, coalesce(trim(merged, ' '), '') AS merged FROM t LEFT JOIN j USING (id)",
    ),
)
def merge_negation(spark, sf):
    return documents(spark, sf).select("id", X.merge_negation(X.words(F.col("text")), LATIN_NEGATORS).alias("merged"))


@query("tokenize_pattern", f"SELECT doc_id AS id, CAST(len({sql_tokens('text')}) AS INTEGER) AS n, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents")
def tokenize_pattern(spark, sf):
    return documents(spark, sf).select("id", tokens().alias("t")).select("id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("join_tokens", f"SELECT page_id AS id, array_to_string({sql_tokens('html')}, ' ') AS joined FROM pages")
def join_tokens(spark, sf):
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.array_join(X.pattern_tokens(F.col("html")), " ").alias("joined")
    )


@query("postprocess_summary", f"SELECT doc_id AS id, array_to_string({sql_sentences(sql_strip('text'))}, chr(10)) AS lines FROM documents")
def postprocess_summary(spark, sf):
    return documents(spark, sf).select("id", X.one_sentence_per_line(F.col("text")).alias("lines"))


@query(
    "ngrams",
    with_(
        f"t AS (SELECT doc_id AS id, {sql_tokens('text')} AS ts FROM documents)",
        "o AS (SELECT id, generate_subscripts(ts, 1) AS pos, unnest(ts) AS tok FROM t)",
        "g AS (SELECT id, tok || ' ' || lead(tok) OVER (PARTITION BY id ORDER BY pos) AS gram FROM o)",
        "SELECT gram, count(*) AS n, count(DISTINCT id) AS documents FROM g WHERE gram IS NOT NULL GROUP BY gram",
    ),
)
def ngrams(spark, sf):
    """Bigram and document counts of the corpus; repeats inside a text are counted in its row, so one row per text and bigram is summed map-side."""
    texts_ = documents(spark, sf).select("id", tokens().alias("t")).select("id", X.ngrams(F.col("t"), 2).alias("grams"))
    counts = features.term_counts(texts_, F.col("grams")).groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("documents"))
    return counts.withColumnRenamed("term", "gram")


@query("split_sentences", with_(*SENT, "SELECT id, pos, sentence FROM sent"))
def split_sentences(spark, sf):
    return summarize.sentence_table(documents(spark, sf), "text")


# --- token joins -------------------------------------------------------------


@query("remove_stopwords", with_(
       f"o AS (SELECT doc_id AS id, unnest({sql_tokens('text')}) AS token FROM documents)",
       f"SELECT id, token, count(*) AS n FROM o WHERE token NOT IN {in_list(STOPWORDS)} GROUP BY ALL"))
def remove_stopwords(spark, sf):
    """Kept tokens per document with their repeats."""
    stop = readers.clean_stopwords(spark.createDataFrame([(w,) for w in STOPWORDS], "value string"))
    rows = features.term_counts(documents(spark, sf), tokens()).withColumnsRenamed({"term": "token", "tf": "n"})
    return features.remove_stopwords(rows, stop).select("id", "token", "n")


# --- encoding ----------------------------------------------------------------


@query("build_vocab", with_(*VOCAB_SQL, "SELECT token, token_id, n FROM vocab"))
def build_vocab(spark, sf):
    return encode.build_vocab(documents(spark, sf), tokens(), VOCABULARY)


@query("encode_tokens", with_(*VOCAB_SQL, "SELECT id, array_to_string(ids, ' ') AS ids FROM enc"))
def encode_tokens(spark, sf):
    return encoded(spark, sf).select("id", joined("ids").alias("ids"))


@query("truncate_ids", with_(*VOCAB_SQL, f"SELECT id, array_to_string(ids[1:{MAX_LENGTH}], ' ') AS ids FROM enc"))
def truncate_ids(spark, sf):
    return encoded(spark, sf).withColumn("ids", A.truncate(F.col("ids"), MAX_LENGTH)).select("id", joined("ids").alias("ids"))


PAIR_SQL = (
    "turns AS (SELECT a.conv_id || '-' || a.turn AS id, a.text AS t1, b.text AS t2 FROM conversations a "
    "JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)",
    f"ptok AS (SELECT id, 1 AS side, {sql_tokens('t1')} AS ts FROM turns UNION ALL SELECT id, 2, {sql_tokens('t2')} FROM turns)",
    "pocc AS (SELECT id, side, generate_subscripts(ts, 1) AS pos, unnest(ts) AS token FROM ptok)",
    "penc AS (SELECT p.id, p.side, coalesce(list(coalesce(v.token_id, 1) ORDER BY o.pos) FILTER (WHERE o.pos IS NOT NULL), []) AS ids "
    "FROM ptok p LEFT JOIN pocc o ON p.id = o.id AND p.side = o.side LEFT JOIN vocab v ON v.token = o.token GROUP BY p.id, p.side)",
    "pair AS (SELECT a.id, a.ids AS i1, b.ids AS i2, len(a.ids) AS n1, len(b.ids) AS n2 FROM penc a JOIN penc b ON a.id = b.id "
    "AND a.side = 1 AND b.side = 2)",
    f"kept AS (SELECT *, CASE WHEN n1 + n2 <= {PAIR_LENGTH} THEN n1 WHEN n2 <= {PAIR_LENGTH // 2} THEN {PAIR_LENGTH} - n2 "
    f"ELSE least(n1, {(PAIR_LENGTH + 1) // 2}) END AS k1 FROM pair)",
)


@query("encode_pairs", with_(*VOCAB_SQL, *PAIR_SQL, f"SELECT id, array_to_string(i1[1:k1], ' ') AS ids1, "
       f"array_to_string(i2[1:CASE WHEN n1 + n2 <= {PAIR_LENGTH} THEN n2 ELSE least(n2, {PAIR_LENGTH} - k1) END], ' ') AS ids2 FROM kept"))
def encode_pairs(spark, sf):
    turns = table(spark, sf, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("second"))
    pairs = turns.join(following, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", "second"
    )
    ids = encode.encode_pairs(pairs, X.pattern_tokens(F.col("text")), X.pattern_tokens(F.col("second")), vocabulary(spark, sf))
    return encode.truncate_pair(ids, PAIR_LENGTH).select("id", joined("ids1").alias("ids1"), joined("ids2").alias("ids2"))


BATCH_SQL = (
    "cut AS (SELECT id, ids, (row_number() OVER (ORDER BY id) - 1) // 16 AS batch FROM enc)",
    "longest AS (SELECT *, CAST(ceil(max(len(ids)) OVER (PARTITION BY batch) / 8) * 8 AS BIGINT) AS width FROM cut)",
)


@query("pad_ids", with_(*VOCAB_SQL, *BATCH_SQL,
       "SELECT id, batch, array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda x: 0)), ' ') AS input_ids, "
       "array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(width - len(ids)), lambda x: 0)), ' ') "
       "AS attention_mask FROM longest"))
def pad_ids(spark, sf):
    padded = encode.pad_batches(stage(encoded(spark, sf), "encoded"), 16, multiple=8)
    return padded.select("id", "batch", joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask"))


PARTS_SQL = (
    f"part AS (SELECT id, ids, unnest(range(0, greatest(len(ids), 1), {MAX_LENGTH})) AS first FROM enc)",
    f"f AS (SELECT id, first // {MAX_LENGTH} AS part, ids[first + 1:first + {MAX_LENGTH}] AS ids FROM part)",
)


def parts(spark, sf):
    """All ids of every text, cut into parts of the fixed length."""
    first = F.explode(F.sequence(F.lit(0), F.greatest(F.size("ids") - 1, F.lit(0)), F.lit(MAX_LENGTH)))
    cut = encoded(spark, sf).withColumn("first", first)
    ids = F.slice("ids", F.col("first") + 1, MAX_LENGTH)
    return cut.select("id", F.floor(F.col("first") / MAX_LENGTH).cast("bigint").alias("part"), ids.alias("ids"))


@query("pad_fixed", with_(*VOCAB_SQL, *PARTS_SQL,
       f"SELECT id, part, array_to_string(list_concat(ids, list_transform(range({MAX_LENGTH} - len(ids)), lambda x: 0)), ' ') AS input_ids, "
       f"CAST(len(ids) AS INTEGER) AS real_ids FROM f"))
def pad_fixed(spark, sf):
    padded = encode.pad_fixed(parts(spark, sf), MAX_LENGTH)
    return padded.select(
        "id", "part", joined("input_ids").alias("input_ids"),
        F.size(F.array_compact(F.transform("attention_mask", lambda m: F.nullif(m, F.lit(0))))).alias("real_ids"),
    )


@query("mask_label_padding", with_(*VOCAB_SQL, *PARTS_SQL,
       f"SELECT id, part, array_to_string(list_concat(ids, list_transform(range({MAX_LENGTH} - len(ids)), lambda x: -100)), ' ') AS labels, "
       f"array_to_string(list_concat(ids, list_transform(range({MAX_LENGTH} - len(ids)), lambda x: 0)), ' ') AS restored FROM f"))
def mask_label_padding(spark, sf):
    padded = encode.pad_fixed(parts(spark, sf), MAX_LENGTH)
    masked = padded.withColumn("labels", A.swap_value(F.col("input_ids"), encode.PAD_ID, -100))
    restored = masked.withColumn("restored", A.swap_value(F.col("labels"), -100, encode.PAD_ID))
    return restored.select("id", "part", joined("labels").alias("labels"), joined("restored").alias("restored"))


@query("decode_ids", with_(*VOCAB_SQL,
       "kept AS (SELECT o.id, string_agg(o.token, ' ' ORDER BY o.pos) AS text FROM occ o JOIN vocab USING (token) GROUP BY o.id)",
       "SELECT t.id, coalesce(kept.text, '') AS text FROM tokens t LEFT JOIN kept USING (id)"))
def decode_ids(spark, sf):
    vocab = vocabulary(spark, sf)
    ids = encode.encode_tokens(documents(spark, sf), tokens(), vocab)
    return encode.decode_ids(ids, vocab)
