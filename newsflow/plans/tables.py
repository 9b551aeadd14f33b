"""Article views over the supplied tables, and the SQL fragments of the checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.text import WHITESPACE

# ---------------------------------------------------------------------------
# Fixed values of the queries over the supplied tables.
# ---------------------------------------------------------------------------
ALLOWED_SOURCES = ("src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7", "src8", "src9")
LATIN_KEYWORDS = ("tion", "heed")
LATIN_NEGATORS = ("not", "no")
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "by", "das", "de", "der", "die", "el", "en", "est", "et", "for", "in",
    "is", "la", "le", "les", "los", "of", "on", "que", "the", "to", "un", "und", "une", "was", "with", "y",
)
ACCENTED = "àáâäçèéêëíîïñóôöùúûüß"
FOLDED = "aaaaceeeeiiinooouuuus"
# Values of an embedding.
VECTOR = 64
# Characters of text that a task works on, and most of them where more tasks would need sorted shuffle writers.
TASK_CHARS = 8 << 20
MOST_CHARS = 64 << 20
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_tasks(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks of about ``TASK_CHARS`` characters for the texts of a table, of up to ``MOST_CHARS`` in a large one.

    A writer for more tasks than ``spark.shuffle.sort.bypassMergeThreshold`` holds its whole input, one row group at least, in memory; for fewer
    it holds none. So tasks grow to ``MOST_CHARS`` before there are more of them than that.
    """
    chars = table(spark, sf_dir, name).agg(F.sum(F.length("html" if name == "pages" else "text"))).first()[0] or 0
    unsorted = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(spark.sparkContext.defaultParallelism, min(-(-chars // TASK_CHARS), unsorted), -(-chars // MOST_CHARS))


def texts(spark: SparkSession, sf_dir: str, name: str, key: str, tasks: int | None = None) -> DataFrame:
    """A table whose texts are parsed or tokenised, dealt over ``tasks``, or by ``text_tasks``.

    How a file was written says nothing about the work in it: one row group is one task however large it is, and equal texts take next to
    no room in a file. So the rows are dealt by the length of their texts, which costs one pass and one move of the texts, in
    proportion to the table; a task never has more than its share, rows that repeat a key aside.
    """
    return table(spark, sf_dir, name).repartition(tasks or text_tasks(spark, sf_dir, name), key)


def articles(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Documents as articles: the text before the first line break is the title. ``dealt`` over tasks for work on the texts."""
    docs = texts(spark, sf_dir, "documents", "doc_id") if dealt else table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("maintext"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("source_domain"),
        "lang",
    )


def documents(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """``(id, text)`` of all documents, for work on the texts."""
    return texts(spark, sf_dir, "documents", "doc_id", tasks).select(F.col("doc_id").alias("id"), "text")


def labelled(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """``(id, text, label)``: documents with their quality label."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return docs.join(labels, "id", how)


def logits(spark: SparkSession, sf_dir: str, classes: int = 10) -> DataFrame:
    """``(id, scores, label)``: all values of each vector, summed by position modulo the classes, act as class scores."""
    value = lambda i: F.get("embedding", F.lit(i)).cast("double")
    sums = [reduce(lambda a, b: a + b, [value(i) for i in range(k, VECTOR, classes)]) for k in range(classes)]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(*sums).alias("scores"), "label")


def with_(*parts: str) -> str:
    """``WITH a, b, c SELECT``: the last part is the body."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(quote(w) for w in words) + ")"


SQL_WS = quote(WHITESPACE)
SQL_SENTENCE = quote(r"""(?s).+?(?:[.!?]+["'”’)\]]*(?:\s+|\z)|[。！？]+["'”’)\]]*|\z)""")


def sql_strip(x: str) -> str:
    return f"trim({x}, {SQL_WS})"


def sql_tokens(x: str, stop: bool = False) -> str:
    tokens = rf"regexp_extract_all(lower({x}), '\[?[\p{{L}}\p{{N}}_]+\]?')"
    return f"list_filter({tokens}, lambda t: t NOT IN {in_list(STOPWORDS)})" if stop else tokens


def sql_words(x: str) -> str:
    han = r"\x{3005}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
    return rf"regexp_extract_all({x}, '[^\P{{L}}{han}]+|[{han}]')"


def sql_sentences(x: str) -> str:
    pieces = f"regexp_extract_all({x}, {SQL_SENTENCE})"
    return f"list_filter(list_transform({pieces}, lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_text_of(x: str) -> str:
    text = f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"),
        ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
    ):
        text = f"replace({text}, {quote(entity)}, {quote(char)})"
    return text


SQL_TITLE = sql_strip(sql_text_of("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
# In the supplied pages all text of an article but its heading is in paragraphs, so the check needs no rule for where one ends.
SQL_ARTICLE = "regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"
SQL_N_PARAGRAPHS = f"CAST(len(regexp_extract_all({SQL_ARTICLE}, '<p[ >]')) AS INTEGER)"
SQL_MAINTEXT = sql_text_of(f"regexp_replace({SQL_ARTICLE}, '(?s)<h1>.*?</h1>', '')")
SQL_ROWS = r"regexp_extract_all(html, '(?is)<li(?:\s[^>]*)?>(.*?)</li>', 1)"


def sql_url_key(x: str) -> str:
    bare = f"regexp_replace({x}, '[?#].*$', '')"
    return (
        rf"lower(regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/]+)', 1)) || "
        rf"regexp_replace(regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]+(/.*)?$', 1), '/+$', '')"
    )


ART = (
    "art AS (SELECT doc_id AS id, text AS maintext, split_part(text, chr(10), 1) AS title, "
    "source AS source_domain, lang FROM documents)"
)
LABELLED = "lab AS (SELECT d.doc_id AS id, d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"
LOGITS = "logit AS (SELECT vec_id AS id, [" + ", ".join(
    " + ".join(f"embedding[{i + 1}]::DOUBLE" for i in range(k, VECTOR, 10)) for k in range(10)
) + "] AS scores, label FROM embeddings)"
PREDICTED = "pred AS (SELECT id, label, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS pred FROM logit)"

# TF-IDF over all documents, stop words removed.
TF = (
    f"tok AS (SELECT doc_id AS id, unnest({sql_tokens('text', stop=True)}) AS term FROM documents)",
    "tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL)",
    "idf AS (SELECT term, count(*) AS df, "
    "ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY term)",
    "w AS (SELECT id, term, tf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS weight "
    "FROM tf JOIN idf USING (term))",
)
# Scored sentence candidates.
SENT = (
    f"sent0 AS (SELECT doc_id AS id, {sql_sentences('text')} AS ss FROM documents)",
    "sent AS (SELECT id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS pos, unnest(ss) AS sentence FROM sent0)",
)
CAND = (
    *TF,
    *SENT,
    f"stok AS (SELECT id, pos, unnest({sql_tokens('sentence', stop=True)}) AS term FROM sent)",
    "sc AS (SELECT id, pos, round(avg(weight), 6) AS score FROM stok JOIN w USING (id, term) GROUP BY id, pos)",
    "cand AS (SELECT s.id, s.pos, s.sentence, coalesce(sc.score, 0.0) AS score "
    "FROM sent s LEFT JOIN sc ON s.id = sc.id AND s.pos = sc.pos)",
    "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM cand)",
)
