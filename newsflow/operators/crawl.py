"""From stored list and article pages to article records."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.functions import html as H
from newsflow.functions import text as X
from newsflow.operators.lookup import lookup_join, sized
from newsflow.session import stage

# Pages walked per list and the chunked walk, by default.
FIRST_PAGE, LAST_PAGE = 1, 5
CHUNKS, WORKERS, PAGES_PER_WORKER, PAGES_PER_CHUNK = 4, 9, 10, 100


def crawl_frontier(categories: DataFrame, first: int = FIRST_PAGE, last: int = LAST_PAGE) -> DataFrame:
    """List pages to visit: ``(source_domain, template, page, url)``."""
    return (
        categories.select("source_domain", F.explode("link").alias("template"))
        .withColumn("page", F.explode(F.sequence(F.lit(first), F.lit(last))))
        .withColumn("url", F.replace(F.col("template"), F.lit("{}"), F.col("page").cast("string")))
    )


def chunked_frontier(
    templates: DataFrame,
    chunks: int = CHUNKS,
    workers: int = WORKERS,
    pages: int = PAGES_PER_WORKER,
    chunk_pages: int = PAGES_PER_CHUNK,
) -> DataFrame:
    """Pages by chunk and worker. Worker numbers start at 1, so the first ``pages`` of a chunk are skipped."""
    number = (F.col("chunk") - 1) * chunk_pages + F.col("worker") * pages + F.col("step")
    return (
        templates.withColumn("chunk", F.explode(F.sequence(F.lit(1), F.lit(chunks))))
        .withColumn("worker", F.explode(F.sequence(F.lit(1), F.lit(workers))))
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
        .withColumn("page", number)
        .drop("step")
        .withColumn("url", F.replace(F.col("template"), F.lit("{}"), F.col("page").cast("string")))
    )


def extract_links(pages: DataFrame, html: str = "html", element: str = "li") -> DataFrame:
    """``(page_id, url, pos, href, first_cell)``: first link of every row but the header row.

    ``element`` is ``li`` for lists and ``tr`` for tables, whose first cell, such as a date, comes along; lists have none.
    """
    return (
        pages.select("page_id", "url", F.posexplode(H.list_rows(F.col(html), element)).alias("pos", "_row"))
        .filter(F.col("pos") > 0)
        .withColumn("href", H.first_href(F.col("_row")))
        .filter(F.col("href").isNotNull())
        .withColumn("first_cell", F.get(H.cells(F.col("_row")), F.lit(0)))
        .drop("_row")
    )


def resolve_links(links: DataFrame) -> DataFrame:
    """Add the absolute ``link`` and its join key."""
    return links.withColumn("link", H.resolve_url(F.col("url"), F.col("href"))).withColumn(
        "link_key", H.normalize_url(F.col("link"))
    )


def link_page_join(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Each link with the page it leads to, NULL when that page is not stored.

    One page per address (the first stored), so a popular address never multiplies
    rows. Popular addresses are found among the links, so a menu link to a page that is not stored
    is no hot spot either.
    """
    by_address = pages.select(H.normalize_url(F.col("url")).alias("link_key"), "page_id").groupBy("link_key").agg(
        F.min("page_id").alias("target_id")
    )
    return lookup_join(links, stage(by_address, "link-targets"), "link_key")


def links_to_fetch(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct addresses that no stored page covers yet."""
    # Both sides are made distinct map-side first, so neither brings a hot address.
    stored = pages.select(H.normalize_url(F.col("url")).alias("link_key")).distinct()
    return links.select("link_key").distinct().join(stored, "link_key", "left_anti")


def assemble_articles(pages: DataFrame, source_domain: str | Column = "", date_publish: Column | None = None) -> DataFrame:
    """The six-field article record of every page; ``id`` stays empty until numbering."""
    domain = source_domain if isinstance(source_domain, Column) else F.lit(source_domain)
    return pages.select(
        (F.lit("") if date_publish is None else date_publish).alias("date_publish"),
        F.lit("").alias("id"),
        H.maintext(F.col("html")).alias("maintext"),
        domain.alias("source_domain"),
        "url",
        H.title(F.col("html")).alias("title"),
    )


def mark_bad_pages(pages: DataFrame) -> DataFrame:
    """Add ``reason``: why a page gives no record, NULL for good pages.

    Good and rejected rows are two filters over the same marked table, so a bad page
    is kept with its reason instead of being lost or ending the run.
    """
    html = F.col("html")
    reason = (
        F.when(html.isNull() | (X.strip(html) == ""), "empty page")
        .when(~html.rlike(H.TITLE), "no title")
        .when(~H.has_element(html, "article"), "no article")
        .when(F.size(H.paragraphs(H.article_node(html))) == 0, "no paragraph")
    )
    return pages.withColumn("reason", reason)


def assign_category(pages: DataFrame, categories: DataFrame) -> DataFrame:
    """Category of a page by the path segment its list page belongs to.

    ``categories`` is ``(segment, source_domain)``, one row per list template.
    """
    segment = F.regexp_extract(F.col("url"), r"^[a-z]+://[^/]+/([^/?#]*)", 1)
    return pages.withColumn("segment", segment).join(sized(categories), "segment", "left")


def convert_phrases(text: Column, phrases: Mapping[str, str]) -> Column:
    """Replace phrases in one walk over the text: at each place the longest phrase that begins there, and nothing inside a replaced phrase again.

    The table may be of any size that fits a worker: it is cut by first character, and only lengths that begin with it are tried.
    """
    table = {p: r for p, r in phrases.items() if p}
    if not table:
        return text
    lengths: dict[str, list[int]] = {}
    for phrase in table:
        own = lengths.setdefault(phrase[0], [])
        if len(phrase) not in own:
            own.append(len(phrase))
    for own in lengths.values():
        own.sort(reverse=True)
    first = "[" + "".join(re.escape(c) for c in lengths) + "]"

    def convert(texts: pa.Array) -> pa.Array:
        begin = re.compile(first)
        done = []
        for value in texts.to_pylist():
            if value is None:
                done.append(None)
                continue
            parts, at, hit = [], 0, begin.search(value)
            while hit:
                start = hit.start()
                size = next((n for n in lengths[value[start]] if value[start : start + n] in table), 0)
                if size:
                    parts += (value[at:start], table[value[start : start + size]])
                    at = start + size
                hit = begin.search(value, start + max(size, 1))
            done.append("".join(parts) + value[at:])
        return pa.array(done, pa.string())

    return F.arrow_udf(convert, T.StringType())(text)


def convert_script(text: Column, source: str, target: str, phrases: Mapping[str, str] | None = None) -> Column:
    """Script conversion by table in one walk: the longest phrase at each place, else its single character."""
    if not phrases:
        return X.fold_characters(text, source, target)
    return convert_phrases(text, dict(zip(source, target)) | dict(phrases))
