"""Queries: stored pages to article records."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.functions import html as H
from newsflow.functions import text as X
from newsflow.operators import crawl
from newsflow.plans import jobs
from newsflow.plans.registry import query
from newsflow.plans.tables import (
    ACCENTED, FOLDED, SQL_MAINTEXT, SQL_N_PARAGRAPHS, SQL_ROWS, SQL_TITLE, quote, sql_strip, sql_url_key,
    documents, table, texts, with_,
)
from newsflow.schemas import ARTICLE
from newsflow.session import staging_path

SEGMENT = r"^[a-z]+://[^/]+/([^/?#]*)"
LINKS_SQL = (
    f"lr AS (SELECT page_id, url, {SQL_ROWS} AS rs FROM pages)",
    "lu AS (SELECT page_id, url, CAST(generate_subscripts(rs, 1) - 1 AS INTEGER) AS pos, unnest(rs) AS r FROM lr)",
    """links AS (SELECT page_id, url, pos, regexp_extract(r, '(?is)<a\\s[^>]*?href="([^"]*)"', 1) AS href FROM lu
       WHERE pos > 0 AND regexp_extract(r, '(?is)<a\\s[^>]*?href="([^"]*)"', 1) <> '')""",
    """abs AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
       WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href
       WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || href
       ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || '/' || href END AS link FROM links)""",
    f"keyed AS (SELECT *, {sql_url_key('link')} AS link_key FROM abs)",
)
# The menu links of the supplied pages lead nowhere, so every page is also listed once by its own address.
SELF_SQL = (
    *LINKS_SQL,
    f"allk AS (SELECT page_id, pos, link_key FROM keyed UNION ALL SELECT page_id, -1, {sql_url_key('url')} FROM pages)",
    f"stored AS (SELECT {sql_url_key('url')} AS link_key, min(page_id) AS target_id FROM pages GROUP BY 1)",
)


def site_links(spark, sf):
    return crawl.resolve_links(crawl.extract_links(texts(spark, sf, "pages", "page_id")))


def all_links(spark, sf):
    menu = site_links(spark, sf).select("page_id", "pos", "link_key")
    listed = texts(spark, sf, "pages", "page_id").select(
        "page_id", F.lit(-1).alias("pos"), H.normalize_url(F.col("url")).alias("link_key")
    )
    return menu.unionByName(listed)


def site_categories(spark, sf):
    """List templates of every stored site section: the page number becomes a slot."""
    bare = F.regexp_replace("url", r"[?#].*$", "")
    template = F.regexp_replace(F.regexp_replace(bare, r"\.html$|/$", ""), r"[0-9]+$", "{}")
    return table(spark, sf, "pages").select(
        F.regexp_extract("url", SEGMENT, 1).alias("source_domain"), template.alias("template")
    ).distinct().select(
        "source_domain", F.array(F.col("template"), F.concat("template", F.lit("?sort=new"))).alias("link")
    )


CATEGORY_SQL = (
    r"cat AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS source_domain, "
    r"regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '\.html$|/$', ''), '[0-9]+$', '{}') AS template FROM pages)",
    "tpl AS (SELECT source_domain, template FROM cat UNION ALL SELECT source_domain, template || '?sort=new' FROM cat)",
)


@query("crawl_frontier", with_(*CATEGORY_SQL, "SELECT source_domain, template, CAST(page AS INTEGER) AS page, "
       "replace(template, '{}', CAST(page AS VARCHAR)) AS url FROM tpl, range(1, 6) r(page)"))
def crawl_frontier(spark, sf):
    return crawl.crawl_frontier(site_categories(spark, sf))


@query("crawl_frontier_chunked", with_(*CATEGORY_SQL,
       "SELECT source_domain, template, CAST(c AS INTEGER) AS chunk, CAST(w AS INTEGER) AS worker, "
       "CAST((c - 1) * 100 + w * 10 + s AS INTEGER) AS page, "
       "replace(template, '{}', CAST((c - 1) * 100 + w * 10 + s AS VARCHAR)) AS url "
       "FROM cat, range(1, 5) a(c), range(1, 10) b(w), range(0, 10) d(s)"))
def crawl_frontier_chunked(spark, sf):
    templates = site_categories(spark, sf).select("source_domain", F.col("link")[0].alias("template"))
    return crawl.chunked_frontier(templates)


@query("extract_links", with_(*LINKS_SQL, "SELECT page_id, pos, href FROM links"))
def extract_links(spark, sf):
    return crawl.extract_links(texts(spark, sf, "pages", "page_id")).select("page_id", "pos", "href")


@query("extract_table_links", with_(*LINKS_SQL, "SELECT page_id, pos, href, 'day ' || page_id AS first_cell FROM links"))
def extract_table_links(spark, sf):
    """The same links from tables: every list becomes a table with a date cell, whose row and cell ends are left out."""
    table_of = F.col("html")
    for old, new in (("<ul>", "<table><tbody>"), ("</ul>", "</tbody></table>"), ("</li>", "")):
        table_of = F.replace(table_of, F.lit(old), F.lit(new))
    row = F.concat(F.lit('<tr class="a>b"><td>day '), F.col("page_id").cast("string"), F.lit("<td>"))
    pages = texts(spark, sf, "pages", "page_id").withColumn("html", F.replace(table_of, F.lit("<li>"), row))
    return crawl.extract_links(pages, element="tr").select("page_id", "pos", "href", "first_cell")


@query("resolve_urls", with_(*LINKS_SQL, "SELECT page_id, pos, link, link_key FROM keyed"))
def resolve_urls(spark, sf):
    return site_links(spark, sf).select("page_id", "pos", "link", "link_key")


@query("link_page_join", with_(*SELF_SQL, "SELECT page_id, pos, allk.link_key AS link_key, target_id FROM allk LEFT JOIN stored USING (link_key)"))
def link_page_join(spark, sf):
    return crawl.link_page_join(all_links(spark, sf), table(spark, sf, "pages"))


@query("links_to_fetch", with_(*SELF_SQL, "SELECT DISTINCT link_key FROM allk WHERE link_key NOT IN (SELECT link_key FROM stored)"))
def links_to_fetch(spark, sf):
    return crawl.links_to_fetch(all_links(spark, sf), table(spark, sf, "pages"))


@query("extract_title", f"SELECT page_id, {SQL_TITLE} AS title FROM pages")
def extract_title(spark, sf):
    return texts(spark, sf, "pages", "page_id").select("page_id", H.title(F.col("html")).alias("title"))


@query("extract_maintext", f"SELECT page_id, {SQL_N_PARAGRAPHS} AS paragraphs, {SQL_MAINTEXT} AS maintext FROM pages")
def extract_maintext(spark, sf):
    found = texts(spark, sf, "pages", "page_id").select("page_id", H.paragraphs(H.article_node(F.col("html"))).alias("found"))
    return found.select("page_id", F.size("found").alias("paragraphs"), F.array_join("found", "").alias("maintext"))


def page_variants() -> dict:
    """Other ways to write a page that say the same, by name."""
    html = F.col("html")
    swap = lambda *pairs: _swapped(html, pairs)
    return {
        "whole": html,
        "open paragraphs": swap(("</p>", "")),
        "capitals": swap(("<p>", "<P >"), ("</p>", "</P\n>"), ("<article>", "<ARTICLE\n>"), ("</article>", "</Article>")),
        "comments": swap(("<p>", "<p><!-- <p>no</p> </article> -->"), ("<article>", "<!-- <article><p>no</article> --><article>")),
        "quotes": swap(("<p>", "<p title=\"a > b </p>\" data-x='<p>'>")),
        "nested": swap(("<article>", "<article><div><section>"), ("</article>", "</section></div></article>")),
        "inner article": swap(("</article>", "<article><h2>no</h2></article></article><p>no")),
        "stray ends": swap(("<p>", "<p></div></section></article2>")),
        "scripts": swap(("<p>", "<p><script>if (a</p>b) '<p>'</script><style>p > a {}</style>")),
    }


def _swapped(text, pairs):
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def varied(pages, variants: dict):
    return pages.select("page_id", F.explode(F.array(*[
        F.struct(F.lit(name).alias("variant"), html.alias("html")) for name, html in variants.items()
    ])).alias("v")).select("page_id", "v.*")


@query("extract_maintext_variants", with_(
       "names AS (SELECT unnest(['whole', 'open paragraphs', 'capitals', 'comments', 'quotes', 'nested', 'inner article', 'stray ends', 'scripts']) AS variant)",
       f"SELECT page_id, variant, {SQL_N_PARAGRAPHS} AS paragraphs, {SQL_MAINTEXT} AS maintext FROM pages, names"))
def extract_maintext_variants(spark, sf):
    """Pages written in nine ways, with optional end tags left out among others, all give the text of the page as it is."""
    pages = varied(texts(spark, sf, "pages", "page_id").select("page_id", "html"), page_variants())
    found = pages.select("page_id", "variant", H.paragraphs(H.article_node(F.col("html"))).alias("found"))
    return found.select("page_id", "variant", F.size("found").alias("paragraphs"), F.array_join("found", "").alias("maintext"))


@query(
    "normalize_publish_time",
    "SELECT o_orderkey AS id, regexp_replace(trim('2022-' || replace(chr(13) || chr(10) || strftime(o_orderdate, '  %m/%d %H:%M') || chr(10), '/', '-'), "
    "chr(13) || chr(10) || ' '), '[\\n\\r]', '', 'g') AS padded, "
    "'2022-' || strftime(o_orderdate, '%m-%d %H:%M') AS short, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS full, "
    "strftime(try_strptime(strftime(o_orderdate, '2022-%m-%d'), '%Y-%m-%d'), '%Y-%m-%d') AS parsed_day FROM orders",
)
def normalize_publish_time(spark, sf):
    """List dates as ``MM/dd`` padded by line breaks, as ``MM-dd`` and as full dates."""
    at = F.col("o_orderdate")
    padded = F.concat(F.lit("\r\n"), F.date_format(at, "  MM/dd HH:mm"), F.lit("\n"))
    short = X.normalize_publish_time(F.date_format(at, "MM-dd HH:mm"), "2022", only_if_short=True)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        X.normalize_publish_time(padded, "2022").alias("padded"),
        short.alias("short"),
        X.normalize_publish_time(F.date_format(at, "yyyy-MM-dd HH:mm"), "2022", only_if_short=True).alias("full"),
        F.date_format(F.try_to_timestamp(short, F.lit("yyyy-MM-dd HH:mm")), "yyyy-MM-dd").alias("parsed_day"),
    )


# Phrases that overlap and hold each other; each is put in brackets.
PHRASES = {p: f"[{p}]" for p in ("tion", "ement", "ti", "io", "onat", "me", "em")}


@query("convert_script", "SELECT doc_id AS id, translate(regexp_replace(text, "
       f"{quote('|'.join(sorted(PHRASES, key=len, reverse=True)))}, '[\\0]', 'g'), {quote(ACCENTED)}, {quote(FOLDED)}) AS text FROM documents")
def convert_script(spark, sf):
    return documents(spark, sf).select(
        "id", crawl.convert_script(F.col("text"), ACCENTED, FOLDED, PHRASES).alias("text")
    )


@query("assemble_articles", f"SELECT '' AS date_publish, '' AS id, {SQL_MAINTEXT} AS maintext, "
       f"regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS source_domain, url, {SQL_TITLE} AS title FROM pages")
def assemble_articles(spark, sf):
    return crawl.assemble_articles(texts(spark, sf, "pages", "page_id"), F.regexp_extract("url", SEGMENT, 1))


@query("quarantine_bad_records", with_(
       "variants(variant, reason) AS (VALUES ('whole', NULL), ('no title', 'no title'), ('no article', 'no article'), ('hidden article', 'no article'), "
       "('no paragraph', 'no paragraph'), ('open paragraphs', NULL), ('attributes', NULL), ('open article', NULL), ('empty', 'empty page'))",
       "SELECT page_id, variant, reason FROM pages, variants"))
def quarantine_bad_records(spark, sf):
    """Every stored page, whole, written in other legal ways, and damaged in five ways."""
    html = F.col("html")
    damage = {
        "whole": html,
        "no title": F.replace(html, F.lit("<title"), F.lit("<h6")),
        "no article": F.replace(html, F.lit("<article"), F.lit("<div")),
        "hidden article": F.replace(F.replace(html, F.lit("<article"), F.lit("<!-- <article")), F.lit("</article>"), F.lit("</article> -->")),
        "no paragraph": F.replace(F.replace(html, F.lit("<p>"), F.lit("<pre>")), F.lit("</p>"), F.lit("</pre>")),
        "open paragraphs": F.replace(html, F.lit("</p>"), F.lit("")),
        "attributes": F.replace(html, F.lit("<p>"), F.lit('<p class="lead">')),
        "open article": F.replace(html, F.lit("</article>"), F.lit("")),
        "empty": F.lit(" "),
    }
    return crawl.mark_bad_pages(varied(texts(spark, sf, "pages", "page_id").select("page_id", "html"), damage)).drop("html")


@query("assign_category", with_(*CATEGORY_SQL,
       "dim AS (SELECT DISTINCT split_part(template, '/', 4) AS segment, 'domain-' || source_domain AS source_domain FROM tpl)",
       "SELECT page_id, split_part(url, '/', 4) AS segment, dim.source_domain FROM pages LEFT JOIN dim ON dim.segment = split_part(url, '/', 4)"))
def assign_category(spark, sf):
    """Category of every page from the table of list templates: a dimension of its own that the pages are joined to."""
    templates = site_categories(spark, sf).select("source_domain", F.explode("link").alias("template"))
    categories = templates.select(
        F.regexp_extract("template", SEGMENT, 1).alias("segment"), F.concat(F.lit("domain-"), "source_domain").alias("source_domain")
    ).distinct()
    return crawl.assign_category(table(spark, sf, "pages"), categories).select("page_id", "segment", "source_domain")


@query("crawl_job", with_(*SELF_SQL,
       "reached AS (SELECT DISTINCT target_id FROM allk JOIN stored USING (link_key))",
       f"SELECT '' AS date_publish, '' AS id, {SQL_MAINTEXT} AS maintext, "
       f"regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS source_domain, url, {SQL_TITLE} AS title "
       f"FROM pages JOIN reached ON page_id = target_id WHERE {sql_strip('html')} <> '' AND regexp_matches(html, '(?is)<title[^>]*>(.*?)</title>') "
       f"AND regexp_matches(html, '(?is)<article[^>]*>(.*?)</article>') AND {SQL_N_PARAGRAPHS} > 0"))
def crawl_job(spark, sf):
    """From stored pages and their links to one folder of articles per category, read back."""
    out = staging_path(spark, "crawl")
    pages = texts(spark, sf, "pages", "page_id")
    jobs.crawl_articles(pages, all_links(spark, sf), F.regexp_extract("url", SEGMENT, 1), out)
    return spark.read.schema(ARTICLE).parquet(f"{out}/articles").select(*ARTICLE.names)
