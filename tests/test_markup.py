"""Markup variants that the supplied pages don't hold."""

import pytest
from pyspark.sql import functions as F

from newsflow.functions import html as H
from newsflow.operators import crawl


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("markup,expected", [
    ('<p class="a">x</p><p>y</p>', ["x", "y"]), ("<pre>no</pre><P\nid=1>z</P>", ["z"]), ("<param><p >q</p>", ["q"]), ("plain", []),
])
def test_paragraphs(spark, markup, expected):
    assert one(spark, markup, H.paragraphs) == expected


@pytest.mark.parametrize("markup,expected", [
    ("<a href='/1'>x</a>", "/1"), ("<a class=b href=/2>x</a>", "/2"), ('<a data-href="no" href = "/3">', "/3"), ("<abbr href='/no'>", None), ("<a name=x>", None),
])
def test_links(spark, markup, expected):
    assert one(spark, markup, H.first_href) == expected


def test_list_rows_are_not_links(spark):
    assert one(spark, '<link rel="x"><li class=a>1</li><LI>2</LI>', H.list_rows) == ["1", "2"]


@pytest.mark.parametrize("text,expected", [
    ("a&#38;b &#x4E2d;&#20013; &#128077;", "a&b 中中 👍"), ("&#0; &#xD800; &#1114112;", "� � �"), ("&amp;#38; &lt;", "&#38; <"), ("no", "no"),
])
def test_numeric_entities(spark, text, expected):
    assert one(spark, text, H.decode_entities) == expected


def test_good_page_with_attributes(spark):
    page = "<html><title>T</title><article><p class='lead'>text</p></article></html>"
    df = spark.createDataFrame([(1, page)], "page_id bigint, html string")
    assert crawl.mark_bad_pages(df).first()["reason"] is None


@pytest.mark.parametrize("markup,expected", [
    ("<p>a<p>b", ["a", "b"]), ("<div><p>a</div>out<p>b", ["a", "b"]), ("<p>a<ul><li>x</ul>y<p>b", ["a", "b"]), ("<p>a</div>b</p>c", ["ab"]), ("</p><p>a</span></p>", ["a"]),
    ("<p>a<b>b<i>c</p>d", ["abc"]), ("<p>1 < 2 & a<3</p>", ["1 < 2 & a<3"]), ("<p title='>'>a</p>", ["a"]), ("<p title=it's>a</p><p>b's</p>", ["a", "b's"]), ("<p/>a<hr>b", ["a"]),
    ("<p><!-- </p> -->a</p><!-- <p>no", ["a"]), ("<script>'<p>no</p>'</script><p>a<STYLE>p{}</style>b", ["ab"]), ("<p></p><p> </p>", ["", " "]), ("", []), (None, None),
    ("<p>x</p>" * 3_000, ["x"] * 3_000), ("<p>" + "long " * 300_000, ["long " * 300_000]), ("<p " + 'a="b" ' * 3_000 + ">x", ["x"]),
])
def test_paragraphs_with_open_ends(spark, markup, expected):
    assert one(spark, markup, H.paragraphs) == expected


@pytest.mark.parametrize("html,expected", [
    ("<article><p>a<p>b</article><p>c", "ab"), ("<article><p>a<article><p>b</article><p>c</article><p>d", "abc"), ("<p>0<ARTICLE class=x><p>a", "a"), ("<articles><p>a</articles>", ""),
    ("<!-- <article><p>0</article> --><article><p>a</article>", "a"), ("<article><p>a</article><article><p>b</article>", "a"), ("none", ""), (None, None),
])
def test_article_text(spark, html, expected):
    assert one(spark, html, H.maintext) == expected


def test_article_in_a_marked_element(spark):
    page = '<div><p>no</div><div class="main body" id=x><p>a<div><p>b</div></div><div class="main"><p>c</div>'
    assert one(spark, page, lambda c: H.maintext(c, "div", r'class="[^"]*\bmain\b')) == "ab"


@pytest.mark.parametrize("html,expected", [
    ("<table><tr><th>h<tr><td> 1/2 <td><a href=x>t</a></table>", ["<th>h", "<td> 1/2 <td><a href=x>t</a>"]),
    ("<table><TR class='>'><td>1</td></tr><tr></tr></table>after", ["<td>1</td>", ""]), ("<track><table>", []),
])
def test_table_rows(spark, html, expected):
    assert one(spark, html, lambda c: H.list_rows(c, "tr")) == expected


def test_links_of_table_rows(spark):
    page = "<table><tr><th>date<th>title<tr><td>12/20 10:30<td><a href=/1>x</a><tr><td>12/21<td>no link<tr><td>12/22</td><td><a href=/2>y</a></td></tr></table>"
    rows = crawl.extract_links(spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string"), element="tr").collect()
    assert [(r["pos"], r["href"], r["first_cell"]) for r in rows] == [(1, "/1", "12/20 10:30"), (3, "/2", "12/22")]


@pytest.mark.parametrize("body,reason", [
    ("<article><p>a<p>b</article>", None), ("<article><p>a", None), ("<article>text</article>", "no paragraph"), ("<!-- <article><p>a</article> -->", "no article"),
])
def test_reasons(spark, body, reason):
    df = spark.createDataFrame([(1, f"<title>t</title>{body}")], "page_id bigint, html string")
    assert crawl.mark_bad_pages(df).first()["reason"] == reason
