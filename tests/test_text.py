"""Edge cases of text, HTML and array expressions on hand-made rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from newsflow.functions import arrays as A
from newsflow.functions import html as H
from newsflow.functions import text as X
from newsflow.operators.crawl import convert_script
from newsflow.operators.encode import PAD_ID


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select(expression(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def test_clean_social(spark):
    texts = ["go {%place%} now", "hi @name rest", "end @name", "a​b", "one @name\ntwo", "{%%} x", "@ab @cd x", "mail@host\n"]
    assert column(spark, texts, "string", X.clean_social) == [
        "go   now", "hi  rest", "end  ", "a b", "one @name\ntwo", "{%%} x", "  x", "mail \n",
    ]


def test_strip_unicode_space(spark):
    assert column(spark, ["　x y \n", "\t", "", None], "string", X.strip) == ["x y", "", "", None]
    assert column(spark, ["", " \t", None, "x"], "string", X.is_blank) == [True, True, True, False]


def test_words_and_pattern_tokens(spark):
    assert column(spark, ["Ab1c Déjà", "油價 上涨 x"], "string", X.words) == [["ab", "c", "déjà"], ["油", "價", "上", "涨", "x"]]
    assert column(spark, ["[Tag] ab_1, 油價!", "!!"], "string", X.pattern_tokens) == [["[tag]", "ab_1", "油價"], []]


def slow_negation(tokens, negators):
    tokens = list(tokens)
    out = []
    while tokens:
        head = tokens.pop(0)
        out.append(head + tokens.pop(0) if head in negators and tokens else head)
    return " ".join(out)


def test_merge_negation(spark):
    for negators in (("不",), ("not", "no")):
        words = ["x", "y", *negators]
        cases = [list(c) for n in range(5) for c in itertools.product(words, repeat=n)]
        got = column(spark, cases, "array<string>", lambda c: X.merge_negation(c, negators))
        assert got == [slow_negation(c, negators) for c in cases]


def test_sentences(spark):
    texts = ["One. Two! Three", "Pi is 3.14 ok. Next", "他说。「好！」走？", "  ", 'He said "go." Then left.']
    assert column(spark, texts, "string", X.sentences) == [
        ["One.", "Two!", "Three"], ["Pi is 3.14 ok.", "Next"], ["他说。", "「好！", "」走？"], [],
        ['He said "go."', "Then left."],
    ]
    assert column(spark, [" A. B "], "string", X.one_sentence_per_line) == ["A.\nB"]


def test_ngrams(spark):
    texts = [["a", "b", "c", "d"], ["a"], []]
    for n in (1, 2, 3):
        expected = [[" ".join(t[i:i + n]) for i in range(len(t) - n + 1)] for t in texts]
        assert column(spark, texts, "array<string>", lambda c, n=n: X.ngrams(c, n)) == expected


def test_publish_time(spark):
    padded = ["\r\n 12/20 10:30\r\n", "12/20 10:30"]
    assert column(spark, padded, "string", lambda c: X.normalize_publish_time(c, "2022")) == [
        "2022- 12-20 10:30", "2022-12-20 10:30",
    ]
    dashed = ["12-20 10:30", "2021-12-20 10:30", "no date"]
    assert column(spark, dashed, "string", lambda c: X.normalize_publish_time(c, "2022", only_if_short=True)) == [
        "2022-12-20 10:30", "2021-12-20 10:30", "no date",
    ]


def test_convert_script(spark):
    got = column(spark, ["汉语软件", "软"], "string", lambda c: convert_script(c, "汉语软", "漢語軟", {"软件": "軟體"}))
    assert got == ["漢語軟體", "軟"]


def test_html(spark):
    page = (
        "<html><title> A &amp;lt; B </title><ul><li>head</li><li><a class='k' href=\"/x\">x</a></li><li>none</li></ul>"
        "<p>outside</p><article><p>one <b>two</b></p><p>open<p>three&nbsp;</p></article></html>"
    )
    assert column(spark, [page, "<p>x</p>"], "string", H.title) == ["A &lt; B", ""]
    assert column(spark, [page, "<p>x</p>"], "string", H.maintext) == ["one twoopenthree\xa0", ""]
    assert column(spark, [page], "string", lambda c: F.transform(H.list_rows(c), H.first_href)) == [[None, "/x", None]]


def test_urls(spark):
    base = F.lit("https://Site.org/a/b?q=1")
    hrefs = ["/x", "x", "//cdn.org/y", "http://o.net/z"]
    assert column(spark, hrefs, "string", lambda c: H.resolve_url(base, c)) == [
        "https://Site.org/x", "https://Site.org/x", "https://cdn.org/y", "http://o.net/z",
    ]
    urls = ["https://Site.org/a/?q=1#t", "http://site.org/a", "https://site.org"]
    assert column(spark, urls, "string", H.normalize_url) == ["site.org/a", "site.org/a", "site.org"]


def test_argmax_takes_first(spark):
    assert column(spark, [[1.0, 3.0, 3.0], [-1.0]], "array<double>", A.argmax) == [1, 0]


def slow_pair(n1, n2, limit):
    while n1 + n2 > limit:
        if n1 > n2:
            n1 -= 1
        else:
            n2 -= 1
    return n1, n2


def test_pair_lengths(spark):
    cases = [(a, b, m) for m in (0, 1, 5, 6) for a in range(9) for b in range(9)]
    for limit in (1, 5, 6):
        rows = [(a, b) for a, b, m in cases if m == limit]
        df = spark.createDataFrame([([0] * a, [0] * b) for a, b in rows], "a array<int>, b array<int>")
        keep = A.pair_lengths(F.col("a"), F.col("b"), limit)
        got = {(r[0], r[1]): (r[2], r[3]) for r in df.select(F.size("a"), F.size("b"), *keep).collect()}
        assert got == {(a, b): slow_pair(a, b, limit) for a, b in rows}


def test_padding(spark):
    ids = [[5, 6], [], [1, 2, 3]]
    assert column(spark, ids, "array<int>", lambda c: A.pad(c, F.lit(3), PAD_ID)) == [[5, 6, 0], [0, 0, 0], [1, 2, 3]]
    assert column(spark, ids, "array<int>", lambda c: A.attention_mask(c, F.lit(3))) == [[1, 1, 0], [0, 0, 0], [1, 1, 1]]
    assert column(spark, [[5, 0]], "array<int>", lambda c: A.swap_value(c, 0, -100)) == [[5, -100]]
    assert column(spark, [1, 8, 9], "int", lambda c: A.round_up(c, 8)) == [8, 8, 16]


@pytest.mark.parametrize("size", [0, 3])
def test_truncate(spark, size):
    assert column(spark, [[1, 2, 3, 4]], "array<int>", lambda c: A.truncate(c, size)) == [[1, 2, 3, 4][:size]]
