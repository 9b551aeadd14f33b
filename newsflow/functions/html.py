"""HTML extraction, JVM-side: markup is cut at its tags, and one fold over the tags with a stack of open elements finds paragraphs.

End tags that the language lets authors leave out are optional here too: a paragraph ends at ``</p>``, where the next block begins, where an
element around it ends, or with the text. Comments, scripts and styles hold no text; an end tag without an open element is ignored;
an angle bracket that begins no tag is text; ``>`` inside a quoted attribute value ends no tag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow.functions.text import strip

# ---------------------------------------------------------------------------
# Markup patterns and entities.
# ---------------------------------------------------------------------------
# What follows a tag's name up to its end: quoted values may hold anything.
_REST = r"""(?=[\s/>])(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)" + _REST + r".*?(?:</\1\s*>|\z)"
# Elements that end an open paragraph where they begin.
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu",
    "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
BLOCK_TAG = "(?is)</?(?:" + "|".join(BLOCKS) + ")" + _REST
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
NUMERIC = r"&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
TAG = r"(?s)</?[A-Za-z][^\s/>]*+" + _REST + r"|<[!?][^>]*>"
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", "\xa0"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)
# ---------------------------------------------------------------------------


def decode_entities(text: Column) -> Column:
    """Decode numeric entities and the named ones of the pages; ``&amp;`` last so it is decoded once."""
    text = F.when(F.regexp_count(text, F.lit(NUMERIC)) > 0, _decode_numeric(text)).otherwise(text)
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _decode_numeric(text: Column) -> Column:
    """Numeric entities as UTF-8; a number that is no character becomes U+FFFD."""

    def decoded(code: Column) -> Column:
        number = F.when(F.lower(F.substring(code, 1, 1)) == "x", F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).cast("int")
        valid = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
        # UTF-32 of the number, read as text.
        points = F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0"))
        return F.decode(points, "UTF-32")

    codes = F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(1))
    parts = F.split(text, NUMERIC, -1)
    glued = F.transform(parts, lambda part, i: F.when(F.get(codes, i).isNull(), part).otherwise(F.concat(part, decoded(F.get(codes, i)))))
    return F.array_join(glued, "")


def text_of(markup: Column) -> Column:
    """Text content of a piece of markup."""
    return decode_entities(F.regexp_replace(markup, TAG, ""))


def title(html: Column) -> Column:
    """Stripped text of the first title element, empty when there is none."""
    return strip(text_of(F.regexp_extract(html, TITLE, 1)))


def visible(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(html, HIDDEN, "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def has_element(html: Column, element: str = "article") -> Column:
    return visible(html).rlike(rf"(?is)<{element}{_REST}")


def element_node(html: Column, element: str = "article", marked: str = "") -> Column:
    """Markup inside the first ``element``, up to its own end tag or the end of the page; empty when there is none.

    ``marked`` is a pattern that the opening tag has to hold as well, such as ``id="main"``.
    """
    look = rf"(?=[^>]*{marked})" if marked else ""
    tag = rf"(?is)</?{element}{_REST}"

    def inner(rest: Column) -> Column:
        def own(tags: Column) -> Column:
            # The tag at which as many have ended as begun.
            start = F.struct(F.lit(1).alias("open"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

            def step(state: Column, t: Column) -> Column:
                depth = state["open"] + F.when(F.startswith(t, F.lit("</")), -1).otherwise(1)
                found = (state["end"] < 0) & (depth == 0)
                return F.struct(depth.alias("open"), (state["at"] + 1).alias("at"), F.when(found, state["at"]).otherwise(state["end"]).alias("end"))

            end = F.aggregate(tags, start, step)["end"]
            parts = F.split(rest, tag, -1)
            glued = lambda last: F.concat_ws("", F.transform(F.slice(parts, 1, last + 1), lambda x, i: F.concat(x, F.when(i < last, F.get(tags, i)).otherwise(F.lit("")))))
            return F.when(F.size(tags) == 0, rest).otherwise(_let(F.when(end < 0, F.size(tags)).otherwise(end), glued))

        return _let(F.regexp_extract_all(rest, F.lit(tag), F.lit(0)), own)

    node = _let(F.regexp_extract(visible(html), rf"(?is)<{element}{look}{_REST}(.*)", 1), inner)
    return F.when(html.isNotNull(), node)


def article_node(html: Column) -> Column:
    return element_node(html, "article")


def paragraphs(markup: Column) -> Column:
    """Text of every paragraph, in order of their beginnings.

    One fold over the block tags: the state is the stack of open blocks, the markup of the open paragraph (null without one) and the paragraphs so far.
    """
    nothing = F.lit(None).cast("string")

    def fold(cut: Column) -> Column:
        parts, tags = cut["parts"], cut["tags"]
        events = F.transform(tags, lambda t, i: F.struct(
            F.lower(F.regexp_extract(t, r"^</?([A-Za-z0-9]+)", 1)).alias("name"), F.startswith(t, F.lit("</")).alias("ends"), F.get(parts, i + 1).alias("text"),
        ))
        start = F.struct(F.array().cast("array<string>").alias("stack"), nothing.alias("now"), F.array().cast("array<string>").alias("done"))

        def step(state: Column, e: Column) -> Column:
            stack, now, done = state["stack"], state["now"], state["done"]
            is_p = e["name"] == "p"
            back = F.array_position(F.reverse(stack), e["name"])
            stray = e["ends"] & F.when(is_p, now.isNull()).otherwise(back == 0)
            opened = F.when(is_p | (e["name"] == "hr"), stack).otherwise(F.concat(stack, F.array(e["name"])))
            closed = F.when(is_p, stack).otherwise(F.slice(stack, F.lit(1), F.size(stack) - back.cast("int")))
            return F.struct(
                F.when(stray, stack).when(e["ends"], closed).otherwise(opened).alias("stack"),
                F.when(stray, F.concat(now, e["text"])).when(is_p & ~e["ends"], e["text"]).otherwise(nothing).alias("now"),
                F.when(stray | now.isNull(), done).otherwise(F.concat(done, F.array(now))).alias("done"),
            )

        return F.aggregate(events, start, step, lambda state: F.when(state["now"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["now"]))))

    seen = visible(markup)
    cut = F.struct(F.split(seen, BLOCK_TAG, -1).alias("parts"), F.regexp_extract_all(seen, F.lit(BLOCK_TAG), F.lit(0)).alias("tags"))
    return F.when(markup.isNotNull(), F.transform(_let(cut, fold), text_of))


def maintext(html: Column, element: str = "article", marked: str = "") -> Column:
    """Paragraph texts of the article node, joined without a separator."""
    return F.array_join(paragraphs(element_node(html, element, marked)), "")


def list_rows(html: Column, element: str = "li") -> Column:
    """Markup of every row of a list (``li``) or a table (``tr``), whose end tags may be left out."""
    outer = {"li": "ul|ol|menu", "tr": "table|tbody|thead|tfoot"}.get(element, "table|ul|ol")
    row = rf"(?is)<{element}{_REST}(.*?)(?=</?{element}[\s/>]|</?(?:{outer})[\s/>]|\z)"
    return F.regexp_extract_all(visible(html), F.lit(row), F.lit(1))


def cells(row: Column) -> Column:
    """Texts of a table row's cells."""
    cell = rf"(?is)<t[dh]{_REST}(.*?)(?=</?t[dhr][\s/>]|\z)"
    return F.transform(F.regexp_extract_all(row, F.lit(cell), F.lit(1)), text_of)


def first_href(markup: Column) -> Column:
    """First link target, NULL when the row has no link."""
    return F.nullif(F.concat(*[F.regexp_extract(markup, HREF, k) for k in (1, 2, 3)]), F.lit(""))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute address of ``href`` as seen from the page at ``base``."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .otherwise(F.concat(root, F.lit("/"), href))
    )


def normalize_url(url: Column) -> Column:
    """Join key of an address: no fragment, query, trailing slash or scheme, lower-case host."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]+)", 1))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+(/.*)?$", 1)
    return F.concat(host, F.regexp_replace(path, r"/+$", ""))
