"""Text expressions: cleaning, tokens, sentences, n-grams. All JVM-side.

Character classes are spelled out (``\\p{L}\\p{N}_``) because Java's ``\\w`` is
ASCII-only while news text is not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# White space, token and clean-up patterns that results depend on.
# ---------------------------------------------------------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BRACKETED_WORD = r"\[?[\p{L}\p{N}_]+\]?"
HAN = r"\x{3005}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
CJK_OR_WORD = rf"[\p{{L}}&&[^{HAN}]]+|[{HAN}]"
PLACE_OR_TOPIC = r"(?d)\{%.+?%\}"
MENTION = r"(?d)@.+?( |$)"
ZERO_WIDTH_SPACE = "\u200b"
SENTENCE = r"""(?s).+?(?:[.!?]+["'”’)\]]*(?:\s+|\z)|[。！？]+["'”’)\]]*|\z)"""
# ---------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for NULL, empty and white-space-only text."""
    return F.coalesce(strip(text), F.lit("")) == ""


def clean_social(text: Column) -> Column:
    """Replace ``{%...%}`` marks, ``@name`` mentions and zero-width spaces by one space each."""
    for pattern in (PLACE_OR_TOPIC, MENTION, ZERO_WIDTH_SPACE):
        text = F.regexp_replace(text, pattern, " ")
    return text


def words(text: Column, lower: bool = True) -> Column:
    """Alphabetic tokens; runs of Han characters become one token per character."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(CJK_OR_WORD), F.lit(0))


def pattern_tokens(text: Column) -> Column:
    """Lower-cased tokens of letters, digits and ``_``, keeping an enclosing ``[tag]``."""
    return F.regexp_extract_all(F.lower(text), F.lit(BRACKETED_WORD), F.lit(0))


def merge_negation(tokens: Column, negators: tuple[str, ...]) -> Column:
    """Glue each negator to the token after it, left to right; a final one stays alone.

    Tokens hold no blanks, so one pass of ``replace`` over the joined string does
    the left-to-right pairing in linear time.
    """
    alternatives = "|".join(r"\Q" + n + r"\E" for n in negators)
    joined = F.array_join(tokens, " ")
    return F.regexp_replace(joined, f"(^| )({alternatives}) ([^ ]+)", "$1$2$3")


def sentences(text: Column) -> Column:
    """Sentences of ``text``: cut after ``.!?`` before white space and after any of ``。！？``."""
    pieces = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def one_sentence_per_line(text: Column) -> Column:
    """Strip, split into sentences and join them with line breaks."""
    return F.array_join(sentences(strip(text)), "\n")


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined token n-grams, empty when the text is shorter than ``n``.

    The token array is zipped with itself shifted by one, so pass a materialised
    column rather than an expensive expression.
    """
    grams = tokens
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    for shift in range(1, n):
        grams = F.zip_with(
            F.slice(grams, 1, count), F.slice(tokens, shift + 1, count), lambda a, b: F.concat_ws(" ", a, b)
        )
    return grams


def fold_characters(text: Column, source: str, target: str) -> Column:
    """Map characters one to one (script conversion with a single-character table)."""
    return F.translate(text, source, target)


def normalize_publish_time(raw: Column, year: str, only_if_short: bool = False) -> Column:
    """``MM/dd ...`` to ``year-MM-dd ...``.

    The year is put before the text is stripped, so blanks in front of the month
    survive inside the result. ``only_if_short`` prefixes only texts with exactly
    one ``-`` and leaves the rest alone.
    """
    if only_if_short:
        dashes = F.length(raw) - F.length(F.replace(raw, F.lit("-"), F.lit("")))
        return F.when(dashes == 1, F.concat(F.lit(year + "-"), raw)).otherwise(raw)
    dated = F.concat(F.lit(year + "-"), F.replace(raw, F.lit("/"), F.lit("-")))
    return F.regexp_replace(strip(dated), r"[\n\r]", "")


def seeded_hash(seed: int, key: Column) -> Column:
    """Deterministic pseudo-random hex order key of a row id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
