"""Quality by weak supervision, with DataFrame and SQL functions only.

Simple rules over a text's statistics vote good (1) or bad (-1) or abstain (0). Nobody labels anything:
expectation-maximisation over the counts of all vote patterns estimates how often each rule is right on good
and on bad texts, and the posterior probability of being good decides, instead of all rules having
to pass. There are at most 3^rules patterns, whatever the size of the table; each step is one aggregate over them.

Statistics are computed inside the row, so texts don't move. Words in repeated five-word windows are found by
sorting one number per window (hash and place) and comparing the windows themselves where hashes meet.

Defined results: null text has no words; a text without words fails; a division by nothing gives no vote; repeated
rows are judged one by one and count as often as they occur; an empty table gives no rows. Input columns named like
a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.common import SPACE, query, stage, table, without

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
STEPS = 50

#: Bits of a window's place; with one code point each and a space between, a text of 2 GB has fewer words.
_PLACE = (1 << 30) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """How many words lie in a window of ``WINDOW`` words that occurs twice or more."""
    last = F.size(words) - WINDOW
    places = F.when(last > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def number(i: Column) -> Column:
        digest = F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
        return digest.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))

    def hash_of(x: Column) -> Column:
        return F.shiftright(x, 30)

    def candidates(numbers: Column) -> Column:
        """Places whose hash occurs again."""
        def meets(x: Column, i: Column) -> Column:
            own = hash_of(x)
            return F.coalesce(hash_of(F.get(numbers, i + 1)) == own, F.lit(False)) | F.coalesce(hash_of(F.get(numbers, i - 1)) == own, F.lit(False))

        return F.transform(F.filter(numbers, meets), lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int"))

    def windows(at: Column) -> Column:
        return F.sort_array(F.transform(at, lambda p: F.struct(F.array_join(F.slice(words, p + 1, WINDOW), " ").alias("w"), p.alias("p"))))

    def doubles(pairs: Column) -> Column:
        """Places of windows that really occur again, in order."""
        def again(x: Column, i: Column) -> Column:
            return F.coalesce(F.get(pairs, i + 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(pairs, i - 1)["w"] == x["w"], F.lit(False))

        return F.sort_array(F.transform(F.filter(pairs, again), lambda x: x["p"]))

    def covered(at: Column) -> Column:
        """A window adds the words up to the next window's start, ``WINDOW`` at most."""
        added = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(added, F.lit(0).cast("long"), lambda n, x: n + x)

    numbers = F.sort_array(F.transform(places, number))
    return let(numbers, lambda s: let(windows(candidates(s)), lambda p: let(doubles(p), covered)))


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all, if None) with the counts that the rules are about."""
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_symbol_runs")
    columns = without(docs.select(keep) if keep is not None else docs, *names)
    body = F.coalesce(F.col(text), F.lit(""))
    words = let(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
    ))
    lines = let(F.filter(F.split(body, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ))
    # Under names of their own, whatever the other columns are called.
    inner = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    counted = docs.select(
        *inner, words.alias("_words"), lines.alias("_lines"),
        F.length(F.translate(body, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]+")).cast("long").alias("n_symbol_runs"),
    )
    return counted.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("_words")["n_words"].alias("n_words"), "word_chars", "n_symbols", F.col("_lines")["n_lines"].alias("n_lines"),
        F.col("_lines")["n_dup_lines"].alias("n_dup_lines"), F.col("_words")["n_repeat_words"].alias("n_repeat_words"),
        F.col("_words")["n_distinct"].alias("n_distinct"), "n_symbol_runs",
    )


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def rules() -> dict[str, tuple[Column, Column]]:
    """Name -> (votes good, votes bad); neither or null abstains."""
    length, symbols, repeats = _ratio("word_chars", "n_words"), _ratio("n_symbols", "n_words"), _ratio("n_repeat_words", "n_words")
    runs, density = _ratio("n_symbol_runs", "n_words"), _ratio("n_symbols", "word_chars")
    lines, distinct = _ratio("n_dup_lines", "n_lines"), _ratio("n_distinct", "n_words")
    return {
        "enough_words": (F.col("n_words") >= 50, F.col("n_words") < MIN_WORDS),
        "word_length": (length.between(3, 10), (length < 2) | (length > 15)),
        "symbols": (symbols <= 0.02, symbols > 0.1),
        "symbol_runs": (runs <= 0.02, runs > 0.1),
        "symbol_density": (density <= 0.01, density > 0.04),
        "lines": (lines <= 0.1, lines > 0.5),
        "windows": (repeats <= 0.05, repeats > MAX_REPEAT_PERCENT / 100),
        "vocabulary": (distinct >= 0.5, distinct < 0.12),
    }


def votes(counted: DataFrame, ruled: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``counted`` with a column ``vote_<rule>`` per rule."""
    return counted.withColumns({
        f"vote_{name}": F.when(F.coalesce(bad, F.lit(False)), -1).when(F.coalesce(good, F.lit(False)), 1).otherwise(0) for name, (good, bad) in ruled.items()
    })


#: Start of the estimate: share of good texts; chance that a voting rule is right on good and on bad ones.
START = (0.9, 0.99, 0.5)
#: A rule is right on this share of good texts at least, and not useless on bad ones: keeps the two classes apart.
LEAST_GOOD, LEAST_BAD = 0.95, 0.05


def log_odds(prior: Column, good: Column, bad: Column, vote: Callable[[int], Column], n_rules: int) -> Column:
    """Log-odds of a good text; rules that abstain say nothing."""
    total = F.ln(prior / (1 - prior))
    for k in range(n_rules):
        right, caught = F.get(good, F.lit(k)), F.get(bad, F.lit(k))
        total = total + F.when(vote(k) == 1, F.ln(right / (1 - caught))).when(vote(k) == -1, F.ln((1 - right) / caught)).otherwise(0.0)
    return total


def estimate(voted: DataFrame, names: list[str], steps: int = STEPS) -> DataFrame:
    """``(prior, good, bad)`` in one row: share of good texts, and per rule its accuracy on good and on bad texts.

    Expectation-maximisation over the counts of the vote patterns of all rows, as one expression. Patterns are sorted, so
    sums don't depend on how rows came. A text of each kind is added to every count, so no chance becomes 0.
    """
    n = len(names)
    vote = F.array(*[F.col(f"vote_{x}") for x in names])
    counts = voted.groupBy(vote.alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    patterns = counts.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("patterns"))

    def total(weights: Column, keep: Callable[[Column], Column] | None = None) -> Column:
        """Sum of the weights, of those patterns that ``keep`` takes."""
        def one(w: Column, i: Column) -> Column:
            return w if keep is None else F.when(keep(F.get("patterns", i)["v"]), w).otherwise(0.0)

        return F.aggregate(F.transform(weights, one), F.lit(0.0), lambda acc, w: acc + w)

    def maximised(good: Column, bad: Column) -> Column:
        """New state from the good and the bad share of every pattern's count."""
        at = lambda k: (lambda v: F.get(v, F.lit(k)))
        right, caught = [], []
        for k in range(n):
            v = at(k)
            right.append(F.greatest(F.lit(LEAST_GOOD), (total(good, lambda x, v=v: v(x) == 1) + 1) / (total(good, lambda x, v=v: v(x) != 0) + 2)))
            caught.append(F.greatest(F.lit(LEAST_BAD), (total(bad, lambda x, v=v: v(x) == -1) + 1) / (total(bad, lambda x, v=v: v(x) != 0) + 2)))
        prior = (total(good) + 1) / (total(good) + total(bad) + 2)
        return F.struct(prior.alias("prior"), F.array(*right).alias("good"), F.array(*caught).alias("bad"))

    def step(state: Column, _: Column) -> Column:
        shares = F.transform("patterns", lambda p: F.lit(1.0) / (F.lit(1.0) + F.exp(
            -log_odds(state["prior"], state["good"], state["bad"], lambda k: F.get(p["v"], F.lit(k)), n)
        )))
        good = F.transform(shares, lambda z, i: z * F.get("patterns", i)["n"])
        return let(good, lambda g: let(F.transform(g, lambda w, i: F.get("patterns", i)["n"] - w), lambda b: maximised(g, b)))

    start = F.struct(
        F.lit(START[0]).alias("prior"), F.array_repeat(F.lit(START[1]), n).alias("good"), F.array_repeat(F.lit(START[2]), n).alias("bad")
    )
    return patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("state")).select("state.*")


def judge(counted: DataFrame, least: float = 0.5) -> DataFrame:
    """Stored ``counted`` rows with the votes, ``posterior``, ``base_failed`` and ``kept``."""
    ruled = rules()
    taken = [*(f"vote_{name}" for name in ruled), "posterior", "base_failed", "kept"]
    voted = votes(counted.select(without(counted, *taken)), ruled)
    prior, good, bad = estimate(voted, list(ruled)).first()
    odds = log_odds(F.lit(prior), F.array(*map(F.lit, good)), F.array(*map(F.lit, bad)), lambda k: F.col(f"vote_{list(ruled)[k]}"), len(ruled))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    return voted.withColumn("posterior", posterior).withColumn("base_failed", failed).withColumn("kept", ~failed & (posterior >= least))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stage(statistics(table(spark, sf_dir, "documents"), keep=["doc_id"]), "statistics")
    return judge(counted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
