"""Mixing sources to target weights, with DataFrame and SQL functions only.

Texts of a source are packed, in an order that a hash of the id gives, into blocks of
``BLOCK`` words. The mix is a row of slots, one block each, dealt over output shards of
``SHARD_SLOTS`` slots:

1. every slot draws its source by weight, so each shard's source counts are multinomial; draws
   beyond a source's share of the whole mix go, in slot order, to sources that were drawn too rarely,
   so each source ends with the number of blocks that its target asks for;
2. the j-th slot of a source of n blocks gets block ``permutation(j mod n)`` of pass ``j div n``. The
   permutation (an unbalanced Feistel network with modular sums, another one for each source and pass) is computed from the
   number alone: every block comes once before any comes twice;
3. slots and packed texts meet in a join by (source, block).

Targets are ``TOTAL`` times all words, shared by the weights 3, 1, 2, 3, 1, 2 ... of the sources by
code point (null last); a source stops at ``MOST`` times its own words and the rest is shared again.

No step holds more than a bucket of ``BUCKET`` rows, a shard's slots, or the list of sources
together, so hot sources cost nothing extra. The order within a source depends on ids alone.

Defined results: null text has no words; texts without words take part with 0 words taken;
rows that repeat an id are rows of their own (equal ones may exchange their results); an empty
table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.llm.common import query, stage, table

BLOCK = 64
SHARD_SLOTS = 4096
BUCKET = 1024
TOTAL = 1.5
MOST = 2
WEIGHTS = (3, 1, 2)
ROUNDS = 4
WORD = r"[^\x20\x09-\x0D]+"
#: Buckets that one running sum goes over before sums of sums take over.
_CHUNK = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Stored rows ``(row, doc_id, source, size)``."""
    return stage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        n_words(F.col(text)).alias("size"),
    ), "measured")


def targets(sized: DataFrame, total: float = TOTAL, most: int = MOST, weights: tuple = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """Per source, stored: number ``sid``, words, target, blocks ``n`` and blocks to draw ``q``.

    Window functions without a partition run over one row per source here.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = numbered.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = capped.withColumn("level", level).withColumn("free", F.col("cap") / F.col("weight") > F.col("level"))
    # The level of the first source that stays below its limit holds for all that do.
    final = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "sid", "level"))).over(everything)["level"]
    target = F.when(F.col("free"), final * F.col("weight")).otherwise(F.col("cap"))
    n = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    q = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n") / F.col("source_size"))).otherwise(0).cast("long")
    done = levelled.withColumn("target", target).withColumn("n", n).withColumn("q", q)
    return stage(done.select("sid", "source", "source_size", "target", "n", "q"), "targets")


def packed(sized: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(sid, block, row, first, words)``: the words of each row that lie in each block of its source."""
    n_rows = sized.count()
    buckets = max(1, -(-n_rows // BUCKET))
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    place = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long")
    rows = (
        sized.filter("size > 0").join(sources.select("sid", F.col("source").alias("name")), F.col("source").eqNullSafe(F.col("name")))
        .select("sid", "row", "doc_id", "size", mark.alias("mark"))
        .withColumn("bucket", F.floor(place * F.lit(buckets) / F.lit(float(1 << 32))).cast("long"))
    )
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).withColumn("chunk", F.floor(F.col("bucket") / _CHUNK))
    chunks = sums.groupBy("sid", "chunk").agg(F.sum("words").alias("words"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("sid", "chunk", F.coalesce(F.sum("words").over(earlier(Window.partitionBy("sid").orderBy("chunk"))), F.lit(0)).alias("far"))
    near = F.coalesce(F.sum("words").over(earlier(Window.partitionBy("sid", "chunk").orderBy("bucket"))), F.lit(0))
    offsets = sums.withColumn("near", near).join(chunks, ["sid", "chunk"]).select("sid", "bucket", (F.col("near") + F.col("far")).alias("offset"))
    inside = earlier(Window.partitionBy("sid", "bucket").orderBy("mark", "doc_id", "size", "row"))
    at = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["sid", "bucket"])
    at = at.select("sid", "row", "size", (F.col("offset") + F.col("inside")).alias("start"))
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    blocks = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return blocks.select("sid", "block", "row", (low - F.col("start")).alias("first"), (high - low).alias("words"))


def located(df: DataFrame, x: str, intervals: DataFrame, total: int) -> DataFrame:
    """Join ``df`` to the one interval [lo, hi) of [0, total) that holds ``x``.

    The line is cut into about four cells per interval, so this is a join by cell number with few intervals each.
    """
    width = max(1, total // (4 * max(16, intervals.count())))
    cells = intervals.filter("hi > lo").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
    )
    at = F.col(x)
    return df.withColumn("cell", F.floor(at / width)).join(cells, "cell").filter((at >= F.col("lo")) & (at < F.col("hi"))).drop("cell", "lo", "hi")


#: Rounds of the permutation, each of two steps on a grid of ``wide`` x ``high`` places.
_PRIME = 2147483647


def _scattered(value: str, salt: int) -> str:
    """SQL of a number below 2^31 that looks random; every product stays below 2^63."""
    t = f"(({value} + sid * 7919 + pass * 104729 + {salt * 15485863 + 12345}) % {_PRIME})"
    return f"(({t} * {t} % {_PRIME} * 48271 + {t} * 69621) % {_PRIME})"


#: The columns of one round, in turn: the place after a shift by a third of n, its column and row in
#: the grid, both moved by what the other one scatters to, and the new place. The fewer than ``wide`` places that the grid
#: leaves over wait for the next round's shift. {div} is whole division.
ROUND = {
    "y": "((x + n {div} 3 + 1) % n)",
    "l": lambda k: f"((y % wide + {_scattered('(y {div} wide)', 2 * k)}) % wide)",
    "r": lambda k: f"((y {{div}} wide + {_scattered('l', 2 * k + 1)}) % high)",
    "x": "CASE WHEN y < wide * high THEN l + wide * r ELSE y END",
}


def round_sql(k: int, div: str) -> dict[str, str]:
    return {name: (v if isinstance(v, str) else v(k)).replace("{div}", div) for name, v in ROUND.items()}


def permuted(df: DataFrame) -> DataFrame:
    """Replace place ``x`` of the pass ``pass`` over source ``sid`` of ``n`` blocks by a block number; one to one."""
    df = df.withColumn("wide", F.floor(F.sqrt("n")).cast("long")).withColumn("high", F.expr("n div wide"))
    for k in range(ROUNDS):
        for name, value in round_sql(k, "div").items():
            df = df.withColumn(name, F.expr(value))
    return df.drop("wide", "high", "y", "l", "r")


def slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``(shard, slot, sid, pass, block)``: the block that every slot of the mix takes."""
    spark = sources.sparkSession
    n_slots = sources.agg(F.sum("q")).first()[0] or 0
    by_sid = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by_sid), F.lit(0))
    lines = sources.select("sid", before("q").alias("lo"), (before("q") + F.col("q")).alias("hi"))
    numbers = spark.range(0, n_slots, 1, max(1, -(-n_slots // (64 * shard_slots)))).withColumnRenamed("id", "slot")
    u = F.conv(F.substring(F.md5(F.concat(F.lit("draw:"), F.col("slot").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double")
    drawn = numbers.withColumn("x", F.floor(u / F.lit(float(1 << 48)) * F.lit(float(n_slots))).cast("long"))
    drawn = located(drawn, "x", lines, n_slots).select("slot", F.floor(F.col("slot") / shard_slots).alias("shard"), "sid")
    # Multinomial counts of every shard, and how often a source was drawn in earlier shards.
    counts = stage(drawn.groupBy("shard", "sid").count(), "draws")
    past = F.coalesce(F.sum("count").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "sid", past.alias("past"))
    own = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1
    ranked = drawn.withColumn("own", own).join(offsets, ["shard", "sid"]).select("shard", "slot", "sid", (F.col("past") + F.col("own")).alias("j"))
    # Draws beyond a source's share, numbered over all sources, fill what others lack.
    share = sources.select("sid", "n", "q").join(counts.groupBy("sid").agg(F.sum("count").alias("c")), "sid", "left").fillna(0, ["c"])
    share = share.withColumn("over", F.greatest(F.col("c") - F.col("q"), F.lit(0))).withColumn("under", F.greatest(F.col("q") - F.col("c"), F.lit(0)))
    share = stage(share.select("sid", "n", "q", "c", before("over").alias("over_before"), before("under").alias("under_before"), "under"), "shares")
    moved_total = share.agg(F.sum("under")).first()[0] or 0
    gaps = share.select(F.col("sid").alias("new"), F.col("c").alias("from"), F.col("under_before").alias("lo"), (F.col("under_before") + F.col("under")).alias("hi"), F.col("under_before").alias("base"))
    placed = ranked.join(share.select("sid", "q", "over_before"), "sid")
    stay = placed.filter("j < q").select("shard", "slot", "sid", "j")
    extra = placed.filter("j >= q").select("shard", "slot", (F.col("over_before") + F.col("j") - F.col("q")).alias("x"))
    moved = located(extra, "x", gaps, moved_total).select("shard", "slot", F.col("new").alias("sid"), (F.col("from") + F.col("x") - F.col("base")).alias("j"))
    numbered = stay.unionByName(moved).join(share.select("sid", "n"), "sid")
    passes = numbered.select("shard", "slot", "sid", "n", F.floor(F.col("j") / F.col("n")).alias("pass"), F.pmod("j", "n").alias("x"))
    # Stored: the plan of the mix, and a bound for the optimiser, which would unfold the rounds into every filter above them.
    return stage(permuted(passes).select("shard", "slot", "sid", "pass", F.col("x").alias("block")), "slots")


def mix(sized: DataFrame, sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``(shard, slot, sid, pass, block, row, first, words)``: the pieces of rows that every slot takes."""
    return slots(sources, shard_slots).join(packed(sized, sources, block), ["sid", "block"])


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` as the mix takes them: a row for each pass that takes words of a document.

    A pass that takes a whole text leaves the row as it is; else the text is the words taken, in order
    and joined by a space, and ``n_chars`` its length. Texts without words stay, once.
    """
    columns = docs.columns
    names = {c.lower(): f"c{i}" for i, c in enumerate(columns)}
    key, body, origin = names[doc_id.lower()], names[text.lower()], names[source.lower()]
    own = stage(docs.select(
        F.monotonically_increasing_id().alias("row"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)],
        n_words(F.col(text)).alias("size"),
    ), "mixed")
    sized = own.select("row", F.col(key).alias("doc_id"), F.col(origin).cast("string").alias("source"), "size")
    taken = mix(sized, targets(sized)).groupBy("row", "pass").agg(
        F.sort_array(F.collect_list(F.struct("first", "words"))).alias("pieces"), F.sum("words").alias("taken")
    )
    words = F.regexp_extract_all(F.col(body), F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(F.col("all_words"), p["first"].cast("int") + 1, p["words"].cast("int")))), " ")
    rows = own.join(taken, "row", "left").filter("taken IS NOT NULL OR size = 0")
    whole = F.col("taken").isNull() | (F.col("taken") == F.col("size"))
    rows = rows.withColumn("all_words", F.when(~whole, words)).withColumn("mixed_text", F.when(whole, F.col(body)).otherwise(part))
    result = []
    for i, c in enumerate(columns):
        value = F.col(f"c{i}")
        if f"c{i}" == body:
            value = F.col("mixed_text")
        elif n_chars is not None and c.lower() == n_chars.lower():
            value = F.when(whole, value).otherwise(F.length("mixed_text")).cast(docs.schema[c].dataType)
        result.append(value.alias(c))
    return rows.select(*result)




def _rounds_sql() -> str:
    """The rounds as common table expressions p0 ... over ``ps``."""
    found, last = ["g0 AS MATERIALIZED (SELECT *, CAST(floor(sqrt(n)) AS BIGINT) AS wide, n // CAST(floor(sqrt(n)) AS BIGINT) AS high FROM ps)"], "g0"
    for k in range(ROUNDS):
        for name, value in round_sql(k, "//").items():
            old = f" EXCLUDE ({name})" if name == "x" or k else ""
            found.append(f"g{len(found)} AS MATERIALIZED (SELECT *{old}, {value} AS {name} FROM {last})")
            last = f"g{len(found) - 1}"
    return ",\n".join(found) + f",\nbl AS (SELECT sid, x AS block, count(*) AS times FROM {last} GROUP BY sid, x),"


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS sid FROM s0),
s2 AS (SELECT *, CAST([3, 1, 2][(sid - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
       FROM s2 WINDOW w AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT level AS final FROM s3 WHERE cap / weight > level ORDER BY cap / weight, sid LIMIT 1),
s4 AS (SELECT *, CASE WHEN cap / weight > level THEN (SELECT final FROM lv) * weight ELSE cap END AS target,
       CAST(ceil(source_size / {BLOCK}::DOUBLE) AS BIGINT) AS n FROM s3),
s AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target * n / source_size) AS BIGINT) ELSE 0 END AS q FROM s4),
ln AS (SELECT sid, coalesce(sum(q) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(q) OVER (ORDER BY sid) AS hi FROM s),
nq AS (SELECT CAST(sum(q) AS BIGINT) AS total FROM s),
sl AS (SELECT unnest(range(0, (SELECT total FROM nq))) AS slot),
dr AS (SELECT slot, CAST(floor(CAST(CAST('0x' || substr(md5('draw:' || slot), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE * (SELECT total FROM nq)::DOUBLE) AS BIGINT) AS x FROM sl),
ds AS (SELECT slot, sid FROM dr JOIN ln ON x >= lo AND x < hi),
rk AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS j FROM ds),
sh0 AS (SELECT s.sid, n, q, coalesce(c, 0) AS c FROM s LEFT JOIN (SELECT sid, count(*) AS c FROM ds GROUP BY sid) k ON s.sid = k.sid),
sh AS (SELECT *, greatest(q - c, 0) AS under, coalesce(sum(greatest(c - q, 0)) OVER w, 0) AS over_before, coalesce(sum(greatest(q - c, 0)) OVER w, 0) AS under_before
       FROM sh0 WINDOW w AS (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ex AS (SELECT slot, over_before + j - q AS x FROM rk JOIN sh USING (sid) WHERE j >= q),
al AS (SELECT sid, j FROM rk JOIN sh USING (sid) WHERE j < q UNION ALL
       SELECT sid, c + x - under_before FROM ex JOIN sh ON x >= under_before AND x < under_before + under),
ps AS (SELECT sid, n, CAST(j // n AS BIGINT) AS pass, CAST(j % n AS BIGINT) AS x FROM al JOIN (SELECT sid, n FROM s) USING (sid)),
{_rounds_sql()}
st AS (SELECT doc_id, size, s.sid, coalesce(sum(size) OVER (PARTITION BY s.sid ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source WHERE size > 0),
ov AS (SELECT doc_id, sid, start, size, unnest(range(CAST(start // {BLOCK} AS BIGINT), CAST((start + size - 1) // {BLOCK} + 1 AS BIGINT))) AS block FROM st),
tk AS (SELECT doc_id, CAST(sum(times * (least(start + size, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK}))) AS BIGINT) AS taken
       FROM ov JOIN bl USING (sid, block) GROUP BY doc_id)
SELECT d.doc_id, d.size, s.source_size, s.target, coalesce(taken, 0) AS taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN tk USING (doc_id)
"""


@query("op1_mixing", SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = measured(table(spark, sf_dir, "documents"))
    sources = targets(sized)
    taken = mix(sized, sources).groupBy("row").agg(F.sum("words").alias("taken"))
    named = sources.select(F.col("source").alias("name"), "source_size", "target")
    rows = sized.join(taken, "row", "left").join(named, F.col("source").eqNullSafe(F.col("name")))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
