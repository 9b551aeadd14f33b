"""Order-dependent operators without a global sort or a one-partition window.

A table has no row order in Spark, so every operator takes an explicit key that
is unique per row. Two building blocks keep the work distributed:

* **bucketed rank**: buckets that follow the key order, a count per bucket, a
  running sum over the (bounded) bucket table, and a ``row_number`` inside each
  bucket. Buckets are a pure function of the row, so retried tasks agree.
* **threshold cut**: to keep the ``k`` smallest rows of each group, only the key
  of the k-th row is needed. It is found from bucket counts plus a rank inside
  the one bucket that holds it; the rows themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.functions.text import seeded_hash
from newsflow.session import stage

# A hex hash key is cut into 16**d buckets of equal expected size: d grows with the
# table until a bucket holds about ROWS_PER_HASH_BUCKET rows, up to MAX_HASH_DIGITS.
ROWS_PER_HASH_BUCKET = 10_000
MAX_HASH_DIGITS = 4
# An integer key is cut into ranges of about ROWS_PER_RANGE rows, at most MAX_RANGES
# of them; a range holding more than TARGET_ROWS rows is cut again, into MAX_PARTS at most.
ROWS_PER_RANGE = 1_000
MAX_RANGES = 65_536
TARGET_ROWS = 1_000_000
MAX_PARTS = 1_024
# Groups of a split are classes; their sizes, quotas and cut keys are held on the driver.
MAX_GROUPS = 10_000


def _running_total(counts: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_before``: rows of the same group in earlier buckets."""
    window = (
        Window.partitionBy(*(group or [F.lit(0)]))
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(window), F.lit(0)))


def _hash_bucket(key: Column, rows: int) -> Column:
    digits = 1
    while digits < MAX_HASH_DIGITS and rows > ROWS_PER_HASH_BUCKET * 16**digits:
        digits += 1
    return F.substring(key, 1, digits)


def _range_buckets(df: DataFrame, key: str) -> DataFrame:
    """Add ``_bucket`` and ``_part``, which follow the order of an integer key.

    Equal ranges of the key; a range that holds more than ``TARGET_ROWS`` rows (ids with outliers) is cut at
    its own quantiles, which are stored once so that all later passes see the same cuts. Min, max, counts and the
    crowded ranges come to the driver.
    """
    k = F.col(key)
    lo, hi, rows, everything = df.agg(F.min(k), F.max(k), F.count(k), F.count(F.lit(1))).first()
    if rows != everything:
        raise ValueError(f"{everything - rows} rows without '{key}' have no position")
    ranges = min(MAX_RANGES, max(1, rows // ROWS_PER_RANGE))
    width = ((hi or 0) - (lo or 0)) // ranges + 1
    ranged = df.withColumn("_bucket", F.expr(f"{key} div {width}L"))
    if rows <= TARGET_ROWS:
        return ranged.withColumn("_part", F.lit(0).cast("bigint"))
    crowded = ranged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > TARGET_ROWS).collect()
    if not crowded:
        return ranged.withColumn("_part", F.lit(0).cast("bigint"))
    parts = min(MAX_PARTS, max(-(-2 * r["_rows"] // TARGET_ROWS) for r in crowded))
    full = df.sparkSession.createDataFrame([(r["_bucket"],) for r in crowded], "_bucket bigint")
    steps = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    quantiles = ranged.join(F.broadcast(full), "_bucket").groupBy("_bucket").agg(
        F.percentile_approx(k.cast("bigint"), steps, max(10_000, 20 * parts)).alias("_cuts")
    )
    below = F.size(F.filter("_cuts", lambda c: c < k))
    return (
        ranged.join(F.broadcast(stage(quantiles, "range-cuts")), "_bucket", "left")
        .withColumn("_part", F.when(F.col("_cuts").isNotNull(), below).otherwise(0).cast("bigint"))
        .drop("_cuts")
    )


def assign_ordinal(df: DataFrame, key: str, out: str = "ordinal", start: int = 0) -> DataFrame:
    """Exact dense position of every row in the order of ``key``.

    ``key`` is an integer column, unique per row. Rows move once, to their bucket;
    the broadcast bucket table has at most ``MAX_RANGES`` rows and those of the parts of crowded ranges,
    of three numbers.
    """
    keyed = _range_buckets(df, key)
    counts = keyed.groupBy("_bucket", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = _running_total(counts, [], ["_bucket", "_part"]).drop("_rows")
    inside = Window.partitionBy("_bucket", "_part").orderBy(key)
    return (
        keyed.join(F.broadcast(offsets), ["_bucket", "_part"])
        .withColumn(out, F.col("_before") + F.row_number().over(inside) + (start - 1))
        .drop("_bucket", "_part", "_before")
    )


def number_in_file_order(df: DataFrame, out: str = "id") -> DataFrame:
    """Number the rows of a staged ``file_positions`` table from 0, in file order then row order.

    Rows are ranked inside their file block, whose size the reader bounds, and block
    counts are summed up over the (small) table of blocks.
    """
    block = ["_file_no", "_file", "_block"]
    counts = df.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = _running_total(counts, [], block).drop("_rows")
    inside = Window.partitionBy(*block).orderBy("_row")
    return (
        df.join(offsets, block)
        .withColumn(out, F.col("_before") + F.row_number().over(inside) - 1)
        .drop(*block, "_row", "_before")
    )


# One cut: group value (None without groups), name of the part it ends, rows up to it.
Quota = tuple[object, str, int]


def cut_keys(df: DataFrame, group: str | None, key: str, quotas: Sequence[Quota], rows: int) -> list[tuple]:
    """``(group, cut, key)`` of the k-th smallest row for every quota ``(group, cut, k)``.

    ``key`` is a unique hex digest column, ``rows`` the size of the table. Quotas with
    ``k = 0`` or beyond the group size have no key. The result has at most a row per
    quota, and quotas are classes times parts.
    """
    groups = [] if group is None else [group]
    keys = df.select(*groups, F.col(key).alias("_key")).withColumn("_bucket", _hash_bucket(F.col("_key"), rows))
    counts = keys.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    totals = _running_total(counts, groups, ["_bucket"])
    if group is None:
        wanted = F.array(*[F.struct(F.lit(c).alias("cut"), F.lit(k).cast("bigint").alias("k")) for _, c, k in quotas])
        asked = totals.select("*", F.inline(wanted))
    else:
        kind = df.schema[group].dataType.simpleString()
        table = df.sparkSession.createDataFrame(quotas, f"{group} {kind}, cut string, k bigint")
        asked = totals.join(F.broadcast(table), group)
    # The one bucket per quota that holds the k-th row.
    holding = asked.filter(
        (F.col("_before") < F.col("k")) & (F.col("k") <= F.col("_before") + F.col("_rows"))
    ).select(*groups, "_bucket", "cut", (F.col("k") - F.col("_before")).alias("_nth"))
    inside = Window.partitionBy(*groups, "cut", "_bucket").orderBy("_key")
    found = (
        keys.join(F.broadcast(holding), [*groups, "_bucket"])
        .withColumn("_rank", F.row_number().over(inside))
        .filter(F.col("_rank") == F.col("_nth"))
    )
    group_value = F.lit(None).cast("string") if group is None else F.col(group)
    return [tuple(row) for row in found.select(group_value.alias("g"), "cut", "_key").collect()]


def split_by_cuts(
    df: DataFrame, group: str | None, key: str, quotas: Sequence[Quota], rows: int, cuts: Sequence[str], last: str,
    out: str = "split",
) -> DataFrame:
    """Name the part of every row: first cut whose key is not below the row's key, else ``last``.

    One map-side pass over the rows: the cut keys are literals, or one row per class.
    """
    found = cut_keys(df, group, key, quotas, rows)
    if group is None:
        by_cut = {cut: F.lit(value) for _, cut, value in found}
    else:
        per_class: dict[object, dict[str, str]] = {}
        for value, cut, cut_key in found:
            per_class.setdefault(value, {})[cut] = cut_key
        kind = df.schema[group].dataType.simpleString()
        table = df.sparkSession.createDataFrame(
            [(value, *[keys.get(c) for c in cuts]) for value, keys in per_class.items()],
            f"{group} {kind}" + "".join(f", _cut_{c} string" for c in cuts),
        )
        df = df.join(F.broadcast(table), group, "left")
        by_cut = {c: F.col(f"_cut_{c}") for c in cuts}
    name = F.lit(last)
    for cut in reversed([c for c in cuts if c in by_cut]):
        name = F.when(F.col(key) <= by_cut[cut], F.lit(cut)).otherwise(name)
    return df.withColumn(out, name).drop(*[f"_cut_{c}" for c in cuts])


def _with_hash(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.withColumn("_hash", seeded_hash(seed, F.col(id_col)))


def _group_sizes(df: DataFrame, group: str) -> list[tuple]:
    """Row count per group, smallest label first; refuses an unbounded number of groups."""
    rows = (
        df.groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(group)
        .limit(MAX_GROUPS + 1)
        .collect()
    )
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} values of '{group}'")
    if rows and rows[0][group] is None:
        raise ValueError(f"rows without '{group}' belong to no class")
    return [(row[group], row["n"]) for row in rows]


def split_fractions(
    df: DataFrame,
    id_col: str = "id",
    seed: int = 42,
    fractions: Sequence[tuple[str, float]] = (("train", 0.8), ("valid", 0.1)),
    rest: str = "test",
    drop_last: bool = False,
) -> DataFrame:
    """Seeded random split with exact sizes ``int(f * n)`` and the rest in ``rest``.

    ``drop_last`` leaves out the last row of the shuffled order, as a slice that
    stops one short would; the default keeps every row.
    """
    hashed = _with_hash(df, id_col, seed)
    n, end, quotas = df.count(), 0, []
    for name, fraction in fractions:
        end += int(n * fraction)
        quotas.append((None, name, end))
    names = [name for name, _ in fractions]
    if drop_last:
        quotas.append((None, rest, n - 1))
        names.append(rest)
    parts = split_by_cuts(hashed, None, "_hash", quotas, n, names, "_dropped" if drop_last else rest)
    return parts.filter(F.col("split") != "_dropped").drop("_hash")


def stratified_quotas(sizes: Sequence[tuple], test_size: float) -> dict:
    """Test rows per label, ``ceil(test_size * n)`` in total.

    Train shares are floors plus the largest remainders (ties by label order), in
    exact integer arithmetic; a label's other rows are its test rows.
    """
    n = sum(size for _, size in sizes)
    train = n - ceil(n * test_size)
    floors = {label: size * train // n for label, size in sizes}
    remainder = {label: size * train % n for label, size in sizes}
    extra = train - sum(floors.values())
    by_remainder = sorted(range(len(sizes)), key=lambda i: (-remainder[sizes[i][0]], i))
    lucky = {sizes[i][0] for i in by_remainder[:extra]}
    return {label: size - floors[label] - (label in lucky) for label, size in sizes}


def split_stratified(
    df: DataFrame, label: str, id_col: str = "id", seed: int = 42, test_size: float = 0.1
) -> DataFrame:
    """Seeded split keeping label shares: ``ceil(test_size * n)`` rows in ``valid``.

    Rows are ranked by hash within (label, hash bucket), so a label that holds most
    rows is spread over many tasks.
    """
    hashed = _with_hash(df, id_col, seed)
    sizes = _group_sizes(df, label)
    quotas = [(name, "valid", k) for name, k in stratified_quotas(sizes, test_size).items()]
    return split_by_cuts(hashed, label, "_hash", quotas, sum(n for _, n in sizes), ["valid"], "train").drop("_hash")


def split_random(df: DataFrame, id_col: str = "id", seed: int = 0, test_size: float = 0.1) -> DataFrame:
    """Seeded split without strata: ``ceil(test_size * n)`` rows in ``valid``."""
    n = df.count()
    quotas = [(None, "valid", ceil(n * test_size))]
    return split_by_cuts(_with_hash(df, id_col, seed), None, "_hash", quotas, n, ["valid"], "train").drop("_hash")


def sample_rows(df: DataFrame, k: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``k`` pseudo-random rows: a top-k per task and a merge, not a sort of the table."""
    return _with_hash(df, id_col, seed).orderBy("_hash", id_col).limit(k).drop("_hash")


def head(df: DataFrame, n: int | None, id_col: str = "id") -> DataFrame:
    """First ``n`` rows in id order; all rows when ``n`` is None."""
    return df if n is None else df.orderBy(id_col).limit(n)


def assign_batches(df: DataFrame, batch_size: int, key: str = "id", out: str = "batch") -> DataFrame:
    """Batch number of every row: ``batch_size`` consecutive rows each, last one short."""
    numbered = assign_ordinal(df, key, "_ordinal")
    return numbered.withColumn(out, F.expr(f"_ordinal div {int(batch_size)}")).drop("_ordinal")
