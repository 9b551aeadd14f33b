"""Ordinals and splits: exact, complete, independent of partitioning, robust to skew."""

import hashlib
from math import ceil

import pytest
from pyspark.sql import functions as F

from newsflow.operators import ordering as O


def ids(spark, values, parts=4):
    return spark.createDataFrame([(v, f"l{v % 3}") for v in values], "id bigint, label string").repartition(parts)


def as_dict(df, value):
    return {r["id"]: r[value] for r in df.collect()}


@pytest.mark.parametrize("target", [10**6, 7])
def test_ordinal_on_uneven_ids(spark, monkeypatch, target):
    monkeypatch.setattr(O, "TARGET_ROWS", target)
    monkeypatch.setattr(O, "ROWS_PER_RANGE", 10)
    values = [-(10**15), -5, *range(200), 10**6, 10**6 + 1, 2**62]
    got = as_dict(O.assign_ordinal(ids(spark, values), "id"), "ordinal")
    assert got == {v: i for i, v in enumerate(sorted(values))}


def test_ordinal_start_and_null_key(spark):
    assert as_dict(O.assign_ordinal(ids(spark, [9, 4]), "id", start=1), "ordinal") == {4: 1, 9: 2}
    assert O.assign_ordinal(ids(spark, [1]).filter("id < 0"), "id").count() == 0
    with pytest.raises(ValueError):
        O.assign_ordinal(spark.createDataFrame([(None,), (1,)], "id bigint"), "id")


def by_hash(seed, values):
    return sorted(values, key=lambda v: hashlib.md5(f"{seed}:{v}".encode()).hexdigest())


@pytest.mark.parametrize("n", [1, 9, 10, 101])
def test_fractions(spark, n):
    order = by_hash(42, range(n))
    expected = {v: "train" if i < int(n * 0.8) else "valid" if i < int(n * 0.8) + int(n * 0.1) else "test"
                for i, v in enumerate(order)}
    assert as_dict(O.split_fractions(ids(spark, range(n))), "split") == expected
    expected.pop(order[-1])
    assert as_dict(O.split_fractions(ids(spark, range(n)), drop_last=True), "split") == expected


def test_stratified_sizes():
    recorded = {"forex": 5423, "estate": 1198, "stock": 810, "material": 788, "system": 604, "crypto": 240,
                "fund": 173, "bond": 121, "future": 91, "gold": 72}
    quotas = O.stratified_quotas(sorted(recorded.items()), 0.1)
    assert sum(recorded.values()) == 9520 and sum(quotas.values()) == 952
    assert all(abs(quotas[k] - n / 10) < 1 for k, n in recorded.items())


def test_stratified_hot_and_single_row_class(spark):
    rows = [(i, "hot") for i in range(300)] + [(300, "one")] + [(301 + i, "cold") for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, label string")
    split = O.split_stratified(df, "label")
    counts = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert sum(counts.values()) == 341
    assert sum(n for (_, s), n in counts.items() if s == "valid") == ceil(34.1)
    valid_hot = {r["id"] for r in split.filter("label = 'hot' and split = 'valid'").collect()}
    assert valid_hot == set(by_hash(42, range(300))[:len(valid_hot)])
    with pytest.raises(ValueError):
        O.split_stratified(df.withColumn("label", F.lit(None).cast("string")), "label")


def test_partition_independence(spark):
    values = list(range(0, 500, 3))
    for op in (
        lambda d: O.split_fractions(d), lambda d: O.split_stratified(d, "label"), lambda d: O.split_random(d),
        lambda d: O.assign_ordinal(d, "id"), lambda d: O.assign_batches(d, 7), lambda d: O.sample_rows(d, 5),
    ):
        one, many = (sorted(map(tuple, op(ids(spark, values, p)).collect())) for p in (1, 8))
        assert one == many


def test_head_and_sample(spark):
    df = ids(spark, [5, 1, 3])
    assert [r["id"] for r in O.head(df, 2).collect()] == [1, 3]
    assert O.head(df, None).count() == 3
    assert [r["id"] for r in O.sample_rows(df, 2, seed=1).collect()] == by_hash(1, [5, 1, 3])[:2]


def test_outliers_leave_no_crowded_part(spark, monkeypatch):
    """Dense ids with two far ones: all dense ids fall into one equal range, which is cut at its quantiles."""
    monkeypatch.setattr(O, "TARGET_ROWS", 1_000)
    ids = spark.range(20_000).union(spark.createDataFrame([(2**40,), (2**62,)], "id bigint"))
    keyed = O._range_buckets(ids, "id")
    assert max(r["count"] for r in keyed.groupBy("_bucket", "_part").count().collect()) <= 2_000
    rows = O.assign_ordinal(ids, "id").orderBy("id").collect()
    assert [r["ordinal"] for r in rows] == list(range(20_002))
