"""Array expressions for token ids and class scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """Zero-based index of the largest score; the first one wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def truncate(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def pair_lengths(first: Column, second: Column, max_length: int) -> tuple[Column, Column]:
    """Lengths kept of a pair when the longer side is cut first, one token at a time.

    Closed form of the loop: cut the longer side down to the shorter one, then
    alternate; on equal lengths the second side gives way first.
    """
    n1, n2 = F.size(first), F.size(second)
    half_up, half_down = (max_length + 1) // 2, max_length // 2
    fits = n1 + n2 <= max_length
    keep1 = F.when(fits, n1).otherwise(
        F.when(n2 <= half_down, F.lit(max_length) - n2).otherwise(F.least(n1, F.lit(half_up)))
    )
    keep2 = F.when(fits, n2).otherwise(F.least(n2, F.lit(max_length) - keep1))
    return keep1, keep2


def pad(ids: Column, length: Column, pad_id: int) -> Column:
    """Pad to ``length`` on the right; longer arrays stay as they are."""
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(length - F.size(ids), F.lit(0))))


def attention_mask(ids: Column, length: Column) -> Column:
    return pad(F.array_repeat(F.lit(1), F.size(ids)), length, 0)


def round_up(length: Column, multiple: int) -> Column:
    """Smallest multiple of ``multiple`` that is at least ``length``."""
    return (F.ceil(length / F.lit(multiple)) * multiple).cast("int")


def swap_value(ids: Column, old: int, new: int) -> Column:
    """Replace every ``old`` by ``new`` (padding to ignore id and back)."""
    return F.transform(ids, lambda x: F.when(x == old, F.lit(new)).otherwise(x))
