"""Joins used by several metric tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row_per_user(users: DataFrame, *attributes: str, user: str = "user_id") -> DataFrame:
    """Reduce a user table to one row per user: the smallest tuple of ``attributes``.

    With a date as the first attribute this is the user's earliest record.  A
    null counts as larger than any value.  The grouping leaves the rows
    partitioned by user, which is what a join on the user needs anyway, so
    uniqueness costs no shuffle of its own.
    """
    known = users.filter(F.col(user).isNotNull())
    if len(attributes) == 1:
        return known.groupBy(user).agg(F.min(attributes[0]).alias(attributes[0]))
    fields = [f for a in attributes for f in (F.col(a).isNull().alias(f"{a}_unknown"), F.col(a))]
    smallest = known.groupBy(user).agg(F.min(F.struct(*fields)).alias("_row"))
    return smallest.select(user, *[F.col(f"_row.{a}").alias(a) for a in attributes])


#: The region of users for whom none is known.
UNKNOWN_REGION = "unknown"


def with_region(
    rows: DataFrame, user_region: DataFrame, user: str = "user_id", region: str = "region", splittable: bool = False
) -> DataFrame:
    """``rows`` with the region of their user, ``unknown`` where there is none, so that parts add up to the whole.

    ``splittable`` is for rows that are not reduced per user yet.
    """
    places = one_row_per_user(user_region, region, user=user)
    located = splittable_join(rows, places, user, "left") if splittable else rows.join(places, user, "left")
    return located.withColumn(region, F.coalesce(region, F.lit(UNKNOWN_REGION)))


def splittable_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on ``key``, to which ``right`` adds its other columns, with a shuffle of its own on both sides.

    Where a side comes out of an aggregate on the key, Spark would join it as it
    lies, and adaptive execution could not split a key that holds many rows of
    the other side.  The key in another form makes it shuffle what comes out.
    """
    own = left.withColumn("_key", F.struct(key))
    other = right.withColumn("_other_key", F.struct(key)).drop(key)
    return own.join(other, F.col("_key") == F.col("_other_key"), how).drop("_key", "_other_key")


def null_safe_left_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Left outer equi-join on ``(left, right)`` column pairs where null matches null.

    Spark turns each pair into an ordinary key and shuffles both sides for it,
    so adaptive execution can split a key that holds many rows of ``left``.
    """
    matches = [left[a].eqNullSafe(right[b]) for a, b in keys]
    return left.join(right, reduce(lambda x, y: x & y, matches), "left")
