"""Lists of chapter references: order, duplicates, fallbacks and guards, always by explicit positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reindexed(refs: DataFrame, group: str, *order: Column, bucket: Column | None = None, name: str = "new_idx", start: int = 0) -> DataFrame:
    """A dense index in the given order.

    ``bucket`` (never null, and rising with the order) cuts a group into parts that are sorted on their own; sizes of the
    parts before give each its offset. So no task sorts a whole group, however large one is."""
    if bucket is None:
        return refs.withColumn(name, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1 + start).cast("int"))
    parts = refs.withColumn("_bucket", bucket)
    w = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy(group, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order))
    return parts.withColumn("_rank", rank).join(before, [group, "_bucket"]).withColumn(name, (F.col("_rank") + F.col("_before") - 1 + start).cast("int")).drop("_bucket", "_rank", "_before")


#: Numbers or ids that one part of a group spans.
SPAN = 100_000


def span(x: Column) -> Column:
    """The part that a number belongs to; numbers that are missing come last."""
    return F.coalesce(F.floor(x / SPAN), F.lit(1 << 60))


def keep_first(refs: DataFrame, group: str, key: str, *order: Column) -> DataFrame:
    """Of equal keys the first."""
    w = Window.partitionBy(group, key).orderBy(*order)
    return refs.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def keep_last_value(refs: DataFrame, group: str, key: str, value: str, pos: str) -> DataFrame:
    """Of equal keys the last value, at the place of the first."""
    return refs.groupBy(group, key).agg(F.max_by(value, pos).alias(value), F.min(pos).alias(pos))


def with_fallback(primary: DataFrame, fallback: DataFrame, group: str, most: int = 5) -> DataFrame:
    """All of ``primary``, and of ``fallback`` the groups of which primary has no more than ``most``."""
    few = primary.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(group)
    return primary.unionByName(fallback.join(few, group, "left_anti"))


def reversed_if_descending(refs: DataFrame, group: str, title: str, pos: str) -> DataFrame:
    """Positions in ascending order: turned round where the number in the first title exceeds that in the last."""
    number = F.nullif(F.regexp_extract(F.col(title), "[0-9]+", 0), F.lit("")).try_cast("bigint")
    ends = refs.groupBy(group).agg(F.min_by(number, pos).alias("_first"), F.max_by(number, pos).alias("_last"))
    key = F.when(F.coalesce(F.col("_first") > F.col("_last"), F.lit(False)), -F.col(pos)).otherwise(F.col(pos))
    return reindexed(refs.join(ends, group).withColumn("_key", key), group, F.col("_key"), bucket=span(F.col("_key"))).drop("_first", "_last", "_key")


def until_nothing_new(links: DataFrame, group: str, page: str, key: str, most: int = 500) -> DataFrame:
    """Pages before the first that brings no new link, and no more than ``most``."""
    first = links.groupBy(group, key).agg(F.min(page).alias(page))
    new = first.groupBy(group, page).agg(F.count("*").alias("n_new"))
    pages = links.select(group, page).distinct().join(new, [group, page], "left")
    stop = pages.where("n_new is null").groupBy(group).agg(F.min(page).alias("stop"))
    return pages.join(stop, group, "left").where((F.col("stop").isNull() | (F.col(page) < F.col("stop"))) & (F.col(page) <= most)).select(group, page, "n_new")


#: A label that opens a range of chapters (a fixed pattern).
RANGE = r"(?i)chapters?\s+([0-9]+\s*-\s*[0-9]+)"


def moved(rows: DataFrame, chosen: DataFrame, group: str, pos: str, by: int) -> DataFrame:
    """A user's own order after one row of each group was moved by some places: those between give way. ``chosen``: group and the row's place, ``chosen``.

    Places are dense from 1; a row is never moved beyond the first or last place."""
    last = rows.groupBy(group).agg(F.max(pos).alias("_last"))
    target = F.greatest(F.lit(1), F.least(F.col("_last"), F.col("chosen") + F.lit(by)))
    both = rows.join(chosen, group, "left").join(last, group).withColumn("_to", target)
    p, at, to = F.col(pos), F.col("chosen"), F.col("_to")
    new = F.when(p == at, to).when((p > at) & (p <= to), p - 1).when((p < at) & (p >= to), p + 1).otherwise(p)
    return both.withColumn(pos, F.coalesce(new, p).cast(rows.schema[pos].dataType)).select(*rows.columns)
