"""State of chapters and jobs: the latest version of each, and the changes that operations make, as new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookflow.functions.text import not_blank
from bookflow.schemas import TO_TRANSLATE


def _latest(rows: DataFrame, *order: Column) -> DataFrame:
    """The first row of each id in the given order. A rank, not an aggregate: the optimizer takes columns that nobody asks for off the scan and the shuffle."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_rank = 1").drop("_rank")


def current(chapters: DataFrame) -> DataFrame:
    """One row per id: the latest, of equally late ones a translated one. No text decides, so counts of chapters read none."""
    return _latest(chapters, F.desc("updated_at"), F.desc(F.coalesce(F.col("status") == "translated", F.lit(False))), F.desc("status"), F.desc("title"))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """One row per job: its latest."""
    return _latest(jobs, F.desc("updated_at"), F.desc("progress"), F.desc("status"))


def recovered(chapters: DataFrame) -> DataFrame:
    """Interrupted translations go back to the state before; their text stays."""
    return chapters.withColumn("status", F.when(F.col("status") == "translating", "scraped").otherwise(F.col("status")))


def without_translation(chapters: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen chapters that have a translation lose it; others stay."""
    out = chapters.join(chosen.select("id").distinct().withColumn("chosen", F.lit(True)), "id", "left")
    hit = F.coalesce("chosen", F.lit(False)) & F.coalesce(F.col("translated_text") != "", F.lit(False))
    status = F.when(hit, F.when(not_blank(F.col("raw_text")), "scraped").otherwise("pending")).otherwise(F.col("status"))
    return out.withColumn("status", status).withColumn("translated_text", F.when(~hit, F.col("translated_text"))).drop("chosen")


def inserted_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``existing`` unchanged, and of the incoming rows the first for each key that it lacks."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = incoming.join(existing.select(*keys), keys, "left_anti").withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return existing.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))


def after_delete(children: DataFrame, deleted: DataFrame) -> DataFrame:
    """Children of books that stay."""
    return children.join(deleted.select(F.col("id").alias("novel_id")), "novel_id", "left_anti")


def pending(chapters: DataFrame) -> DataFrame:
    return chapters.where(F.col("status").isin(*TO_TRANSLATE))


def effective_text(native: Column) -> Column:
    """What a book prints: the translation, else the text itself where it needs none."""
    return F.when(not_blank(F.col("translated_text")), F.col("translated_text")).when(native & not_blank(F.col("raw_text")), F.col("raw_text"))


#: Changes of a chapter's state that may happen (fixed values): scraped, translated, failed, and given up.
CHAPTER_STEPS = {("pending", "scraped"), ("pending", "failed"), ("failed", "scraped"), ("failed", "translating"), ("scraped", "translating"), ("translated", "translating"), ("translating", "translated"), ("translating", "failed"), ("translating", "scraped"), ("translated", "scraped")}


def steps(events: DataFrame, allowed: set[tuple[str, str]], *order: Column) -> DataFrame:
    """Each event of an id with the state before it, and whether that change may happen; a first event, and one that changes nothing, may."""
    before = F.lag("status").over(Window.partitionBy("id").orderBy(*order))
    pairs = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("status")) for a, b in sorted(allowed)])
    with_before = events.withColumn("before", before)
    return with_before.withColumn("allowed", F.col("before").isNull() | F.coalesce(F.col("before") == F.col("status"), F.lit(False)) | F.array_contains(pairs, F.struct("before", "status")))


#: Changes of a job's state that may happen (fixed values).
JOB_STEPS = {("queued", "running"), ("queued", "cancelled"), ("running", "paused"), ("paused", "running"), ("running", "completed"), ("running", "failed"), ("running", "cancelled"), ("paused", "cancelled")}
