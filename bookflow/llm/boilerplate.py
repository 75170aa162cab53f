"""Lines that the documents of one site share: found by counting, and removed from each document.

Copies of a document (rows of one id) are collapsed before counting. A line is boilerplate of a site if its letters
occur in at least ``least`` and at least ``share`` of the site's documents. What counts as a document is a setting
(``by``): an id, or a cluster of documents whose letters are equal, whatever their ids, marks, numbers and spaces. By
clusters a line must also occur on ``days`` dates. So a text that is published again and again under new ids is one
document, and its lines are no boilerplate. ``p4_found`` counts ids, as this project's data define it.

Cases: null and blank texts are no documents and count nowhere; lines without letters are never boilerplate; documents
of unknown novels belong to no site and are left as they are; repeated rows of an id count once; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.session import written

LEAST, SHARE = 4, 0.03
#: Dates on which a line must occur if clusters count.
DAYS = 2
#: Up to so many boilerplate lines are broadcast; there are about avg. lines per document / SHARE of them per site at most.
BROADCAST_ROWS = 100_000


def letters(line: Column) -> Column:
    """What makes two lines the same: their letters in lower case."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def _line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(letters(line)).alias("h"), F.hash(letters(line)).alias("g"))


def not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def site_lines(chapters: DataFrame, novels: DataFrame, clusters: bool = False) -> DataFrame:
    """(site, chapter_id, line_no, h, g; with ``clusters`` also cluster, day): the lines with letters, written to the shared folder.

    Texts stay where they were read: only hashes of lines are joined and shuffled."""
    # one pass over the text: what is left are the letters of each line, in place
    whole = F.regexp_replace(F.lower("raw_text"), r"[^\p{L}\n]+", "")
    lines = (
        chapters.where(F.col("id").isNotNull() & not_blank(F.col("raw_text")))
        .select(F.col("id").alias("chapter_id"), "novel_id", F.to_date("updated_at").alias("day"), whole.alias("whole"))
        .select("chapter_id", "novel_id", "day", *([F.xxhash64("whole").alias("cluster")] if clusters else []), F.posexplode(F.split("whole", "\n", -1)).alias("line_no", "letters"))
        .select("chapter_id", "novel_id", "line_no", *(["day", "cluster"] if clusters else []), F.when(F.col("letters") != "", F.xxhash64("letters")).alias("h"), F.hash("letters").alias("g"))
    )
    sites = novels.where("id is not null and source_site is not null").groupBy(F.col("id").alias("novel_id")).agg(F.min("source_site").alias("site"))
    return written(lines.join(sites, "novel_id").drop("novel_id"), "site-lines")


def boilerplate_lines(lines: DataFrame, least: int = LEAST, share: float = SHARE, by: str = "chapter_id", days: int = 1) -> DataFrame:
    """(site, h, g, n_chapters, n_site): the lines that are frequent in their site, counted ``by`` "chapter_id" or "cluster"."""
    # one row per document and line first; then every count is of rows, with partial sums before each shuffle
    totals = lines.groupBy("site", by).agg(F.lit(1)).groupBy("site").agg(F.count("*").alias("n_site"))
    counts = lines.where("h is not null").groupBy("site", "h", "g", by).agg(F.lit(1)).groupBy("site", "h", "g").agg(F.count("*").alias("n_chapters"))
    found = counts.where(F.col("n_chapters") >= least).join(totals, "site").where(F.col("n_chapters") >= share * F.col("n_site"))
    if days > 1:
        dates = lines.where("h is not null and day is not null").groupBy("site", "h", "g", "day").agg(F.lit(1)).groupBy("site", "h", "g").agg(F.count("*").alias("_days")).where(F.col("_days") >= days)
        found = found.join(dates, ["site", "h", "g"]).drop("_days")
    return found


def _small(df: DataFrame) -> DataFrame:
    """``df`` written, and marked for broadcast if it has no more than BROADCAST_ROWS rows; beyond, joins shuffle."""
    df = written(df, "boilerplate")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def found(chapters: DataFrame, novels: DataFrame, least: int = LEAST, share: float = SHARE, by: str = "chapter_id") -> DataFrame:
    """(chapter_id, line_no) of the lines that are boilerplate of their site, counted ``by`` "chapter_id" or "cluster"."""
    lines = site_lines(chapters, novels, clusters=by == "cluster")
    frequent = _small(boilerplate_lines(lines, least, share, by, DAYS if by == "cluster" else 1).select("site", "h", "g"))
    return lines.where("h is not null").join(frequent, ["site", "h", "g"]).groupBy("chapter_id", "line_no").agg(F.lit(1)).select("chapter_id", "line_no")


def statistics(chapters: DataFrame, novels: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """Per boilerplate line: the first document that has it, documents, clusters of equal documents and dates it occurs in, and the site's documents."""
    lines = site_lines(chapters, novels, clusters=True)
    frequent = boilerplate_lines(lines, least, share)
    marked = lines.where("h is not null").join(_small(frequent), ["site", "h", "g"])
    once = marked.groupBy("site", "h", "g", "n_chapters", "n_site", "cluster").agg(F.collect_set("day").alias("days"), F.min("chapter_id").alias("first_chapter"))
    per = once.select("site", "h", "g", "n_chapters", "n_site", "cluster", F.explode_outer("days").alias("day"))
    keys = ["site", "h", "g", "n_chapters", "n_site"]
    clusters = once.groupBy(*keys).agg(F.count("*").alias("n_clusters"), F.min("first_chapter").alias("first_chapter"))
    days = per.where("day is not null").groupBy(*keys, "day").agg(F.lit(1)).groupBy(*keys).agg(F.count("*").alias("n_days"))
    return clusters.join(days, keys, "left").select("site", "first_chapter", "n_chapters", "n_clusters", F.coalesce("n_days", F.lit(0)).cast("long").alias("n_days"), "n_site")


def cleaned(chapters: DataFrame, novels: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(chapter_id, n_removed, clean_text): each document without the boilerplate lines of its site."""
    lines = site_lines(chapters, novels)
    frequent = boilerplate_lines(lines, least, share).groupBy("site").agg(F.collect_list(F.struct("h", "g")).alias("bad"))  # bounded: 1 / share lines per line of a document
    sites = novels.where("id is not null").groupBy(F.col("id").alias("novel_id")).agg(F.min("source_site").alias("site"))
    of_novel = written(sites.join(written(frequent, "boilerplate"), "site", "left").drop("site"), "boilerplate-novels")
    pieces = F.split("raw_text", "\n", -1)
    kept = F.when(F.col("bad").isNull(), pieces).otherwise(F.filter(pieces, lambda x: (letters(x) == "") | ~F.array_contains(F.col("bad"), _line_key(x))))
    return (
        chapters.where(F.col("id").isNotNull() & not_blank(F.col("raw_text")))
        .select(F.col("id").alias("chapter_id"), "novel_id", "raw_text")
        .join(of_novel, "novel_id", "left")
        .select("chapter_id", F.size(pieces).alias("n"), kept.alias("kept"))
        .select("chapter_id", (F.col("n") - F.size("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("clean_text"))
        .dropDuplicates(["chapter_id"])
    )
