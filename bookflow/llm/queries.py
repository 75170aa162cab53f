"""Queries of the training-data operators: QUERIES by name, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from bookflow.llm import alignment, boilerplate, encoding, language, mixing, quality, residue, truncation
from bookflow.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that are template residue, filler, an error page or a scripts notice."""
    return residue.residue_chapters(table(spark, sf_dir, "chapter")).select("chapter_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters whose translation was cut off."""
    return truncation.found(table(spark, sf_dir, "chapter"))


def p2_site_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each site's translated chapters that are cut."""
    return truncation.site_rates(table(spark, sf_dir, "chapter"), table(spark, sf_dir, "novel"))


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every translation's language, state of its end, log-odds and verdict."""
    return truncation.scored(table(spark, sf_dir, "chapter"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the texts whose label is missing or wrong, or that mix languages."""
    chapters = table(spark, sf_dir, "chapter")
    return language.found(chapters, table(spark, sf_dir, "chapter_label"), residue.residue_chapters(chapters))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every text with its language and confidence."""
    texts = language.texts_with_labels(table(spark, sf_dir, "chapter"), table(spark, sf_dir, "chapter_label"))
    return texts.select("chapter_id", "field", F.explode("segments").alias("s")).select("chapter_id", "field", "s.*")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the chapters of one site share."""
    return boilerplate.found(table(spark, sf_dir, "chapter"), table(spark, sf_dir, "novel"))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, counted over clusters of equal chapters and dates: republished chapters are no boilerplate."""
    return boilerplate.found(table(spark, sf_dir, "chapter"), table(spark, sf_dir, "novel"), by="cluster")


def p4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each such line's counts: chapters, clusters of equal chapters, dates."""
    return boilerplate.statistics(table(spark, sf_dir, "chapter"), table(spark, sf_dir, "novel"))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter's text without them."""
    return boilerplate.cleaned(table(spark, sf_dir, "chapter"), table(spark, sf_dir, "novel"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sentences that translate one another."""
    chapters = table(spark, sf_dir, "chapter")
    return alignment.found(chapters, residue.residue_chapters(chapters), truncation.found(chapters))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document's text."""
    return encoding.encoded(table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether decoding gives each text back."""
    return encoding.round_trip(table(spark, sf_dir, "documents")).select("doc_id", "same")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each mix with their repeat counts."""
    return mixing.mixed(*(table(spark, sf_dir, t) for t in ("documents", "mix_target", "mix_plan")))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of each mix's sources."""
    return mixing.report(*(table(spark, sf_dir, t) for t in ("documents", "mix_target", "mix_plan")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are for the most part a list, a table or junk."""
    return quality.found(table(spark, sf_dir, "documents"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics, kind and probability."""
    return quality.classified(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_site_rates": p2_site_rates,
    "p2_scores": p2_scores,
    "p3_found": p3_found,
    "p3_segments": p3_segments,
    "p4_found": p4_found,
    "p4_clusters": p4_clusters,
    "p4_lines": p4_lines,
    "p4_clean": p4_clean,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
}

#: Lines of the chapters with the site, and those frequent in their site.
_LINES = r"""
WITH ch AS (SELECT DISTINCT id, novel_id, raw_text FROM chapter WHERE regexp_matches(raw_text, '[^\s]')),
piece AS (SELECT id, novel_id, raw_text, string_split(raw_text, chr(10)) AS p FROM ch),
num AS (SELECT id, novel_id, raw_text, p, unnest(range(len(p))) AS line_no FROM piece),
line AS (SELECT num.id AS chapter_id, source_site AS site, line_no, p[line_no + 1] AS text, regexp_replace(lower(p[line_no + 1]), '[^\p{L}]', '', 'g') AS k FROM num JOIN novel ON novel.id = num.novel_id),
total AS (SELECT site, count(DISTINCT chapter_id) AS n_site FROM line GROUP BY site),
freq AS (SELECT site, k, count(DISTINCT chapter_id) AS n_chapters FROM line WHERE k <> '' GROUP BY site, k),
bad AS (SELECT site, k, n_chapters, n_site FROM freq JOIN total USING (site) WHERE n_chapters >= 4 AND n_chapters >= 0.03 * n_site)
"""

#: The same with the letters of the whole text, which tell equal documents, and its date.
_WHOLE = r"""
WITH ch AS (SELECT DISTINCT id, novel_id, raw_text, regexp_replace(lower(raw_text), '[^\p{L}\n]', '', 'g') AS whole, CAST(updated_at AS DATE) AS day FROM chapter WHERE regexp_matches(raw_text, '[^\s]')),
num AS (SELECT ch.id, source_site AS site, whole, day, string_split(whole, chr(10)) AS p, unnest(range(len(string_split(whole, chr(10))))) AS line_no FROM ch JOIN novel ON novel.id = ch.novel_id),
line AS (SELECT id AS chapter_id, site, whole, day, line_no, p[line_no + 1] AS k FROM num),
"""

SQL: dict[str, str] = {
    "p4_found": _LINES + "SELECT DISTINCT chapter_id, CAST(line_no AS INT) AS line_no FROM line JOIN bad USING (site, k)",
    "p4_clusters": _WHOLE
    + """bad AS (SELECT site, k FROM line JOIN (SELECT site, count(DISTINCT whole) AS n_site FROM line GROUP BY site) USING (site) WHERE k <> '' GROUP BY site, k, n_site HAVING count(DISTINCT whole) >= 4 AND count(DISTINCT whole) >= 0.03 * n_site AND count(DISTINCT day) >= 2)
SELECT DISTINCT chapter_id, CAST(line_no AS INT) AS line_no FROM line JOIN bad USING (site, k)""",
    "p4_lines": _WHOLE
    + """total AS (SELECT site, count(DISTINCT chapter_id) AS n_site FROM line GROUP BY site)
SELECT site, min(chapter_id) AS first_chapter, count(DISTINCT chapter_id) AS n_chapters, count(DISTINCT whole) AS n_clusters, count(DISTINCT day) AS n_days, n_site FROM line JOIN total USING (site)
WHERE k <> '' GROUP BY site, k, n_site HAVING count(DISTINCT chapter_id) >= 4 AND count(DISTINCT chapter_id) >= 0.03 * n_site""",
    "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p4_clean": _LINES
    + """SELECT chapter_id, CAST(count(*) - count(CASE WHEN bad.k IS NULL THEN 1 END) AS INT) AS n_removed,
  coalesce(string_agg(CASE WHEN bad.k IS NULL THEN text END, chr(10) ORDER BY line_no), '') AS clean_text
FROM (SELECT DISTINCT * FROM line) AS l LEFT JOIN bad USING (site, k) GROUP BY chapter_id""",
}
