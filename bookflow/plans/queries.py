"""Registered queries of the engine's own operators: QUERIES by name, and SQL with the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookflow.functions import html, jsonwalk
from bookflow.functions import text as X
from bookflow.functions import urls as U
from bookflow.operators import epub, errors, glossary, refs, sites, state, translate
from bookflow.schemas import ACTIVE_JOBS, JOB, TO_SCRAPE
from bookflow.session import shared_folder, table
from bookflow.sources import snapshots
from bookflow.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WS = X.WS
#: The current version of each chapter and job, as in operators.state.
CUR = """cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, (translated_text IS NULL), status DESC, title DESC) AS rn FROM chapter) WHERE rn = 1),
jobs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, progress DESC, status DESC) AS rn FROM job) WHERE rn = 1)"""


def strip(x: str) -> str:
    """SQL of functions.text.py_strip."""
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if "WITH" in sql[:12] else f"WITH {CUR}\n{sql}"
        return f

    return add


def chapters(s: SparkSession, d: str) -> DataFrame:
    return state.current(table(s, d, "chapter"))


def novels_native(s: SparkSession, d: str) -> DataFrame:
    return sites.with_native_flag(table(s, d, "novel"), table(s, d, "site"))


def with_native(s: SparkSession, d: str) -> DataFrame:
    """Current chapters with their book's native flag."""
    return chapters(s, d).join(novels_native(s, d).select(F.col("id").alias("novel_id"), "native"), "novel_id")


def available(s: SparkSession, d: str) -> DataFrame:
    """Current chapters without their texts: whether they have each, and whether there is one to print. Texts are looked at where they are read and go no further."""
    flags = table(s, d, "chapter").select("id", "novel_id", "idx", "title", "status", "updated_at", X.not_blank(F.col("raw_text")).alias("has_raw"), X.not_blank(F.col("translated_text")).alias("has_translation"))
    c = state.current(flags).join(novels_native(s, d).select(F.col("id").alias("novel_id"), "native"), "novel_id")
    return c.withColumn("available", F.col("has_translation") | (F.col("native") & F.col("has_raw")))


NATIVE = "native AS (SELECT n.*, coalesce(s.is_native_arabic, false) AS native FROM novel n LEFT JOIN site s ON s.site_id = n.source_site)"

# ---- statistics -----------------------------------------------------------------------------------------------------


@query("SELECT novel_id, count(*) AS total, count(*) FILTER (status = 'translated') AS translated, count(*) FILTER (status = 'scraped') AS scraped, count(*) FILTER (status = 'failed') AS failed FROM cur GROUP BY novel_id")
def chapter_stats(s, d):
    of = lambda x: F.count_if(F.col("status") == x).alias(x)
    return chapters(s, d).groupBy("novel_id").agg(F.count("*").alias("total"), of("translated"), of("scraped"), of("failed"))


@query(f"WITH {CUR}, {NATIVE} SELECT novel_id, count(*) AS total, count(*) FILTER (coalesce({strip('raw_text')} <> '', false)) AS ready FROM cur JOIN native n ON n.id = novel_id WHERE n.native GROUP BY novel_id")
def native_ready_stats(s, d):
    return available(s, d).where("native").groupBy("novel_id").agg(F.count("*").alias("total"), F.count_if("has_raw").alias("ready"))


@query(f"WITH {CUR}, {NATIVE} SELECT novel_id, count(*) FILTER (coalesce({strip('translated_text')} <> '', false) OR (n.native AND coalesce({strip('raw_text')} <> '', false))) AS available FROM cur JOIN native n ON n.id = novel_id GROUP BY novel_id")
def epub_available(s, d):
    return available(s, d).groupBy("novel_id").agg(F.count_if("available").alias("available"))


@query("SELECT n.id AS novel_id, count(c.id) AS n_pending FROM novel n LEFT JOIN cur c ON c.novel_id = n.id AND c.status IN ('scraped', 'translating', 'failed') GROUP BY n.id")
def pending_counts(s, d):
    n = state.pending(chapters(s, d)).groupBy("novel_id").agg(F.count("*").alias("n_pending"))
    return table(s, d, "novel").select(F.col("id").alias("novel_id")).join(n, "novel_id", "left").na.fill(0, ["n_pending"])


@query("SELECT source_site, count(*) AS n_novels, count(*) FILTER (status = 'scraped') AS n_scraped FROM novel GROUP BY source_site")
def library_counts(s, d):
    return table(s, d, "novel").groupBy("source_site").agg(F.count("*").alias("n_novels"), F.count_if(F.col("status") == "scraped").alias("n_scraped"))


@query("SELECT (SELECT count(*) FROM cur WHERE status = 'translating') AS n_recovered, (SELECT count(*) FROM glossary_rule WHERE source_term IS NOT NULL) AS n_rules")
def affected_counts(s, d):
    # both counts in one pass over the two tables' flags
    flags = chapters(s, d).select((F.col("status") == "translating").alias("recovered"), F.lit(False).alias("rule"))
    rules = table(s, d, "glossary_rule").select(F.lit(False).alias("recovered"), F.col("source_term").isNotNull().alias("rule"))
    return flags.unionByName(rules).agg(F.count_if("recovered").alias("n_recovered"), F.count_if("rule").alias("n_rules"))


# ---- scheduling -----------------------------------------------------------------------------------------------------


@query("SELECT novel_id, id AS chapter_id, idx, CAST(row_number() OVER (PARTITION BY novel_id ORDER BY idx, id) AS INT) AS place FROM cur WHERE status IN ('scraped', 'translating', 'failed')")
def pending_translation(s, d):
    p = state.pending(chapters(s, d)).select("novel_id", F.col("id").alias("chapter_id"), "idx")
    return refs.reindexed(p, "novel_id", F.col("idx"), F.col("chapter_id"), bucket=refs.span(F.col("idx")), name="place", start=1)


@query("SELECT c.novel_id, c.idx, c.id AS chapter_id, r.source_url FROM cur c JOIN (SELECT novel_id, idx, min(source_url) AS source_url FROM cur GROUP BY novel_id, idx) r ON r.novel_id = c.novel_id AND r.idx = c.idx WHERE c.status IN ('pending', 'failed')")
def pending_scrape(s, d):
    c = chapters(s, d)
    found = c.groupBy("novel_id", "idx").agg(F.min("source_url").alias("source_url"))
    return c.where(F.col("status").isin(*TO_SCRAPE)).select("novel_id", "idx", F.col("id").alias("chapter_id")).join(found, ["novel_id", "idx"])


@query("SELECT novel_id, chapter_id, CAST(row_number() OVER (PARTITION BY novel_id ORDER BY pos) AS INT) AS place FROM (SELECT novel_id, id AS chapter_id, status, row_number() OVER (PARTITION BY novel_id ORDER BY idx DESC, id DESC) AS pos FROM cur) WHERE status IN ('scraped', 'translating', 'failed')")
def selected_in_order(s, d):
    """A request names ids in an order of its own (here from the last chapter to the first); those not pending fall out."""
    c = chapters(s, d).select("id", "novel_id", "idx", "status")
    request = refs.reindexed(c.select("id", "novel_id", "idx"), "novel_id", F.desc("idx"), F.desc("id"), bucket=refs.span(-F.col("idx")), name="pos")
    hit = request.join(state.pending(c).select("id"), "id").select("novel_id", F.col("id").alias("chapter_id"), "pos")
    return refs.reindexed(hit, "novel_id", F.col("pos"), bucket=refs.span(F.col("pos")), name="place", start=1).select("novel_id", "chapter_id", "place")


BATCH = 5


@query(f"SELECT novel_id, chapter_id, idx, CAST(place AS INT) AS place FROM (SELECT novel_id, id AS chapter_id, idx, row_number() OVER (PARTITION BY novel_id ORDER BY idx, id) AS place FROM cur WHERE status IN ('scraped', 'translating', 'failed')) WHERE place <= {BATCH}")
def schedule_topk(s, d):
    p = state.pending(chapters(s, d)).select("novel_id", F.col("id").alias("chapter_id"), "idx")
    # a limit by rank: each task keeps no more than the first BATCH of a book before anything is shuffled
    return p.withColumn("place", F.row_number().over(Window.partitionBy("novel_id").orderBy("idx", "chapter_id"))).where(F.col("place") <= BATCH)


@query(f"SELECT n.id AS novel_id, least(count(c.id), {BATCH}) AS batch_size, count(c.id) = 0 AS already_complete FROM novel n LEFT JOIN cur c ON c.novel_id = n.id AND c.status IN ('scraped', 'translating', 'failed') GROUP BY n.id")
def schedule_totals(s, d):
    return pending_counts(s, d).select("novel_id", F.least("n_pending", F.lit(BATCH).cast("long")).alias("batch_size"), (F.col("n_pending") == 0).alias("already_complete"))


# ---- state ----------------------------------------------------------------------------------------------------------


@query("SELECT id AS chapter_id, CASE WHEN status = 'translating' THEN 'scraped' ELSE status END AS status, raw_text IS NOT NULL AS has_text FROM cur")
def recover_interrupted(s, d):
    return state.recovered(chapters(s, d)).select(F.col("id").alias("chapter_id"), "status", F.col("raw_text").isNotNull().alias("has_text"))


@query(f"SELECT c.id AS chapter_id, CASE WHEN hit THEN (CASE WHEN coalesce({strip('raw_text')} <> '', false) THEN 'scraped' ELSE 'pending' END) ELSE status END AS status, CASE WHEN hit THEN NULL ELSE translated_text END AS translated_text FROM (SELECT *, (status = 'translated' AND coalesce(translated_text <> '', false)) AS hit FROM cur) c")
def delete_translation(s, d):
    c = chapters(s, d)
    return state.without_translation(c, c.where("status = 'translated'")).select(F.col("id").alias("chapter_id"), "status", "translated_text")


@query("SELECT id AS job_id, novel_id, job_type, status, progress, updated_at FROM jobs")
def latest_state(s, d):
    return state.latest_jobs(table(s, d, "job")).select(F.col("id").alias("job_id"), "novel_id", "job_type", "status", "progress", "updated_at")


@query("""WITH have AS (SELECT DISTINCT novel_id, idx FROM chapter WHERE status = 'translated'),
new AS (SELECT novel_id, idx, id, row_number() OVER (PARTITION BY novel_id, idx ORDER BY id) AS rn FROM chapter c WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.novel_id = c.novel_id AND h.idx = c.idx))
SELECT novel_id, idx, min(id) AS chapter_id, false AS is_new FROM chapter WHERE status = 'translated' GROUP BY novel_id, idx
UNION ALL SELECT novel_id, idx, id, true FROM new WHERE rn = 1""")
def upsert_chapters(s, d):
    c = table(s, d, "chapter").select("novel_id", "idx", "id", "status")
    have = c.where("status = 'translated'").groupBy("novel_id", "idx").agg(F.min("id").alias("chapter_id"))
    return state.inserted_if_absent(have, c.select("novel_id", "idx", F.col("id").alias("chapter_id")), ["novel_id", "idx"], ["chapter_id"])


@query("SELECT 'chapter' AS kind, c.novel_id, count(DISTINCT c.id) AS n_left FROM chapter c WHERE c.novel_id NOT IN (SELECT id FROM novel WHERE status = 'failed') GROUP BY c.novel_id UNION ALL SELECT 'job', j.novel_id, count(DISTINCT j.id) FROM job j WHERE j.novel_id NOT IN (SELECT id FROM novel WHERE status = 'failed') GROUP BY j.novel_id")
def cascade_delete(s, d):
    gone = table(s, d, "novel").where("status = 'failed'")
    left = lambda t: state.after_delete(table(s, d, t).select("novel_id", "id"), gone).distinct().groupBy("novel_id").agg(F.count("*").alias("n_left")).select(F.lit(t).alias("kind"), "novel_id", "n_left")
    return left("chapter").unionByName(left("job"))


@query("SELECT id AS job_id, novel_id, job_type, status FROM jobs WHERE status IN ('queued', 'running')")
def active_jobs(s, d):
    return latest_state(s, d).where(F.col("status").isin(*ACTIVE_JOBS)).select("job_id", "novel_id", "job_type", "status")


@query("SELECT job_type, before, status, count(*) AS n FROM (SELECT job_type, status, lag(status) OVER (PARTITION BY novel_id, job_type ORDER BY created_at, id) AS before FROM jobs) GROUP BY job_type, before, status")
def job_transitions(s, d):
    w = Window.partitionBy("novel_id", "job_type").orderBy("created_at", "id")
    return state.latest_jobs(table(s, d, "job")).select("job_type", "status", F.lag("status").over(w).alias("before")).groupBy("job_type", "before", "status").agg(F.count("*").alias("n"))


@query("SELECT id AS job_id, CASE WHEN total_items > 0 THEN CAST(floor(CAST(done_items AS DOUBLE) / CAST(total_items AS DOUBLE) * 100) AS INT) ELSE 0 END AS percent, CAST(sum(done_items) OVER (PARTITION BY novel_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done_so_far FROM jobs")
def job_progress(s, d):
    w = Window.partitionBy("novel_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return state.latest_jobs(table(s, d, "job")).select(F.col("id").alias("job_id"), X.percent(F.col("done_items"), F.col("total_items")).alias("percent"), F.sum("done_items").over(w).alias("done_so_far"))


@query("SELECT event_id, CAST(date_diff('microsecond', before, ts) AS BIGINT) AS gap_us, coalesce(date_diff('microsecond', before, ts) < 1000000, false) AS too_soon FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)")
def request_spacing(s, d):
    e = table(s, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    return e.select("event_id", gap.alias("gap_us")).withColumn("too_soon", F.coalesce(F.col("gap_us") < 1_000_000, F.lit(False)))


# ---- references -----------------------------------------------------------------------------------------------------

NUMBER = "CAST(nullif(regexp_extract(source_url, '/chapter-([0-9]+)(?:[/?#]|$)', 1), '') AS BIGINT)"


@query(f"SELECT novel_id, id AS chapter_id, {NUMBER} AS number, CAST(row_number() OVER (PARTITION BY novel_id ORDER BY {NUMBER} ASC NULLS LAST, id) - 1 AS INT) AS new_idx FROM cur")
def chapter_ref_order(s, d):
    c = chapters(s, d).select("novel_id", F.col("id").alias("chapter_id"), U.chapter_number(F.col("source_url")).alias("number"))
    return refs.reindexed(c, "novel_id", F.col("number").asc_nulls_last(), F.col("chapter_id"), bucket=refs.span(F.col("number")))


@query("SELECT novel_id, source_url, chapter_id, CAST(row_number() OVER (PARTITION BY novel_id ORDER BY chapter_id) - 1 AS INT) AS new_idx FROM (SELECT novel_id, source_url, min(id) AS chapter_id FROM chapter GROUP BY novel_id, source_url)")
def dedupe_keep_first(s, d):
    c = table(s, d, "chapter").select("novel_id", "source_url", F.col("id").alias("chapter_id"))
    return refs.reindexed(refs.keep_first(c, "novel_id", "source_url", F.col("chapter_id")), "novel_id", F.col("chapter_id"), bucket=refs.span(F.col("chapter_id")))


@query("SELECT novel_id, source_url, arg_max(title, id) AS title, min(id) AS pos FROM (SELECT novel_id, source_url, id, max(title) AS title FROM chapter GROUP BY ALL) GROUP BY novel_id, source_url")
def dedupe_keep_last(s, d):
    c = table(s, d, "chapter").groupBy("novel_id", "source_url", F.col("id").alias("pos")).agg(F.max("title").alias("title"))
    return refs.keep_last_value(c, "novel_id", "source_url", "title", "pos").select("novel_id", "source_url", "title", "pos")


@query("SELECT novel_id, id AS chapter_id, 'list' AS origin FROM cur WHERE status = 'translated' UNION ALL SELECT novel_id, id, 'page' FROM cur WHERE status = 'scraped' AND novel_id NOT IN (SELECT novel_id FROM cur WHERE status = 'translated' GROUP BY novel_id HAVING count(*) > 5)")
def union_fallback_refs(s, d):
    c = chapters(s, d).select("novel_id", F.col("id").alias("chapter_id"), "status")
    part = lambda x, o: c.where(F.col("status") == x).select("novel_id", "chapter_id", F.lit(o).alias("origin"))
    return refs.with_fallback(part("translated", "list"), part("scraped", "page"), "novel_id")


@query("""SELECT novel_id, pos, CAST(row_number() OVER (PARTITION BY novel_id ORDER BY CASE WHEN coalesce(f > l, false) THEN -pos ELSE pos END) - 1 AS INT) AS new_idx
FROM (SELECT novel_id, pos, first_value(num) OVER w AS f, last_value(num) OVER w AS l FROM (SELECT novel_id, -id AS pos, CAST(nullif(regexp_extract(title, '[0-9]+', 0), '') AS BIGINT) AS num FROM cur) WINDOW w AS (PARTITION BY novel_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""")
def reverse_if_desc(s, d):
    """Lists as read from the last chapter to the first; turned round where their titles say so."""
    c = chapters(s, d).select("novel_id", (-F.col("id")).alias("pos"), "title")
    return refs.reversed_if_descending(c, "novel_id", "title", "pos").select("novel_id", "pos", "new_idx")


@query("""WITH link AS (SELECT DISTINCT novel_id, CAST(floor(idx / 20) AS BIGINT) AS page_seq, source_url FROM chapter UNION SELECT DISTINCT novel_id, CAST(floor(idx / 20) AS BIGINT) + 1, source_url FROM chapter),
first AS (SELECT novel_id, source_url, min(page_seq) AS page_seq FROM link GROUP BY ALL), new AS (SELECT novel_id, page_seq, count(*) AS n_new FROM first GROUP BY ALL),
page AS (SELECT p.novel_id, p.page_seq, n_new FROM (SELECT DISTINCT novel_id, page_seq FROM link) p LEFT JOIN new USING (novel_id, page_seq)), stop AS (SELECT novel_id, min(page_seq) AS stop FROM page WHERE n_new IS NULL GROUP BY novel_id)
SELECT page.novel_id, page_seq, n_new FROM page LEFT JOIN stop USING (novel_id) WHERE (stop IS NULL OR page_seq < stop) AND page_seq <= 500""")
def pagination_stop(s, d):
    """Pages of twenty links of which each repeats the links before it."""
    c = table(s, d, "chapter").select("novel_id", F.floor(F.col("idx") / 20).alias("page_seq"), "source_url")
    return refs.until_nothing_new(c.unionByName(c.withColumn("page_seq", F.col("page_seq") + 1)).distinct(), "novel_id", "page_seq", "source_url")


BOOK = "CAST(nullif(regexp_extract(source_url, '-([0-9]+)(?:/|$|[?])', 1), '') AS BIGINT)"


@query(f"SELECT id AS chapter_id, novel_id, {BOOK} AS ref_novel FROM cur WHERE {BOOK} IS NULL OR {BOOK} = novel_id")
def foreign_novel_guard(s, d):
    c = chapters(s, d).select(F.col("id").alias("chapter_id"), "novel_id", U.book_number(F.col("source_url")).alias("ref_novel"))
    return c.where("ref_novel is null or ref_novel = novel_id")


def _host(x: str) -> str:
    return f"regexp_extract({x}, '{U.HOST}', 1)"


def _path(x: str) -> str:
    return f"regexp_extract({x}, '{U.PATH}', 1)"


@query(f"SELECT c.id AS chapter_id, {_host('c.source_url')} = {_host('n.source_url')} AND regexp_matches({_path('c.source_url')}, '/chapter-[0-9]+') AND starts_with({_path('c.source_url')}, regexp_replace({_path('n.source_url')}, '/+$', '')) AS valid FROM cur c JOIN novel n ON n.id = c.novel_id")
def valid_chapter_url(s, d):
    n = table(s, d, "novel").select(F.col("id").alias("novel_id"), F.col("source_url").alias("book_url"))
    return chapters(s, d).select("id", "novel_id", "source_url").join(n, "novel_id").select(F.col("id").alias("chapter_id"), U.valid_chapter(F.col("source_url"), F.col("book_url")).alias("valid"))


# ---- titles and texts -----------------------------------------------------------------------------------------------


def _normal(t: str) -> str:
    return strip(f"regexp_replace(coalesce({t}, ''), '{WS}+', ' ', 'g')")


def _best(candidates: str, keys: str, number: str, place: str) -> str:
    """SQL of functions.text.best_title over rows (keys, ord, t); ``number`` and ``place`` are expressions of the keys."""
    bare = strip("regexp_replace(regexp_replace(n, '^#[ ]*', ''), '^[0-9]+[ ]+', '')")
    return f"""k AS (SELECT DISTINCT {keys} FROM {candidates}),
norm AS (SELECT {keys}, ord, {bare} AS b FROM (SELECT {keys}, ord, {_normal('t')} AS n FROM {candidates}) WHERE n <> '' AND NOT regexp_full_match(n, '#?[ ]*[0-9]*')),
best AS (SELECT {keys}, first(b ORDER BY (regexp_matches(b, '(?i)chapter') AND NOT regexp_full_match(b, '(?i)chapter[ ]*[0-9]+')) DESC, length(b) DESC, ord) AS b FROM norm WHERE b <> '' GROUP BY {keys}),
titled AS (SELECT k.*, coalesce(b, 'Chapter ' || coalesce({number}, {place})) AS title FROM k LEFT JOIN best USING ({keys}))"""


#: What a page shows of a chapter: its title alone, behind its number, and the number behind a sign.
SHOWN = ("title", "idx || ' ' || title", "'#' || (idx + 1)")


@query(f"""WITH c AS (SELECT DISTINCT novel_id, idx, id, source_url, title FROM chapter), cand AS (SELECT novel_id, source_url, idx, id, p, [{", ".join(SHOWN)}][p] AS t FROM c, (SELECT unnest(range(1, 4)) AS p)),
o AS (SELECT novel_id, source_url, idx, row_number() OVER (ORDER BY id, idx, p, t) AS ord, t FROM cand), first AS (SELECT novel_id, source_url, min(idx) + 1 AS place FROM o GROUP BY ALL), {_best("o", "novel_id, source_url", "CAST(nullif(regexp_extract(source_url, '/chapter-([0-9]+)(?:[/?#]|$)', 1), '') AS BIGINT)", "0")}
SELECT titled.novel_id, source_url, title, place FROM titled JOIN first USING (novel_id, source_url)""")
def best_title(s, d):
    """All titles that are shown for an address, in the order in which they are first seen, and the best of them."""
    c = table(s, d, "chapter").select("novel_id", "idx", "id", "source_url", "title").distinct()
    shown = F.array(F.col("title"), F.concat(F.col("idx").cast("string"), F.lit(" "), "title"), F.concat(F.lit("#"), (F.col("idx") + 1).cast("string")))
    each = c.select("novel_id", "source_url", "idx", "id", F.posexplode(shown).alias("p", "t"))
    titles = F.transform(F.array_sort(F.collect_list(F.struct("id", "idx", "p", "t"))), lambda x: x["t"])
    found = each.groupBy("novel_id", "source_url").agg(titles.alias("titles"), (F.min("idx") + 1).alias("place"))
    return found.select("novel_id", "source_url", X.best_title(F.col("titles"), U.chapter_number(F.col("source_url")), F.lit(0)).alias("title"), "place")


@query(f"SELECT id AS chapter_id, {strip("regexp_replace(regexp_replace(idx || ' ' || title || '  ' || (idx + 1) || ' days ago', '(?i)^[0-9]+[ \t]*(chapter)', '\\1'), '(?i)[ \t]*[0-9]+[ \t]+(second|minute|hour|day|week|month|year)s?[ \t]+ago[ \t]*$', '')")} AS title FROM cur")
def title_cleanup(s, d):
    shown = F.concat_ws("", F.col("idx"), F.lit(" "), "title", F.lit("  "), F.col("idx") + 1, F.lit(" days ago"))
    return chapters(s, d).select(F.col("id").alias("chapter_id"), X.clean_title(shown).alias("title"))


@query(f"SELECT id AS novel_id, CASE WHEN starts_with(lower(author), 'author:') THEN {strip('substr(author, 8)')} ELSE author END AS author, CASE WHEN starts_with(lower(description), 'summary') THEN {strip('substr(description, 8)')} ELSE description END AS description FROM novel")
def prefix_strip(s, d):
    return table(s, d, "novel").select(F.col("id").alias("novel_id"), X.without_prefix(F.col("author"), "author:").alias("author"), X.without_prefix(F.col("description"), "summary").alias("description"))


def _display(title: str, fallback: str) -> str:
    return f"coalesce(nullif({title}, ''), {fallback})"


@query("SELECT id AS chapter_id, coalesce(nullif(title, ''), 'Chapter ' || (idx + 1)) AS title, idx + 1 AS place FROM cur")
def title_fallback(s, d):
    return chapters(s, d).select(F.col("id").alias("chapter_id"), X.first_of(F.col("title"), F.concat(F.lit("Chapter "), (F.col("idx") + 1).cast("string"))).alias("title"), (F.col("idx") + 1).alias("place"))


@query(f"WITH {CUR}, {NATIVE} SELECT c.id AS chapter_id, CASE WHEN coalesce({strip('translated_text')} <> '', false) THEN translated_text WHEN n.native AND coalesce({strip('raw_text')} <> '', false) THEN raw_text END AS text FROM cur c JOIN native n ON n.id = novel_id")
def effective_text(s, d):
    return with_native(s, d).select(F.col("id").alias("chapter_id"), state.effective_text(F.col("native")).alias("text"))


def _paragraphs(x: str, delimiter: str) -> str:
    return f"array_to_string(list_transform(list_filter(list_transform(string_split(replace({x}, chr(13) || chr(10), chr(10)), {delimiter}), lambda p: {strip('p')}), lambda p: p <> ''), lambda p: '<p>' || replace(p, chr(10), ' ') || '</p>'), chr(10))"


@query(f"SELECT id AS chapter_id, {_paragraphs('translated_text', 'chr(10) || chr(10)')} AS html FROM cur WHERE translated_text IS NOT NULL")
def paragraph_html(s, d):
    return chapters(s, d).where("translated_text is not null").select(F.col("id").alias("chapter_id"), X.paragraphs(F.col("translated_text")).alias("html"))


@query(f"""WITH {CUR}, {NATIVE}, use AS (SELECT c.novel_id, c.id, c.idx, c.title, CASE WHEN coalesce({strip('translated_text')} <> '', false) THEN translated_text WHEN n.native AND coalesce({strip('raw_text')} <> '', false) THEN raw_text END AS text FROM cur c JOIN native n ON n.id = novel_id)
SELECT novel_id, id AS chapter_id, printf('text/chapter_%04d.xhtml', idx) AS file_name, CAST(row_number() OVER (PARTITION BY novel_id ORDER BY idx, id) AS INT) AS place, title, {_paragraphs('text', 'chr(10) || chr(10)')} AS html FROM use WHERE text IS NOT NULL""")
def epub_chapters(s, d):
    """The chapters of each book's package: in order, with their file names and markup."""
    # places are numbered on narrow rows; texts are shuffled once, by id, where both meet
    placed = refs.reindexed(available(s, d).where("available").select("novel_id", "id", "idx"), "novel_id", F.col("idx"), F.col("id"), bucket=refs.span(F.col("idx")), name="place", start=1).select("id", "place")
    use = with_native(s, d).select("novel_id", "id", "idx", "title", state.effective_text(F.col("native")).alias("text"))
    return use.join(placed, "id").select("novel_id", F.col("id").alias("chapter_id"), X.chapter_file(F.col("idx")).alias("file_name"), "place", "title", X.paragraphs(F.col("text")).alias("html"))


@query(f"""WITH {CUR}, {NATIVE}, use AS (SELECT c.novel_id, c.id, c.idx, c.title FROM cur c JOIN native n ON n.id = novel_id WHERE coalesce({strip('translated_text')} <> '', false) OR (n.native AND coalesce({strip('raw_text')} <> '', false)))
SELECT novel_id, CAST(row_number() OVER (PARTITION BY novel_id ORDER BY idx, id) AS INT) AS place, 'chapter-' || row_number() OVER (PARTITION BY novel_id ORDER BY idx, id) AS anchor, title FROM use
UNION ALL SELECT DISTINCT u.novel_id, 0, 'cover', n.title FROM use u JOIN novel n ON n.id = u.novel_id""")
def epub_toc(s, d):
    use = available(s, d).where("available").select("novel_id", "id", "idx", "title")
    placed = refs.reindexed(use, "novel_id", F.col("idx"), F.col("id"), bucket=refs.span(F.col("idx")), name="place", start=1)
    c = placed.select("novel_id", "place", F.concat(F.lit("chapter-"), F.col("place").cast("string")).alias("anchor"), "title")
    cover = c.select("novel_id").distinct().join(table(s, d, "novel").select(F.col("id").alias("novel_id"), "title"), "novel_id").select("novel_id", F.lit(0).alias("place"), F.lit("cover").alias("anchor"), "title")
    return c.unionByName(cover)


@query(r"SELECT id AS novel_id, coalesce(nullif(regexp_replace(regexp_replace(title, '[^\p{L}\p{N} _-]', '', 'g'), ' +$', ''), ''), 'novel_' || id) || '.epub' AS file_name FROM novel")
def safe_title(s, d):
    return table(s, d, "novel").select(F.col("id").alias("novel_id"), F.concat(X.safe_title(F.col("title"), F.col("id")), F.lit(".epub")).alias("file_name"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN repeat('*', length(c_name)) ELSE left(c_name, 4) || repeat('•', length(c_name) - 6) || right(c_name, 2) END AS shown FROM customer")
def mask_secret(s, d):
    return table(s, d, "customer").select("c_custkey", X.masked(F.col("c_name")).alias("shown"))


# ---- listings -------------------------------------------------------------------------------------------------------


@query("SELECT id AS novel_id, title, source_url, source_site, author, cover_url, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM novel")
def novel_listing(s, d):
    return table(s, d, "novel").select(F.col("id").alias("novel_id"), "title", "source_url", "source_site", "author", "cover_url", "status", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


@query("SELECT n.id AS novel_id, n.title, CAST(coalesce(floor(c.idx / 200), 0) AS BIGINT) AS page, count(c.id) AS n_chapters, coalesce(string_agg(c.idx || ':' || c.id || ':' || c.status || ':' || (CASE WHEN coalesce(c.translated_text, '') <> '' THEN 1 ELSE 0 END), '|' ORDER BY c.idx, c.id), '') AS chapters FROM novel n LEFT JOIN cur c ON c.novel_id = n.id GROUP BY ALL")
def novel_detail(s, d):
    """Each book with its chapters nested in order, in pages, so that no row holds a whole book; here written as strings."""
    c = chapters(s, d).select("novel_id", "idx", F.struct("idx", "id", "status", (F.coalesce("translated_text", F.lit("")) != "").cast("int").alias("has")).alias("x"))
    shown = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["idx"], x["id"], x["status"], x["has"])), "|")
    pages = _listed(c, F.col("x")).select("novel_id", "page", F.size("items").alias("n"), shown.alias("shown"))
    n = table(s, d, "novel").select(F.col("id").alias("novel_id"), "title").join(pages, "novel_id", "left")
    return n.select("novel_id", "title", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("n", F.lit(0)).cast("long").alias("n_chapters"), F.coalesce("shown", F.lit("")).alias("chapters"))


@query("SELECT id AS chapter_id, CASE status WHEN 'pending' THEN 'Pending' WHEN 'scraped' THEN 'Scraped' WHEN 'translating' THEN 'Translating' WHEN 'translated' THEN 'Translated' WHEN 'failed' THEN 'Failed' ELSE status END AS label, idx + 1 AS place, coalesce(translated_text, '') <> '' AS has_translation FROM cur")
def chapter_labels(s, d):
    label = F.coalesce(*[F.when(F.col("status") == x, x.capitalize()) for x in ("pending", "scraped", "translating", "translated", "failed")], F.col("status"))
    return chapters(s, d).select(F.col("id").alias("chapter_id"), label.alias("label"), (F.col("idx") + 1).alias("place"), (F.coalesce("translated_text", F.lit("")) != "").alias("has_translation"))


@query("SELECT id AS novel_id, concat_ws('  ·  ', title, author, source_site, upper(status[1]) || status[2:]) AS line FROM novel")
def novel_line(s, d):
    return table(s, d, "novel").select(F.col("id").alias("novel_id"), F.concat_ws("  ·  ", "title", "author", "source_site", F.initcap("status")).alias("line"))


@query("SELECT id AS novel_id, title FROM novel WHERE contains(lower(concat_ws(' ', title, coalesce(author, ''))), 'pale')")
def library_search(s, d):
    asked = F.lower(F.trim(F.lit(" Pale ")))
    return table(s, d, "novel").where(F.contains(F.lower(F.concat_ws(" ", "title", F.coalesce("author", F.lit("")))), asked)).select(F.col("id").alias("novel_id"), "title")


@query(f"WITH {NATIVE} SELECT id AS novel_id, source_site, native FROM native")
def native_flags(s, d):
    return novels_native(s, d).select(F.col("id").alias("novel_id"), "source_site", "native")


@query("SELECT kind, group_status AS status, n FROM (SELECT 'novel' AS kind, status AS group_status, count(*) AS n FROM novel GROUP BY status UNION ALL SELECT 'chapter', status, count(*) FROM cur GROUP BY status UNION ALL SELECT 'job', status, count(*) FROM jobs GROUP BY status)")
def status_totals(s, d):
    each = lambda df, kind: df.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "status", "n")
    return each(table(s, d, "novel"), "novel").unionByName(each(chapters(s, d), "chapter")).unionByName(each(state.latest_jobs(table(s, d, "job")), "job"))


# ---- sites ----------------------------------------------------------------------------------------------------------


@query(f"SELECT n.id AS novel_id, (SELECT arg_min(s.site_id, s.priority) FROM site s WHERE contains(n.source_url, {_host('s.base_url')})) AS site_id FROM novel n")
def resolve_site(s, d):
    found = sites.registry(table(s, d, "site"))
    return table(s, d, "novel").select(F.col("id").alias("novel_id"), sites.resolved(F.col("source_url"), found).alias("site_id"))


@query(f"WITH e AS (SELECT site_id, unnest(map_entries(selectors)) AS e FROM site), p AS (SELECT site_id, e.key AS kind, string_split(e.value, ',') AS parts FROM e), q AS (SELECT site_id, kind, {strip('unnest(parts)')} AS selector, generate_subscripts(parts, 1) AS pos FROM p) SELECT site_id, kind, CAST(row_number() OVER (PARTITION BY site_id, kind ORDER BY pos) - 1 AS INT) AS priority, selector FROM q WHERE selector <> ''")
def site_selectors(s, d):
    return table(s, d, "site").select("site_id", F.explode("selectors").alias("kind", "list")).select("site_id", "kind", F.posexplode(X.split_list(F.col("list"))).alias("priority", "selector"))


@query("SELECT site_id, CASE WHEN use_curl_cffi THEN 'impersonated' ELSE 'plain' END AS method, CASE WHEN is_native_arabic THEN 'Arabic' ELSE 'English' END AS language, round(request_delay_min + request_delay_max, 6) / 2 AS mean_delay FROM site")
def site_details(s, d):
    return table(s, d, "site").select("site_id", F.when(F.col("use_curl_cffi"), "impersonated").otherwise("plain").alias("method"), F.when(F.col("is_native_arabic"), "Arabic").otherwise("English").alias("language"), (F.round(F.col("request_delay_min") + F.col("request_delay_max"), 6) / 2).alias("mean_delay"))


@query(f"SELECT id AS novel_id, {_host('source_url')} AS host, {_path('source_url')} AS path, regexp_replace(lower({_host('source_url')}), '[^a-z0-9]+', '_', 'g') AS site_key FROM novel")
def url_parts(s, d):
    u = F.col("source_url")
    return table(s, d, "novel").select(F.col("id").alias("novel_id"), U.host(u).alias("host"), U.path(u).alias("path"), X.site_key(U.host(u)).alias("site_key"))


@query("SELECT c.id AS chapter_id, s.base_url || regexp_extract(c.source_url, '^[a-z]+://[^/]*(/.*)$', 1) AS url, 'https://cdn.example/' || c.id AS image FROM cur c JOIN novel n ON n.id = c.novel_id JOIN site s ON s.site_id = n.source_site")
def absolute_urls(s, d):
    """Root-relative and protocol-relative addresses, resolved against the site's."""
    n = table(s, d, "novel").join(table(s, d, "site").select(F.col("site_id").alias("source_site"), "base_url"), "source_site").select(F.col("id").alias("novel_id"), "base_url")
    c = chapters(s, d).select("id", "novel_id", "source_url").join(n, "novel_id")
    href, image = F.regexp_extract("source_url", "^[a-z]+://[^/]*(/.*)$", 1), F.concat(F.lit("//cdn.example/"), F.col("id").cast("string"))
    return c.select(F.col("id").alias("chapter_id"), U.absolute(href, F.col("base_url")).alias("url"), U.absolute(image, F.col("base_url")).alias("image"))


@query("SELECT id AS novel_id, source_url || '?tab=chapters&page=' || id || '&name=a+b%2Ac~#list' AS url, 'https://raw.githubusercontent.com/reader/sites/main/' || source_site || '.json' AS raw_url, CASE WHEN regexp_matches(lower(source_url), 'cloudflare|protected|wordpress|wp-') THEN 1 WHEN regexp_matches(lower(source_url), 'app|javascript|dynamic|series') THEN 2 ELSE 0 END AS method FROM novel")
def url_rewrites(s, d):
    asked = F.concat(F.col("source_url"), F.lit("?tab=about&page=0&page="), F.col("id").cast("string"), F.lit("&q=&name=a%20b*c%7E#list"))
    blob = F.concat(F.lit("https://github.com/reader/sites/blob/main/"), F.col("source_site"), F.lit(".json"))
    return table(s, d, "novel").select(F.col("id").alias("novel_id"), U.with_parameter(asked, "tab", "chapters").alias("url"), U.raw_file(blob).alias("raw_url"), sites.suggested_method(F.col("source_url")).alias("method"))


@query("SELECT DISTINCT source_site AS site_id FROM novel WHERE source_site NOT IN (SELECT site_id FROM site WHERE is_native_arabic)")
def sites_without(s, d):
    """Set difference: sites of books that a list of sites lacks."""
    return table(s, d, "novel").select(F.col("source_site").alias("site_id")).distinct().join(table(s, d, "site").where("is_native_arabic").select("site_id"), "site_id", "left_anti")


# ---- settings and errors --------------------------------------------------------------------------------------------


def _settings(s: SparkSession, d: str) -> DataFrame:
    """Lines of a settings file: a comment, a blank line, and settings of which one occurs twice, for each site."""
    up = F.upper("site_id")
    return table(s, d, "site").select(F.col("priority"), F.posexplode(F.array(F.lit("# settings"), F.lit(""), F.concat(up, F.lit("_API_KEY=first=1")), F.concat(up, F.lit("_MODEL=small,large")), F.concat(up, F.lit("_API_KEY= second=2 ")), F.concat(up, F.lit("_BASE_URL="), F.col("base_url")), F.concat(up, F.lit("_NOTE=x")))).alias("n", "line")).select((F.col("priority") * 10 + F.col("n")).alias("line_no"), "line")


_LINES = """line AS (SELECT priority * 10 + n AS line_no, l[n + 1] AS line FROM (SELECT priority, ['# settings', '', upper(site_id) || '_API_KEY=first=1', upper(site_id) || '_MODEL=small,large', upper(site_id) || '_API_KEY= second=2 ', upper(site_id) || '_BASE_URL=' || base_url, upper(site_id) || '_NOTE=x'] AS l, unnest(range(7)) AS n FROM site)),
env AS (SELECT name, arg_max(value, line_no) AS value FROM (SELECT line_no, trim(regexp_extract(line, '^([^=]*)=', 1)) AS name, trim(regexp_extract(line, '^[^=]*=(.*)$', 1)) AS value FROM line WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND contains(line, '=')) GROUP BY name)"""


@query(f"WITH {_LINES} SELECT name, value FROM env")
def env_parse(s, d):
    from bookflow.sources.config import settings

    return settings(_settings(s, d))


@query(f"""WITH {_LINES} SELECT name, CASE WHEN ends_with(name, '_API_KEY') THEN 'API Key' WHEN ends_with(name, '_MODEL') THEN 'Model' WHEN ends_with(name, '_BASE_URL') THEN 'Base URL' ELSE 'Custom' END AS kind,
array_to_string(list_transform(string_split(regexp_replace(name, '(_API_KEY|_BASE_URL|_MODEL)$', ''), '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS provider, regexp_full_match(name, '[A-Z][A-Z0-9_]*') AS valid FROM env""")
def settings_classify(s, d):
    from bookflow.sources.config import classified_settings

    return classified_settings(env_parse(s, d))


@query(f"WITH {_LINES} SELECT name, value, 'kept' AS change FROM env WHERE NOT ends_with(name, '_NOTE') AND NOT ends_with(name, '_MODEL') UNION ALL SELECT name, 'large', 'updated' FROM env WHERE ends_with(name, '_MODEL') UNION ALL SELECT upper(site_id) || '_TIMEOUT', '30', 'added' FROM site")
def env_patch(s, d):
    """Settings after an update: changed, added and removed ones."""
    from bookflow.sources.config import patched

    now = env_parse(s, d)
    updates = now.where("endswith(name, '_MODEL')").select("name", F.lit("large").alias("new_value")).unionByName(table(s, d, "site").select(F.concat(F.upper("site_id"), F.lit("_TIMEOUT")).alias("name"), F.lit("30").alias("new_value")))
    return patched(now, updates, now.where("endswith(name, '_NOTE')").select("name"))


@query(f"""WITH {_LINES} SELECT name, array_to_string(list_transform(string_split(value, ','), lambda m: trim(m)), '|') AS models, 'small' AS chosen FROM env WHERE ends_with(name, '_MODEL')""")
def model_choice(s, d):
    """The saved model where the provider lists it, else its first."""
    listed = X.split_list(F.col("value"))
    saved = F.lit("medium")
    return env_parse(s, d).where("endswith(name, '_MODEL')").select("name", F.array_join(listed, "|").alias("models"), F.when(F.array_contains(listed, saved), saved).otherwise(F.coalesce(F.try_element_at(listed, F.lit(1)), saved)).alias("chosen"))


@query("SELECT id AS job_id, coalesce(regexp_matches(lower(error_message), '429|too many requests|rate limit exceeded'), false) AS rate_limit, coalesce(regexp_matches(lower(error_message), 'provider|tokenrouter|gemini|groq|api key|suggestion|quota|rate limit|429|401|503'), false) AS provider_issue, left(error_message, 100) AS shown FROM jobs")
def classify_errors(s, d):
    m = F.col("error_message")
    return state.latest_jobs(table(s, d, "job")).select(F.col("id").alias("job_id"), errors.is_rate_limit(m).alias("rate_limit"), errors.is_provider_issue(m).alias("provider_issue"), F.left(m, F.lit(100)).alias("shown"))


@query("SELECT novel_id, id AS chapter_id, NOT (bool_and(status = 'translated') OVER (PARTITION BY novel_id)) AS checked FROM cur")
def toggle_checks(s, d):
    """Check boxes of each book after the toggle: all off where all were on (here: translated), else all on."""
    w = Window.partitionBy("novel_id")
    return chapters(s, d).select("novel_id", F.col("id").alias("chapter_id"), (~F.bool_and(F.col("status") == "translated").over(w)).alias("checked"))


# ---- glossary -------------------------------------------------------------------------------------------------------

KEY = f"lower({strip('source_term')})"
_NEW = "SELECT *, {key} AS term, {t} AS target FROM glossary_rule WHERE {key} <> '' AND {t} <> ''".format(key=KEY, t=strip("target_term"))
_OLD = f"SELECT {KEY} AS term, arg_min(target_term, id) AS old_target FROM glossary_rule WHERE notes IS NOT NULL GROUP BY ALL"


@query(f"WITH n AS (SELECT term, arg_min(target, id) AS new_target FROM ({_NEW}) GROUP BY term), o AS ({_OLD}) SELECT coalesce(o.term, n.term) AS term, coalesce(old_target, new_target) AS target_term, CASE WHEN old_target IS NULL THEN 'inserted' ELSE 'kept' END AS origin FROM o FULL JOIN n ON o.term = n.term")
def glossary_merge_insert(s, d):
    g = table(s, d, "glossary_rule")
    return glossary.merged(g.where("notes is not null"), g, overwrite=False)


@query(f"WITH n AS (SELECT term, arg_max(target, id) AS new_target FROM ({_NEW}) GROUP BY term), o AS ({_OLD}) SELECT coalesce(o.term, n.term) AS term, coalesce(new_target, old_target) AS target_term, CASE WHEN old_target IS NULL THEN 'inserted' WHEN new_target IS NOT NULL THEN 'updated' ELSE 'kept' END AS origin FROM o FULL JOIN n ON o.term = n.term")
def glossary_merge_overwrite(s, d):
    g = table(s, d, "glossary_rule")
    return glossary.merged(g.where("notes is not null"), g, overwrite=True)


@query()
def glossary_postpass(s, d):
    """All rules in turn over every translation. Too slow in SQL on whole tables; tested against brute force."""
    rules = glossary.rules_in_order(table(s, d, "glossary_rule"))
    c = chapters(s, d).where("translated_text is not null")
    return c.select(F.col("id").alias("chapter_id"), glossary.replaced(F.col("translated_text"), rules).alias("text"))


@query(f"""WITH l AS (SELECT string_agg('- "' || source_term || '" → "' || target_term || '"', chr(10) ORDER BY id) AS lines FROM glossary_rule) SELECT '{glossary.PROMPT}' || chr(10) || chr(10) || 'Glossary:' || chr(10) || lines AS prompt FROM l""")
def system_prompt(s, d):
    return glossary.prompt(table(s, d, "glossary_rule"))


@query("SELECT id AS rule_id, source_term, target_term FROM glossary_rule WHERE id NOT IN (SELECT max(id) FROM glossary_rule GROUP BY lower(trim(source_term)) HAVING count(*) > 1)")
def glossary_delete(s, d):
    """Rules without a selection of them (here: the later ones of terms that occur twice)."""
    g = table(s, d, "glossary_rule")
    gone = g.groupBy(F.lower(F.trim("source_term")).alias("k")).agg(F.max("id").alias("id"), F.count("*").alias("n")).where("n > 1").select("id")
    return g.join(gone, "id", "left_anti").select(F.col("id").alias("rule_id"), "source_term", "target_term")


# ---- pages, JSON, packages, providers, streams ----------------------------------------------------------------------


def _pages(s: SparkSession, d: str) -> DataFrame:
    """A page for each chapter with text, laid out as its site's selectors expect, with a script that holds an end tag."""
    site = table(s, d, "site").select(F.col("site_id").alias("source_site"), F.regexp_extract(F.col("selectors")["novel_title"], r"\.([\w-]+)", 1).alias("cls"), F.regexp_extract(F.col("selectors")["chapter_text"], r"#([\w-]+)", 1).alias("box"))
    n = table(s, d, "novel").join(site, "source_site").select(F.col("id").alias("novel_id"), F.col("source_site").alias("site_id"), "cls", "box")
    c = chapters(s, d).where(X.not_blank(F.col("raw_text"))).join(n, "novel_id")
    page = F.concat(
        F.lit("<html><head><title>x</title></head><body><h1 class='"), "cls", F.lit("'>"), X.escaped(F.col("title")), F.lit("</h1><div id='"), "box", F.lit("'>"),
        X.paragraphs(X.escaped(F.col("raw_text")), "\n"), F.lit("</div><script>var s = '</p>';</script><div><p>footer</div></body></html>"),
    )
    return c.select(F.col("id").alias("page_id"), "site_id", page.alias("html"))


BLANKS = r"[ \t\x{A0}]+"
_TEXT = f"list_filter(list_transform(string_split(replace(raw_text, chr(13) || chr(10), chr(10)), chr(10)), lambda p: {strip(f"regexp_replace({strip('p')}, '{BLANKS}', ' ', 'g')")}), lambda p: p <> '')"


@query(f"SELECT id AS page_id, {strip(f"regexp_replace(title, '{BLANKS}', ' ', 'g')")} AS title, array_to_string({_TEXT}, chr(10) || chr(10)) AS body FROM cur WHERE coalesce({strip('raw_text')} <> '', false)")
def html_title_body(s, d):
    return html.extracted(_pages(s, d), table(s, d, "site")).select("page_id", "title", "body")


#: Chapters that one page of a list, a manifest or an embedded object holds: lists come in pages, so none holds a whole book.
PAGE = 200
#: Addresses of a page of a list, each once, where it is first seen, with all titles that are shown for it.
_LISTED = f"""c AS (SELECT novel_id, CAST(floor(idx / {PAGE}) AS BIGINT) AS page, idx, id, source_url AS url, title FROM cur WHERE regexp_matches(source_url, '/chapter-[0-9]+(?:[/?#]|$)')),
o AS (SELECT novel_id, page, url, row_number() OVER (ORDER BY idx, id) AS ord, title AS t FROM c), first AS (SELECT novel_id, page, url, CAST(row_number() OVER (PARTITION BY novel_id, page ORDER BY min(ord)) - 1 AS INT) AS pos FROM o GROUP BY novel_id, page, url),
{_best("o", "novel_id, page, url", "CAST(nullif(regexp_extract(url, '/chapter-([0-9]+)(?:[/?#]|$)', 1), '') AS BIGINT)", "0")}"""


def _listed(c: DataFrame, item) -> DataFrame:
    """(novel_id, page, items): what each page of a book's list holds, in order."""
    return c.groupBy("novel_id", F.floor(F.col("idx") / PAGE).alias("page")).agg(F.array_sort(F.collect_list(item)).alias("items"))


@query(f"WITH {CUR}, {_LISTED} SELECT novel_id, page, pos, url AS href, title FROM titled JOIN first USING (novel_id, page, url)")
def html_refs(s, d):
    """Lists of chapters in pages, without the links of a list of the latest ones."""
    site = table(s, d, "site").select(F.col("site_id").alias("source_site"), F.regexp_extract(F.col("selectors")["chapter_list"], r"\.([\w-]+)", 1).alias("cls"))
    n = table(s, d, "novel").join(site, "source_site").select(F.col("id").alias("novel_id"), F.col("source_site").alias("site_id"), "cls")
    link = F.transform("items", lambda x: F.concat(F.lit("<li><a href='"), x["source_url"], F.lit("'>"), X.escaped(x["title"]), F.lit("</a>")))
    toc = _listed(chapters(s, d), F.struct("idx", "id", "source_url", "title")).join(n, "novel_id")
    latest = F.lit("<html><body><div class=toc-list><div class='latest-release box'><a href='/chapter-1'>new</a></div><div class='")
    page = F.concat(latest, "cls", F.lit("'><a href='/about'>about</a><a href='/chapters'>all</a><ul>"), F.array_join(link, ""), F.lit("</ul></div></div></body></html>"))
    found = html.extracted(toc.select(F.struct("novel_id", "page").alias("page_id"), "site_id", page.alias("html")), table(s, d, "site"))
    r = F.col("r")
    return found.select("page_id", F.explode("refs").alias("r")).select("page_id.novel_id", "page_id.page", "r.pos", "r.href", X.best_title(r["titles"], U.chapter_number(r["href"]), r["pos"] + 1).alias("title"))


@query(f"SELECT novel_id, CAST(floor(idx / {PAGE}) AS BIGINT) AS page, CAST(row_number() OVER (PARTITION BY novel_id, CAST(floor(idx / {PAGE}) AS BIGINT) ORDER BY idx, id) - 1 AS INT) AS pos, source_url AS url, trim(idx || ' ' || title) AS title FROM cur")
def manifest_json(s, d):
    pages = _listed(chapters(s, d), F.struct("idx", "id", F.col("source_url").alias("url"), F.col("idx").cast("string").alias("label"), "title"))
    pages = pages.select("novel_id", "page", F.to_json(F.struct(F.col("items").alias("chapters"))).alias("payload"))
    return pages.select("novel_id", "page", F.explode(jsonwalk.manifest(F.col("payload"))).alias("x")).select("novel_id", "page", "x.*")


@query(f"WITH {CUR}, {_LISTED} SELECT novel_id, page, pos, url, title FROM titled JOIN first USING (novel_id, page, url)")
def json_walk(s, d):
    """References in what pages embed: objects with an address under several keys, of which one is no chapter's."""
    entry = F.struct(F.lit("/about").alias("url"), F.col("source_url").alias("href"), F.col("title").alias("name"), F.lit("/tag").alias("slug"))
    pages = _listed(chapters(s, d), F.struct("idx", "id", entry.alias("data")))
    embedded = F.concat(F.lit("<script type=x id='__NEXT_DATA__'>"), F.to_json(F.struct(F.struct(F.col("items").alias("list")).alias("props"))), F.lit("</script>"))
    found = jsonwalk.references(pages.select(F.struct("novel_id", "page").alias("at"), jsonwalk.embedded(embedded).alias("payload")), "at", "payload")
    return found.select("at.novel_id", "at.page", "pos", "url", "title")


@query("SELECT doc_id AS page_id, CASE WHEN length(text) > 500 THEN length(text) ELSE 2 * length(text) END AS n_chars, NOT coalesce(length(text) > 500, false) AS rendered FROM documents")
def page_snapshots(s, d):
    """Plain fetches that count, else rendered ones."""
    t = table(s, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    plain = t.select("page_id", F.when(F.col("text").isNull(), 404).otherwise(200).alias("status"), F.col("text").alias("html"), F.lit(False).alias("rendered"))
    rendered = t.select("page_id", F.lit(200).alias("status"), F.concat("text", "text").alias("html"), F.lit(True).alias("rendered"))
    return snapshots.with_fallback(plain.unionByName(rendered)).select("page_id", F.length("html").cast("long").alias("n_chars"), "rendered")


@query(f"SELECT id AS chapter_id, {NUMBER} IS NULL OR {NUMBER} = idx + 1 AS right_page FROM cur")
def right_page(s, d):
    c = chapters(s, d).select(F.col("id").alias("chapter_id"), (F.col("idx") + 1).cast("long").alias("expected"), U.chapter_number(F.col("source_url")).alias("actual"))
    return snapshots.checked(c, "expected", "actual").select("chapter_id", "right_page")


@query(f"""WITH {CUR}, {NATIVE} SELECT novel_id, CAST(count(*) AS INT) AS n_chapters FROM cur JOIN native n ON n.id = novel_id WHERE coalesce({strip('translated_text')} <> '', false) OR (n.native AND coalesce({strip('raw_text')} <> '', false)) GROUP BY novel_id""")
def epub_files(s, d):
    """Packages written to the shared folder, one for each book with chapters."""
    out = f"{shared_folder(s)}/epub-{uuid.uuid4().hex}"
    return epub.written_packages(epub_chapters(s, d), table(s, d, "novel"), out).select("novel_id", "n_chapters")


@query()
def translate_offline(s, d):
    """Pending chapters through the offline provider. A provider is no SQL; tested on fixtures."""
    rules = glossary.rules_in_order(table(s, d, "glossary_rule"))
    c = state.pending(chapters(s, d)).select(F.col("id").alias("chapter_id"), "raw_text")
    return translate.translated(c, translate.DictionaryProvider(), rules).select("chapter_id", "status", "error_message")


@query("SELECT job_type, status, count(*) AS n FROM job GROUP BY job_type, status")
def stream_ingest(s, d):
    """The job table taken up as a stream, once, with a checkpoint."""
    base = f"{shared_folder(s)}/ingest-{uuid.uuid4().hex}"
    taken = ingest.take_up(s, f"{d}/job.parquet*", JOB, f"{base}/sink", f"{base}/checkpoint")
    return taken.groupBy("job_type", "status").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(s, d):
    """Events by hour and type, counted in a stream with a watermark."""
    from bookflow.schemas import EVENT

    base = f"{shared_folder(s)}/windows-{uuid.uuid4().hex}"
    found = ingest.windowed_counts(s, f"{d}/events.parquet*", EVENT, f"{base}/sink", f"{base}/checkpoint")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
