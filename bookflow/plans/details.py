"""Further queries of the engine: links, metadata, settings, states and orders, registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bookflow.functions import html
from bookflow.functions import text as X
from bookflow.functions import urls as U
from bookflow.operators import refs, sites, state
from bookflow.plans.queries import BOOK, CUR, NATIVE, _host, _path, _LINES, _settings, available, chapters, env_parse, query, strip
from bookflow.session import table

# ---- links ----------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT novel_id, idx, id, p, [source_url, regexp_replace(source_url, '/chapter-.*$', '/chapters'), '/about', source_url][p] AS href FROM (SELECT DISTINCT novel_id, idx, id, source_url FROM chapter), (SELECT unnest(range(1, 5)) AS p)),
f AS (SELECT *, row_number() OVER (PARTITION BY novel_id, href ORDER BY idx, id, p) AS rn FROM l WHERE contains(href, '/chapter') AND NOT ends_with(href, '/chapters'))
SELECT novel_id, href, CAST(row_number() OVER (PARTITION BY novel_id ORDER BY idx, id, p) - 1 AS INT) AS new_idx FROM f WHERE rn = 1""")
def chapter_links(s, d):
    """Links of a book's pages that lead to a chapter and were not seen before, numbered as they come."""
    u = F.col("source_url")
    links = F.array(u, F.regexp_replace(u, "/chapter-.*$", "/chapters"), F.lit("/about"), u)
    each = table(s, d, "chapter").select("novel_id", "idx", "id", "source_url").distinct().select("novel_id", "idx", "id", F.posexplode(links).alias("p", "href"))
    first = refs.keep_first(each.where(U.is_chapter_link(F.col("href"))), "novel_id", "href", F.col("idx"), F.col("id"), F.col("p"))
    return refs.reindexed(first, "novel_id", F.col("idx"), F.col("id"), F.col("p"), bucket=refs.span(F.col("idx"))).select("novel_id", "href", "new_idx")


_PAGES = ("source_url || '?page=2'", "source_url || '/list/'", "source_url || '/chapter-5'", "'https://other.example/x'", "'?page=3'", "'/elsewhere'", _path("source_url") + " || '/more'")


@query("WITH p AS (SELECT id AS novel_id, unnest([1, 2, 3, 4, 5, 6, 7]) AS place FROM novel) SELECT novel_id, place, place IN (1, 2, 7) AS acceptable FROM p")
def pagination_links(s, d):
    """Which links of a book's page may lead to another page of its list."""
    u = F.col("source_url")
    links = F.array(F.concat(u, F.lit("?page=2")), F.concat(u, F.lit("/list/")), F.concat(u, F.lit("/chapter-5")), F.lit("https://other.example/x"), F.lit("?page=3"), F.lit("/elsewhere"), F.concat(U.path(u), F.lit("/more")))
    each = table(s, d, "novel").select(F.col("id").alias("novel_id"), "source_url", F.posexplode(links).alias("p", "link"))
    return each.select("novel_id", (F.col("p") + 1).alias("place"), U.acceptable_page(F.col("link"), u, U.host(u)).alias("acceptable"))


@query(f"SELECT id AS novel_id, '1-' || id AS shown, coalesce({BOOK} = id, true) AS own FROM novel")
def list_triggers(s, d):
    """Labels that open a range of chapters ("Chapters 1 - 50"), on pages that are still the book's."""
    labels = F.array(F.concat(F.lit("Chapters 1 - "), F.col("id").cast("string")), F.lit("Comments 1 - 2"), F.lit("chapter one"))
    each = table(s, d, "novel").select(F.col("id").alias("novel_id"), "source_url", F.explode(labels).alias("label")).where(F.col("label").rlike(refs.RANGE))
    shown = F.regexp_replace(F.regexp_extract("label", refs.RANGE, 1), r"\s", "")
    return each.select("novel_id", shown.alias("shown"), F.coalesce(U.book_number(F.col("source_url")) == F.col("novel_id"), F.lit(True)).alias("own"))


@query("SELECT n.id AS novel_id, (SELECT arg_min(s.site_id, s.priority) FROM site s WHERE contains(n.source_url, regexp_extract(s.base_url, '^[a-z]+://([^/]*)', 1)) OR contains(n.source_url, '/' || s.site_id || '-')) AS site_id FROM novel n")
def resolve_by_tokens(s, d):
    """The site of an address by any of several tokens: its host, or its name in a path."""
    site = table(s, d, "site").withColumn("tokens", F.array(F.concat(F.lit("/"), "site_id", F.lit("-"))))
    return table(s, d, "novel").select(F.col("id").alias("novel_id"), sites.resolved(F.col("source_url"), sites.registry(site)).alias("site_id"))


@query(f"SELECT id AS novel_id, regexp_replace(regexp_replace(lower({_host('source_url')}), '^www\\.', ''), '[^a-z0-9]+', '_', 'g') AS site_id, regexp_extract(source_url, '^([a-z]+://[^/]*)', 1) AS base_url, 100 AS priority, false AS is_native_arabic FROM novel")
def site_definition(s, d):
    """A definition to start from, for the site of each address."""
    return table(s, d, "novel").select(F.col("id").alias("novel_id"), sites.definition(F.col("source_url"), F.lit(100)).alias("x")).select("novel_id", "x.*")


# ---- metadata -------------------------------------------------------------------------------------------------------


@query(f"""SELECT id AS novel_id, coalesce({strip("regexp_replace(nullif(title, 'Unknown'), '[ \t]+', ' ', 'g')")}, 'Unknown Title') AS title,
CASE WHEN author IS NULL THEN 'علي حلمي' WHEN starts_with(lower(author), 'author:') THEN {strip('substr(author, 8)')} ELSE author END AS author,
coalesce(cover_url, {_host('source_url')} || '/series/c.jpg') AS cover_url, 'Drama|Magic' AS genres, 'A book of the site ' || source_site || ' that nobody has yet described in any words of their own.' AS description FROM novel""")
def book_metadata(s, d):
    """Pages of books: missing authors stand in the description's customary words, missing covers among the images, descriptions in a tab."""
    n = table(s, d, "novel")
    site = table(s, d, "site").select(F.col("site_id"), F.col("priority"))
    quoted = lambda c: F.replace(X.escaped(c), F.lit("'"), F.lit("&#39;"))
    head = F.when(F.col("author").isNull(), F.lit("<meta name=description content='رواية من تأليف المؤلف علي حلمي على موقعنا'>")).otherwise(F.lit(""))
    title = F.when(F.col("title") == "Unknown", F.lit("")).otherwise(F.concat(F.lit("<h1>"), X.escaped(F.col("title")), F.lit("</h1>")))
    author = F.coalesce(F.concat(F.lit("<b class=author>"), X.escaped(F.col("author")), F.lit("</b>")), F.lit(""))
    cover = F.when(F.col("cover_url").isNull(), F.concat(F.lit("<img src='x.png'><img src='"), U.host(F.col("source_url")), F.lit("/series/c.jpg'>"))).otherwise(F.concat(F.lit("<img alt='"), quoted(F.when(F.col("title") == "Unknown", F.lit("Unknown Title")).otherwise(F.col("title"))), F.lit("' src='"), quoted(F.col("cover_url")), F.lit("'>")))
    tab = F.concat(F.lit("<div role=tabpanel><p>Too short.<p>A book of the site "), "source_site", F.lit(" that nobody has yet described in any words of their own.</div>"))
    badges = F.lit("<span class=capitalize>Drama</span><span class=capitalize>Male</span><span class=capitalize>Magic</span><span class=capitalize>Drama</span>")
    pages = n.select(F.col("id").alias("page_id"), F.col("source_site").alias("site_id"), F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"), title, author, cover, badges, tab, F.lit("</body></html>")).alias("html"))
    chosen = site.select("site_id", F.create_map(F.lit("novel_title"), F.lit("h1"), F.lit("novel_author"), F.lit(".author, .by")).alias("selectors"))
    found = html.extracted(pages, chosen)
    return found.select(F.col("page_id").alias("novel_id"), "title", "author", "cover_url", F.array_join("genres", "|").alias("genres"), "description")


@query(f"SELECT id AS chapter_id, CASE id % 4 WHEN 0 THEN 'Node ' || id WHEN 1 THEN 'Given ' || id WHEN 2 THEN 'Chapter ' || id ELSE 'Chapter ' || (idx + 1) END AS title FROM cur")
def link_titles(s, d):
    """A link's title: of its node, its attribute, its own text cleaned, or its place."""
    k, n = F.col("id") % 4, F.col("id").cast("string")
    node = F.when(k == 0, F.concat(F.lit(" Node "), n))
    attribute = F.when(k <= 1, F.concat(F.lit("Given "), n, F.lit(" ")))
    raw = F.when(k <= 2, F.concat(n, F.lit(" Chapter "), n, F.lit(" 3 days ago"))).otherwise(F.lit(""))
    return chapters(s, d).select(F.col("id").alias("chapter_id"), X.titled(node, attribute, raw, F.col("idx") + 1).alias("title"))


@query(f"SELECT id AS novel_id, CASE WHEN description IS NULL THEN NULL WHEN length({strip('description')}) > 60 THEN description END AS description, array_to_string(list_distinct_in_order, '|') AS badges, {strip('source_site')} AS author FROM (SELECT *, [source_site, 'x', status] AS list_distinct_in_order FROM novel)")
def badges_and_authors(s, d):
    """The first long paragraph, badges in order without repeats, and the author in a description's customary words."""
    said = F.concat(F.lit("رواية المؤلف  "), "source_site", F.lit(" على الموقع"))
    badges = F.array(F.concat(F.lit(" "), "source_site"), F.lit("x"), F.col("source_site"), F.lit(""), F.col("status"), F.lit("x "))
    long = X.first_long(F.array_compact(F.array(F.lit("short"), F.col("description"))))
    return table(s, d, "novel").select(F.col("id").alias("novel_id"), long.alias("description"), F.array_join(X.distinct_badges(badges), "|").alias("badges"), X.arabic_author(said).alias("author"))


# ---- settings -------------------------------------------------------------------------------------------------------


@query(f"""WITH {_LINES}, k AS (SELECT name, CASE WHEN ends_with(name, '_API_KEY') THEN value WHEN ends_with(name, '_MODEL') THEN 'your_acme_api_key_here' ELSE value END AS value FROM env)
SELECT name, value <> 'your_acme_api_key_here' AS usable, length(value) < 20 AS short, starts_with(value, 'http') AS is_url FROM k""")
def provider_keys(s, d):
    """Which settings hold a usable key, a short one, an address."""
    k = env_parse(s, d).select("name", F.when(F.endswith("name", F.lit("_MODEL")), F.lit(" your_acme_api_key_here ")).otherwise(F.col("value")).alias("value"))
    return k.select("name", X.key_usable(F.col("value")).alias("usable"), X.key_short(F.col("value")).alias("short"), U.is_url(F.col("value")).alias("is_url"))


@query(f"WITH {_LINES} SELECT name, CASE WHEN ends_with(name, '_NOTE') THEN 'm|x' WHEN ends_with(name, '_MODEL') THEN 'm|small|large' ELSE 'm|' || array_to_string(list_filter(list_transform(string_split(value, ','), lambda v: trim(v)), lambda v: v <> ''), '|') END AS models, 'm' AS kept, CASE WHEN value = '' THEN '' ELSE trim(string_split(value, ',')[1]) END AS first_left FROM env")
def provider_models(s, d):
    """Lists of models with the default put first, and what the default becomes after it was taken away."""
    listed, default = F.col("value"), F.lit("m")
    models = X.models_with_default(listed, default)
    return env_parse(s, d).select("name", F.array_join(models, "|").alias("models"), X.default_after(models, default).alias("kept"), X.default_after(F.array_remove(models, "m"), default).alias("first_left"))


@query(f"""WITH {_LINES}, n AS (SELECT line_no, line, CASE WHEN contains(line, '=') AND NOT starts_with(line, '#') THEN trim(string_split(line, '=')[1]) END AS name FROM line),
k AS (SELECT 0 AS late, line_no, '' AS nm, CASE WHEN ends_with(name, '_MODEL') THEN name || '=large' ELSE line END AS line FROM n WHERE name IS NULL OR NOT ends_with(name, '_NOTE')),
a AS (SELECT 1 AS late, 0 AS line_no, upper(site_id) || '_TIMEOUT' AS nm, upper(site_id) || '_TIMEOUT=30' AS line FROM site)
SELECT CAST(row_number() OVER (ORDER BY late, line_no, nm) - 1 AS INT) AS line_no, line FROM (SELECT * FROM k UNION ALL SELECT * FROM a)""")
def env_file(s, d):
    """A settings file after an update, in its order and with its comments."""
    from bookflow.sources.config import patched_lines

    now, up = env_parse(s, d), F.upper("site_id")
    updates = now.where("endswith(name, '_MODEL')").select("name", F.lit("large").alias("new_value")).unionByName(table(s, d, "site").select(F.concat(up, F.lit("_TIMEOUT")).alias("name"), F.lit("30").alias("new_value")))
    return patched_lines(_settings(s, d), updates, now.where("endswith(name, '_NOTE')").select("name"))


@query("SELECT site_id, upper(regexp_replace(site_id, '[^A-Za-z0-9]+', '_', 'g')) || '_API_KEY' AS variable, row_number() OVER (ORDER BY site_id) AS place FROM site")
def site_variables(s, d):
    """Each site's variable, sites in the order of their names."""
    ordered = table(s, d, "site").agg(F.array_sort(F.collect_list("site_id")).alias("x")).select(F.posexplode("x").alias("p", "site_id"))  # a small configuration table
    return ordered.select("site_id", X.variable_name(F.col("site_id"), "API_KEY").alias("variable"), (F.col("p") + 1).cast("long").alias("place"))


# ---- states and orders ----------------------------------------------------------------------------------------------


def _allowed(steps: set[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in sorted(steps))


def _steps_sql(source: str, order: str, steps: set[tuple[str, str]]) -> str:
    return f"""WITH e AS (SELECT id, status, lag(status) OVER (PARTITION BY id ORDER BY {order}) AS before FROM ({source}))
SELECT before, status, (before IS NULL OR before = status OR (before, status) IN ({_allowed(steps)})) AS allowed, count(*) AS n FROM e GROUP BY ALL"""


@query(_steps_sql("SELECT DISTINCT id, status, updated_at FROM chapter", "updated_at, status", state.CHAPTER_STEPS))
def chapter_steps(s, d):
    """Changes of state between the versions of each chapter, and whether they may happen."""
    events = table(s, d, "chapter").select("id", "status", "updated_at").distinct()
    return state.steps(events, state.CHAPTER_STEPS, F.col("updated_at"), F.col("status")).groupBy("before", "status", "allowed").agg(F.count("*").alias("n"))


@query(_steps_sql("SELECT id, p AS updated_at, ['queued', CASE WHEN status = 'queued' THEN 'queued' ELSE 'running' END, status][p] AS status FROM (SELECT DISTINCT id, status FROM job), (SELECT unnest(range(1, 4)) AS p)", "updated_at", state.JOB_STEPS))
def job_steps(s, d):
    """The way of each job from the queue to its state, and whether its changes may happen."""
    way = F.array(F.lit("queued"), F.when(F.col("status") == "queued", "queued").otherwise("running"), F.col("status"))
    events = table(s, d, "job").select("id", "status").distinct().select("id", F.posexplode(way).alias("at", "status"))
    return state.steps(events, state.JOB_STEPS, F.col("at")).groupBy("before", "status", "allowed").agg(F.count("*").alias("n"))


@query("SELECT id AS chapter_id, novel_id, row_number() OVER (PARTITION BY novel_id ORDER BY TRY_CAST(x AS BIGINT) NULLS LAST, x, id) AS place FROM (SELECT id, novel_id, CASE WHEN id % 7 = 0 THEN 'n/a' ELSE CAST(idx AS VARCHAR) END AS x FROM cur)")
def numeric_order(s, d):
    """A column of texts in the order of their numbers, the others behind by their letters."""
    x = F.when(F.col("id") % 7 == 0, "n/a").otherwise(F.col("idx").cast("string"))
    c = chapters(s, d).select(F.col("id").alias("chapter_id"), "novel_id", x.alias("x")).withColumn("number", F.col("x").try_cast("bigint"))
    placed = refs.reindexed(c, "novel_id", F.asc_nulls_last("number"), F.col("x"), F.col("chapter_id"), bucket=refs.span(F.col("number")), name="place", start=1)
    return placed.select("chapter_id", "novel_id", F.col("place").cast("long").alias("place"))


@query("SELECT source_site, id AS novel_id, CASE WHEN place = n AND n > 1 THEN n - 1 WHEN place = n - 1 THEN n ELSE place END AS place FROM (SELECT source_site, id, row_number() OVER (PARTITION BY source_site ORDER BY id) AS place, count(*) OVER (PARTITION BY source_site) AS n FROM novel)")
def user_order(s, d):
    """An order of the user's own: the last book of each site is moved up by one."""
    w = Window.partitionBy("source_site")
    placed = table(s, d, "novel").select("source_site", F.col("id").alias("novel_id"), F.row_number().over(w.orderBy("id")).alias("pos"))
    last = placed.groupBy("source_site").agg(F.max("pos").alias("chosen"))
    return refs.moved(placed, last, "source_site", "pos", -1).select("source_site", "novel_id", F.col("pos").cast("long").alias("place"))


@query("SELECT id AS job_id, left(coalesce(error_message, ''), 50) AS shown, left(job_type || ': ' || status, 9) AS progress, CASE WHEN status = 'failed' THEN '[' || job_type || '] ' || coalesce(error_message, 'unknown error') || CASE WHEN coalesce(error_message, '') <> '' THEN ' Suggestion: try again' ELSE '' END END AS failure FROM jobs")
def failure_lines(s, d):
    """What a job's row shows: its message cut, and a failure in words."""
    m = F.col("error_message")
    failure = F.when(F.col("status") == "failed", X.failure_line(F.col("job_type"), m, F.when(F.coalesce(m, F.lit("")) != "", "try again")))
    return state.latest_jobs(table(s, d, "job")).select(F.col("id").alias("job_id"), F.left(F.coalesce(m, F.lit("")), F.lit(50)).alias("shown"), F.left(F.concat("job_type", F.lit(": "), "status"), F.lit(9)).alias("progress"), failure.alias("failure"))


@query("SELECT id AS novel_id, title, source_site FROM novel WHERE id = (SELECT min(id) FROM novel)")
def novel_by_id(s, d):
    """One book by its id."""
    n = table(s, d, "novel")
    wanted = n.agg(F.min("id").alias("id"))
    return n.join(F.broadcast(wanted), "id").select(F.col("id").alias("novel_id"), "title", "source_site")  # one row


@query(f"WITH {CUR}, {NATIVE} SELECT c.id AS chapter_id, CASE WHEN n.native AND coalesce({strip('raw_text')} <> '', false) THEN 'Ready (Arabic)' WHEN coalesce({strip('translated_text')} <> '', false) THEN 'Yes' ELSE '—' END AS ready, c.status IN ('failed') AS alarming FROM cur c JOIN native n ON n.id = novel_id")
def ready_labels(s, d):
    """What a chapter's row says about its text, and whether its state asks for attention."""
    label = F.when(F.col("native") & F.col("has_raw"), "Ready (Arabic)").when(F.col("has_translation"), "Yes").otherwise("—")
    return available(s, d).select(F.col("id").alias("chapter_id"), label.alias("ready"), F.col("status").isin("failed").alias("alarming"))
