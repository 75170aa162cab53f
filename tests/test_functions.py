"""Functions on hand-made cases."""

import re
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from bookflow.functions import html as H
from bookflow.functions import jsonwalk as J
from bookflow.functions import text as X
from bookflow.functions import urls as U
from bookflow.operators import epub, errors, glossary, sites, translate
from bookflow.operators.glossary import Rule
from bookflow.sources import config


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").select("i", column(F.col("x")).alias("y"))
    return [r["y"] for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_strip(spark):
    rows = ["\t\n x \n", " 　a b ", "", "  ", None, "\x1ca\x1f"]
    assert values(spark, rows, X.py_strip) == [None if r is None else r.strip() for r in rows]


def test_titles(spark):
    assert values(spark, ["12 Chapter 3: Dawn", "Dawn 3 days ago", "Chapter 4  1 hour ago", "7 nights"], X.clean_title) == ["Chapter 3: Dawn", "Dawn", "Chapter 4", "7 nights"]
    assert values(spark, ["Author: Ann", "author:  Bo ", "Cy", None], lambda x: X.without_prefix(x, "author:")) == ["Ann", "Bo", "Cy", None]
    best = lambda x: X.best_title(F.split(x, "/"), F.lit(None).cast("long"), F.lit(7))
    assert values(spark, ["#1/Chapter 1/Chapter 1: One", "ab/cd", "12/#", "", "Chapter 56 The Long Night/56 A very long line that says more", "56 Dawn/Chapter 56", "# 4 Dusk"], best) == ["Chapter 1: One", "ab", "Chapter 7", "Chapter 7", "Chapter 56 The Long Night", "Chapter 56", "Dusk"]


def test_paragraphs(spark):
    assert values(spark, ["a\nb\n\n \n\nc", "", "x"], X.paragraphs) == ["<p>a b</p>\n<p>c</p>", "", "<p>x</p>"]


def test_safe_title_and_mask(spark):
    assert values(spark, ["A/B: c? ", "كتابٌ", "!!!", None], lambda x: X.safe_title(x, F.lit(5))) == ["AB c", "كتاب", "novel_5", "novel_5"]
    assert values(spark, ["short", "sk-123456789", ""], X.masked) == ["*****", "sk-1••••••89", ""]


def test_percent_is_cut_like_floats(spark):
    df = spark.createDataFrame([(29, 100), (57, 100), (58, 100), (1, 3), (1, 0)], "a int, b int")
    assert [r[0] for r in df.select(X.percent(F.col("a"), F.col("b"))).collect()] == [28, 56, 57, 33, 0]


def test_urls(spark):
    u = ["https://h.example/a/b-7/chapter-12?x=1", "https://h.example/novel/9", "nonsense", None]
    assert values(spark, u, U.chapter_number) == [12, None, None, None]
    assert values(spark, u, U.book_number) == [7, None, None, None]
    base = F.lit("https://h.example/s/t?q")
    assert values(spark, ["/x", "//c.example/y", "z", "http://o.example"], lambda x: U.absolute(x, base)) == ["https://h.example/x", "https://c.example/y", "https://h.example/s/z", "http://o.example"]
    assert values(spark, ["https://h/x?a=1&tab=old&b=&c=2#f", "https://h/x"], lambda x: U.with_parameter(x, "tab", "new")) == ["https://h/x?a=1&tab=new&c=2#f", "https://h/x?tab=new"]
    assert values(spark, ["https://github.com/a/b/blob/main/c.py", "https://x/y"], U.raw_file) == ["https://raw.githubusercontent.com/a/b/main/c.py", "https://x/y"]


def test_glossary_in_order(spark):
    rules = [Rule("god", "إله"), Rule("god-level", "درجة"), Rule("Tier", "US$5\\1"), Rule("كتاب", "سفر")]
    rows = ["The God tier and godly god-level", "كتابٌ كتاب", "", None]

    def brute(t):
        for r in rules:
            word = all(c.isalnum() or c == "_" for c in r.source)
            around = r"(?<![^\W])%s(?![^\W])" if word else "%s"
            t = re.sub(around % re.escape(r.source), lambda _, x=r.target: x, t, flags=re.IGNORECASE)
        return t

    assert values(spark, rows, lambda x: glossary.replaced(x, rules)) == [None if r is None else brute(r) for r in rows]


def test_glossary_rules_are_bounded(spark):
    g = spark.createDataFrame([(2, "b", "B"), (1, "a", "A"), (3, "", "x"), (4, None, "y")], "id long, source_term string, target_term string")
    assert glossary.rules_in_order(g) == [Rule("a", "A"), Rule("b", "B")]


def test_empty_prompt(spark):
    assert glossary.prompt(spark.createDataFrame([], "id long, source_term string, target_term string")).first()[0] == glossary.PROMPT


def test_sites(spark):
    found = [("one", ["one.example", "two.other"]), ("any", ["example"])]
    assert values(spark, ["https://one.example/x", "https://two.example", "https://other", "https://two.other"], lambda x: sites.resolved(x, found)) == ["one", "any", None, "one"]


@pytest.mark.parametrize(("message", "limit", "provider"), [("HTTP 429 Too Many Requests", True, True), ("HTTP 401 no", False, True), ("Model not found", False, False), (None, False, False)])
def test_errors(spark, message, limit, provider):
    df = spark.createDataFrame([(message,)], "m string").select(errors.is_rate_limit(F.col("m")), errors.is_provider_issue(F.col("m")))
    assert tuple(df.first()) == (limit, provider)


PAGE = """<html><head><meta property='og:image' content='/c.jpg'></head><body><h1 class='t big'>A &amp; B</h1><div class='Latest-box'><a href='/chapter-9'>9</a></div>
<div id=box><p>one<br>two<p>three <b>x</b></p><script>var a='</p>'</script></div><ul class=toc><li><a href='/chapter-1'>One</a><li><a href=''>none</a><a href='/chapter-2'>Two</a></ul></body></html>"""


def test_html():
    root = H.parse(PAGE)
    assert H.first_text(root, "h2, h1.t.big") == "A & B"
    assert H.first_text(root, ".missing") is None
    assert H.first_text(H.parse("<i class=a></i><b>x</b>"), ".a, b") == ""
    assert H.first_attribute(root, "meta[property='og:image']", "content") == "/c.jpg"
    assert H.links(root, ".toc a[href*='chapter']") == [("One", "/chapter-1"), ("Two", "/chapter-2")]
    assert H.body(root, "#none, #box") == "one two\n\nthree x"
    assert H.body(H.parse("<div id=box>a<br>b</div>"), "#box") == "a\nb"
    assert H.body(root, "article") == ""
    assert H.longest_paragraphs(H.parse("<div><p>a<p>b<p>c</div>")) == "a\n\nb\n\nc"
    assert H.has_ancestor_class(next(H.select(root, "div a")), ("latest",))
    assert H.parse(None).text() == ""
    assert len(list(H.parse("<div>" * 5000).walk())) == 5000


def test_json_walk():
    c = "/chapter-"
    text = f'{{"a":[{{"url":"{c}1","href":"{c}9","title":" ","chapterTitle":"x","sub":{{"href":"/about","path":"{c}2"}}}},{{"link":"{c}3","label":"no"}},{{"url":"{c}3","name":"y"}}]}}'
    assert [(x["url"], x["titles"]) for x in J.walked(text)] == [(f"{c}9", ["x"]), (f"{c}2", []), (f"{c}3", ["y"])]
    assert J.walked("{broken") == [] and J.walked(None) == []


def test_package():
    out = BytesIO()
    p = epub.Package(out, 1, "A & B", "Ann", "Of a <river>.", b"jpg")
    p.add("text/chapter_0000.xhtml", "<1>", "<p>x</p>")
    p.add("text/chapter_0000.xhtml", "2", "<p>y</p>")
    p.close()
    z = zipfile.ZipFile(BytesIO(out.getvalue()))
    assert z.read("OEBPS/cover.jpg") == b"jpg" and "Of a &lt;river&gt;." in z.read("OEBPS/text/cover.xhtml").decode() and "text/chapter_0000_2.xhtml" in z.namelist()[4] + z.namelist()[5] + z.namelist()[6]
    assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert "A &amp; B" in z.read("OEBPS/content.opf").decode() and 'page-progression-direction="rtl"' in z.read("OEBPS/content.opf").decode()
    assert z.read("OEBPS/nav.xhtml").decode().count("<li>") == 2


class Failing:
    name = "failing"

    def __init__(self, message):
        self.message = message

    def available(self):
        return False

    def translate(self, text, rules):
        raise RuntimeError(self.message)


def test_translation(spark):
    df = spark.createDataFrame([(1, "The old map"), (2, " "), (3, None)], "chapter_id long, raw_text string")
    done = {r["chapter_id"]: (r["status"], r["translated_text"], r["error_message"]) for r in translate.translated(df, translate.DictionaryProvider(), [Rule("old map", "خريطة")]).collect()}
    assert done == {1: ("translated", "The خريطة", None), 2: ("failed", None, "no text"), 3: ("failed", None, "no text")}
    failed = translate.translated(df.where("chapter_id = 1"), Failing("HTTP 429"), [], wait=lambda k, m: 0).first()
    assert (failed["status"], failed["error_message"]) == ("failed", "HTTP 429")
    assert translate.chosen([Failing(""), translate.DictionaryProvider()]).name == "dictionary"
    with pytest.raises(ValueError):
        translate.chosen([translate.DictionaryProvider()], "nobody")


def test_attempts_and_ways():
    assert [translate.wait_before(k, "boom") for k in range(1, 7)] == [2, 4, 8, 16, 30, 30] and translate.wait_before(1, "HTTP 429 too many requests") == 80
    both = translate.FirstOf([Failing("no stream"), translate.DictionaryProvider()])
    assert both.translate("a", []) == "a" and both.available()
    with pytest.raises(RuntimeError, match="no stream.*empty result"):
        translate.FirstOf([Failing("no stream"), translate.DictionaryProvider()]).translate(" ", [])


def test_job_control(spark):
    from concurrent.futures import CancelledError

    job = translate.JobControl(spark, "group")
    assert job.run([lambda: spark.range(3).count(), lambda: 5]) == [3, 5]
    with pytest.raises(CancelledError):
        job.run([lambda: 1, job.cancel, lambda: 2])


def test_links_and_pages(spark):
    u = "https://h.example/b/1?tab=about&page=2&page=3&x=&q=a%20b#f"
    assert values(spark, [u, "https://h.example/b"], lambda x: U.with_parameter(x, "tab", "toc")) == ["https://h.example/b/1?tab=toc&page=3&q=a+b#f", "https://h.example/b?tab=toc"]
    assert values(spark, ["/b/chapter-1", "/b/chapters", "/b", None], U.is_chapter_link) == [True, False, False, False]
    keys = ["your_acme_api_key_here", "<YOUR_API_KEY>", " ", None, "sk-1"]
    assert values(spark, keys, X.key_usable) == [False, False, False, False, True]


def test_three_tiers():
    a = "<a href='/n/1/chapter-1'>1</a>"
    refs = lambda page, sel=None, url=None: [(r["href"], r["titles"]) for r in H.chapter_references(H.parse(page), sel, url)]
    assert refs(f"<p>{a}<a href='/n/1/chapters'>all</a></p>") == [("/n/1/chapter-1", ["1"])]
    assert refs(f"<div class='x latest-list'>{a}</div><div class=recent-widget><a href='/n/1/chapter-2'><span>Two</span></a></div>") == [("/n/1/chapter-2", ["Two", "Two"])]
    assert refs(f"<ul class=my-toc-list-x>{a}</ul><a href='/n/1/chapter-3'>3</a>") == [("/n/1/chapter-1", ["1"])]
    assert refs(f"<ol><li>{a}</li></ol><a href='/n/2/chapter-3'>3</a>", "ol li", "https://h.example/n/1") == [("https://h.example/n/1/chapter-1", ["1"])]


def test_metadata():
    m = H.metadata(H.parse("<h1>T</h1><i class=author>Author: Ann</i><img src=a.png><img alt=T src=/c.png><div role=tabpanel><p>x<p>" + "y" * 61 + "</div>"), {"novel_title": "h1", "novel_author": ".author"}, "https://h.example/n")
    assert (m["title"], m["author"], m["cover_url"], m["description"], m["genres"]) == ("T", "Ann", "https://h.example/c.png", "y" * 61, [])
    m = H.metadata(H.parse("<meta name=description content='رواية المؤلف علي العلي على موقع'>"), {})
    assert (m["title"], m["author"], m["cover_url"], m["description"]) == ("Unknown Title", "علي العلي", None, None)


def test_counts_read_no_text(spark, data):
    """Queries that only count or order chapters neither read nor shuffle a text."""
    from bookflow.plans.queries import QUERIES

    for name in ("chapter_stats", "pending_counts", "schedule_topk", "schedule_totals", "chapter_ref_order", "status_totals", "pending_translation", "pending_scrape", "selected_in_order", "reverse_if_desc", "toggle_checks", "affected_counts", "valid_chapter_url", "foreign_novel_guard"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "_text" not in plan, name


def test_definitions_of_a_folder(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"s": {"base_url": "https://late.example"}, "a": {"base_url": "https://a.example"}}')
    (tmp_path / "a.json").write_text('{"s": {"base_url": "https://early.example"}}')
    assert [(r["site_id"], r["base_url"]) for r in config.read_definitions(spark, str(tmp_path)).collect()] == [("a", "https://a.example"), ("s", "https://late.example")]


def test_packages_are_written(spark, tmp_path):
    rows = [(1, i + 1, f"text/chapter_{i:04d}.xhtml", f"t{i}", "<p>x</p>") for i in range(30)] + [(2, 1, "text/chapter_0000.xhtml", "t", None)]
    chapters = spark.createDataFrame(rows, "novel_id long, place int, file_name string, title string, html string")
    novels = spark.createDataFrame([(1, "A", "Ann", "About.", "https://h.example/c1.jpg?x"), (2, "B", None, None, None), (3, "C", None, None, None)], "id long, title string, author string, description string, cover_url string")
    images = epub.covers(spark.createDataFrame([("file:/x/c1.jpg", bytearray(b"jpg"))], "path string, content binary"), novels)
    got = {r["novel_id"]: r for r in epub.written_packages(chapters, novels, f"file://{tmp_path}/out", images).collect()}
    assert {k: v["n_chapters"] for k, v in got.items()} == {1: 30, 2: 1}
    z = zipfile.ZipFile(got[1]["path"])
    assert z.testzip() is None and z.namelist()[0] == "mimetype" and z.read("OEBPS/cover.jpg") == b"jpg" and z.read("OEBPS/nav.xhtml").decode().count("<li>") == 30
    assert got[1]["n_bytes"] == (tmp_path / "out" / "1.epub").stat().st_size and len(list((tmp_path / "out").iterdir())) == 2


def test_config_files(spark, tmp_path):
    (tmp_path / "sites.json").write_text('{"s": {"base_url": "https://s.example", "selectors": {"a": "b"}, "use_curl_cffi": true}}')
    (tmp_path / "rules.json").write_text('{"rules": [{"id": 1, "source_term": "a", "target_term": "b"}], "other": 1}')
    (tmp_path / "env").write_text("# x\n\nA=1\nB=2=3\nA= 4 \nnothing\n")
    site = config.read_sites(spark, str(tmp_path / "sites.json")).first()
    assert site["site_id"] == "s" and site["selectors"] == {"a": "b"} and site["use_curl_cffi"]
    assert config.read_glossary(spark, str(tmp_path / "rules.json")).first()["target_term"] == "b"
    assert dict(config.settings(config.read_lines(spark, str(tmp_path / "env"))).collect()) == {"A": "4", "B": "2=3"}


def test_stream_takes_files_once(spark, tmp_path):
    from bookflow.streaming.ingest import take_up

    spark.range(3).write.parquet(str(tmp_path / "in"))
    schema = "id long"
    run = lambda: take_up(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp")).count()
    assert run() == 3 and run() == 3
    spark.range(2).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == 5


def test_empty_tables(spark):
    from bookflow import schemas
    from bookflow.operators import state

    empty = spark.createDataFrame([], schemas.CHAPTER)
    assert state.current(empty).count() == 0
    assert state.recovered(empty).count() == 0
