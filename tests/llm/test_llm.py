"""The training-data operators on small fixtures and against brute force."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from bookflow.llm import alignment, boilerplate, encoding, kernel, language, mixing, quality, residue, residue_rules, truncation
from bookflow.llm.queries import QUERIES, SQL
from compare import check

CHAPTER = "id long, novel_id long, idx int, title string, source_url string, raw_text string, translated_text string, status string, updated_at timestamp_ntz, text string"


def chapters(spark, rows):
    """rows: (id, novel_id, raw_text, translated_text); one column more, whose name clashes with the operators' own."""
    return spark.createDataFrame([(i, n, 0, "t", "u", r, t, "scraped", None, "other") for i, n, r, t in rows], CHAPTER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    check(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_finds_rows_in_the_smallest_tables(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() > 0 and df.columns


# ---- kernel ---------------------------------------------------------------------------------------------------------


def brute_sentences(text):
    out = []
    for line in re.split(r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]", text):
        start = 0
        for m in re.finditer(r"[.!?…؟！？]+[\"”“»'’)\]]*(?=\s|$)|。[\"”“»'’)\]]*", line):
            out.append(line[start : m.end()])
            start = m.end()
        out.append(line[start:])
    return [s for s in out if any(c.isalpha() for c in s)]


def test_sentences_like_brute_force():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab .!?…؟。”»')\n\r 1") for _ in range(rng.randrange(60))) for _ in range(400)] + ["", "x", "A.b. C", "«هل؟» نعم.", "他说。”走了。"]
    for t in texts:
        cp, _ = kernel.codepoints([t])
        got = [t[a:b].rstrip("\n") for a, b in zip(*kernel.sentences(cp))]
        assert [g.strip() for g in got] == [w.strip() for w in brute_sentences(t)], repr(t)


def test_slices_keep_everything():
    texts = ["x" * n for n in (0, 5, 300_000, 7, 99_999, 1)]
    parts = list(kernel.slices(list(range(6)), texts))
    assert [i for a, _ in parts for i in a] == list(range(6)) and [t for _, b in parts for t in b] == texts


def test_hashes_do_not_depend_on_their_neighbours():
    words = ["gong", "a" * 64, "b" * 65, "c" * 500, "lamp"]
    of = lambda ws: dict(zip(ws, kernel.run_hashes(*(lambda cp, st: (cp, st[:-1], st[1:] - 1))(*kernel.codepoints(ws))).tolist()))
    alone = {w: of([w])[w] for w in words}
    assert of(words) == alone and len(set(alone.values())) == len(words)


# ---- p1 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("line", ["{{ entry.title }}", "x ${hero} y", "%chapter-title%", "__post-html__", "[INSERT TEXT HERE]", "Dear %s,", "{0} ran", "Post undefined: undefined", "404", "502 Bad Gateway", "asdf test test", "Lorem ipsum dolor sit amet", "Please enable JavaScript to read this chapter (1).", "~ Coming soon ~", "text goes here. text goes here.", "سيضاف الفصل قريبًا، هذا نص مؤقت."])
def test_residue_lines(line):
    assert residue_rules.is_residue(line)


@pytest.mark.parametrize("line", ["Our servers are overloaded right now, please refresh the page in a minute.", "This website requires cookies to be enabled in your browser.", "Connection to the upstream server timed out.", "403 Forbidden", "Error 503", "TypeError: x is null", "Verification failed: complete the captcha to view this page.", "The requested resource was moved or deleted from the server.", "Login session expired; reload to retry.", "حدث خطأ في الخادم، يرجى تحميل الصفحة"])
def test_residue_in_words_of_no_list(line):
    """Notices whose wordings stand nowhere in the rules."""
    assert residue_rules.is_residue(line)


@pytest.mark.parametrize("line", ["She opened the file and read the last page by the light of the browser.", "The host closed the gateway before dawn and nobody was permitted to return.", "An error of judgment, he called it, and the judge agreed.", "The security of the port was his to keep.", "Server", "The script of the play lay open on the table, its pages yellow.", "{Quest updated: reach Orlen within 5 days}", "<Status of Ann: poisoned, 5% mana left>", "[Skill acquired: Iron Root (rank 3)]", "<<Ann has joined the raid on Orlen>>", "Ann copied the words lorem ipsum onto the slate 5 times.", 'The voice told Ann, "access denied, host level below 4."', "The door showed only three words, page not found, and Ann sighed.", "It was a test of his will.", "100% of 5% is", ""])
def test_story_lines(line):
    assert not residue_rules.is_residue(line)


def test_no_line_is_passed_over():
    """The quick search for lines that may be residue leaves out none that the rules name."""
    rng = random.Random(8)
    known = ["Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi.", "Sed do eiusmod tempor incididunt ut labore.", "“TBD”", "Coming\u2060 soon", "  *502\u2003Bad  Gateway*", "ASDF\tqwerty", "1) TODO", "_placeholder_", "x {{ y }}", "Please\xa0enable Java\u00adScript", "404", "null", "نص  تجريبي", "Lorem\u200b ipsum dolor sit amet", "it was a test", "the food was late", "He said: not found.", "", " ", "\x0btest\x0b"]
    texts = []
    known += ["Our servers are overloaded right now, please refresh the page.", "Cookies must be enabled in your browser."]
    pieces = ["\r", "~ ", "* ", "\u200b", "\u00ad", " ", "  ", "\t", "\xa0", "”", "!", ".", "9", "_", "—"]
    for _ in range(400):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            x = rng.choice(known)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(x) + 1)
                x = x[:at] + rng.choice(pieces) + x[at:]
            lines.append(x)
        text = rng.choice(["\n", "\r\n", "\n\n"]).join(lines)
        texts.append(text)
    # the same lines are trusted where candidates come from hashed words
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    got = {(r["chapter_id"], r["line_no"]) for out in residue._lines(iter([batch])) for r in out.select(["chapter_id", "line_no", "trusted"]).to_pylist() if r["trusted"]}
    seen = {(r["chapter_id"], r["line_no"]) for out in residue._lines(iter([batch])) for r in out.select(["chapter_id", "line_no"]).to_pylist()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, _ in residue_rules.residue_lines(residue_rules.visible(t))} & seen


def test_residue_chapters(spark):
    story = " ".join(f"Ann walked to town number {i} and bought bread." for i in range(30))
    long_notice = "Your session has expired because the reader was away for a long time and the server removed its token from the table of open readers tonight so please sign in again now"
    near = long_notice.replace("Your session has expired", "Sorry but your session has expired")
    far = "The river rose in the night and nobody in the village of the seven mills slept while the water came nearer to the doors of the houses and the sheep cried on the hill"
    rows = [(1, 1, None, None), (2, 1, "", None), (3, 1, " \n ", None), (4, 1, story, None), (5, 1, story + "\n{{name}} came.", None), (6, 1, "404", None), (6, 1, "404", None), (7, 1, story + "\n404", None), (8, 1, "Ann slept.\n502 Bad Gateway", None), (9, 1, long_notice, None), (10, 1, near, None), (11, 1, far, None), (12, 1, "x" * 200_000, None), (None, 1, "404", None)]
    assert sorted(r["chapter_id"] for r in residue.residue_chapters(chapters(spark, rows)).collect()) == [5, 6, 8, 9, 10]
    assert residue.residue_chapters(chapters(spark, [])).count() == 0


def test_residue_of_short_lines(spark):
    notice = "Your session has expired, code 336. Reload this page."
    eight = "Your session has expired, please sign in again."
    rows = [(1, 1, notice, None), (2, 1, "Notice: " + notice, None), (3, 1, eight, None), (4, 1, "Sorry " + eight, None), (5, 1, "Sorry, they said, " + eight, None)]
    assert sorted(r["chapter_id"] for r in residue.residue_chapters(chapters(spark, rows)).collect()) == [1, 2, 3, 4]


def test_residue_of_slots_without_words(spark):
    rows = [(1, 1, "{{ }}", None), (2, 1, "{%%}", None), (3, 1, "...", None), (4, 1, "Ann slept.\n{{ }}", None)]
    assert sorted(r["chapter_id"] for r in residue.residue_chapters(chapters(spark, rows)).collect()) == [1, 2, 4]


def test_only_trusted_lines_are_grouped(spark, monkeypatch):
    plans = {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return df

    monkeypatch.setattr(residue, "written", seen)
    residue.propagated(spark.createDataFrame([], residue.LINES)).count()
    assert plans["residue-keys"].startswith("Aggregate")


def test_residue_links_like_brute_force(spark):
    """No pair of lines at a similarity of 0.8 or more is missed, and none below it is linked, whatever their length."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(3))
    texts = []
    for _ in range(150):
        line = ["your", "session", "has", "expired"] + [word() for _ in range(rng.randrange(4, 40))]
        other = list(line)
        for _ in range(rng.randrange(1, 4)):
            other.insert(0, word()) if rng.random() < 0.7 else other.pop()
        texts += [line, ["sorry"] + other]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    linked = {i for i, t in enumerate(texts) if t[0] == "your"}
    new = set(linked)
    while new:
        new = {j for j in range(len(texts)) if j not in linked and any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i in new)}
        linked |= new
    assert 180 < len(linked) < len(texts)
    got = residue.residue_chapters(chapters(spark, [(i, 1, " ".join(t), None) for i, t in enumerate(texts)]))
    assert {r["chapter_id"] for r in got.collect()} == linked


# ---- p2 -------------------------------------------------------------------------------------------------------------


def test_truncation(spark):
    rng = random.Random(5)
    names, places = ["Ann", "Bob", "Cyd", "Dan", "Eve"], ["Orlen", "Tavrin", "Mudgate", "Greyfen"]
    make = lambda: rng.choice([f"{rng.choice(names)} carried the lamp to {rng.choice(places)}", f"The gong of {rng.choice(places)} sounded for {rng.choice(names)}", f"Nobody in {rng.choice(places)} believed {rng.choice(names)}"])
    rows, cut = [], set()
    for i in range(300):
        body = ". ".join(make() for _ in range(6)) + "."
        last = make()
        if i % 10 == 0:
            end = last[: rng.randrange(6, len(last) - 6)]
            body, _ = body + " " + end + rng.choice(["", "...", "\n", "</", "�"]), cut.add(i)
        elif i % 10 == 1:
            body += " " + last
        elif i % 10 == 2:
            body += "\n\nThe end of part"
        elif i % 10 == 3:
            body += " " + last + "..."
        rows.append((i, 1, "x", body))
    rows += [(1000, 1, "x", None), (1001, 1, "x", " "), (1002, 1, "x", "***"), (0, 1, "x", rows[0][3])]
    got = {r["chapter_id"] for r in truncation.found(chapters(spark, rows)).collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 3
    assert truncation.found(chapters(spark, [])).count() == 0


def _odd_texts(n, seed):
    """Texts with long and short sentences, runs of digits and blanks, marks, and quotes behind end marks."""
    rng = random.Random(seed)
    parts = ["abc", "نور", "ال\u064bخ", "0000000", "7", "    ", " ", "\n", ". ", ".\" ", "؟» ", "。”", "!)", "他说", "...", "�", "\u0301", "x" * 50, "9" * 70, " " * 90]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 120))) for _ in range(n)] + ["", ".", "a", "7" * 400, "a" + " " * 400 + "b", "a. " + "»" * 300, "Yes. " + "b" * 300 + "."]


def test_contexts_at_the_end_are_those_of_the_whole_text():
    texts = _odd_texts(600, 4)
    whole = truncation._last_contexts(texts, 10**6)
    assert truncation._last_contexts(texts) == whole and truncation._last_contexts(texts, 45) == whole
    assert sum(x is None for x in whole) < 100


def test_only_ends_of_texts_are_looked_at(monkeypatch):
    import pyarrow as pa

    seen = []
    symbols = truncation._symbols
    monkeypatch.setattr(truncation, "_symbols", lambda texts: seen.extend(map(len, texts)) or symbols(texts))
    texts = ["The lamp stood by the gate of Orlen. " * 50 + end for end in ("Ann saw it.", "Ann saw")] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    assert sum(len(b) for b in truncation._tails()(iter([batch]))) == len(texts)
    assert max(seen) <= truncation.END


def test_first_contexts_like_those_looked_up():
    sym, start, _, _ = truncation._symbols(_odd_texts(100, 5))
    contexts = truncation._Contexts(sym, start)
    assert np.array_equal(contexts.first(), contexts.at(np.arange(len(sym)), 0))


def test_end_marks_like_a_pattern():
    pattern = re.compile(r"(?:[!?؟！？。]|(?<!\.)\.)[\"”“»'’)\]]*$")
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab .!؟。”»')…") for _ in range(rng.randrange(9))).strip() for _ in range(2000)] + ["a." + "»" * 300, ".", "..", "»"]
    assert [truncation._ended(t) for t in texts] == [bool(pattern.search(t[-truncation.TAIL :])) for t in texts]


def test_thresholds_lie_between_the_kinds():
    whole, inner = np.zeros(80), np.zeros(80)
    whole[60:] = 10
    inner[:40] = 10
    assert 4 < truncation.best_threshold(whole, inner) - truncation.LOWEST <= 6
    inner[70] += 20  # places that may end a sentence too don't move it
    assert 4 < truncation.best_threshold(whole, inner) - truncation.LOWEST <= 6


def test_log_odds_of_counts_of_any_size(spark):
    """Ends (or places that go on) seen so often that their share rounds to 1 have odds all the same."""
    n = len(truncation.LEVELS)
    rows = spark.createDataFrame([(1, list(range(n))), (2, list(range(n, 2 * n))), (3, list(range(2 * n, 3 * n)))], "chapter_id long, contexts array<long>")
    seen = [(10**5, 0), (0, 10**5), (3, 1)]
    counts = spark.createDataFrame([(k * n + j, *seen[k]) for k in range(3) for j in range(n)], "ctx long, n_end long, n_on long")
    got = {r["chapter_id"]: r["log_odds"] for r in truncation._odds(truncation._of(rows, "contexts"), counts).collect()}
    for k, (e, o) in enumerate(seen):
        p, q = Fraction(str(truncation.PRIOR)), 1 - Fraction(str(truncation.PRIOR))
        for _ in range(n):
            p, q = (x + Fraction(truncation.BACKOFF) * y for x, y in ((e, p), (o, q)))
            p, q = p / (p + q), q / (p + q)
        assert got[k + 1] == pytest.approx(math.log(p) - math.log(q), abs=1e-6)


def test_thresholds_come_from_all_texts(spark, monkeypatch):
    """Every text that a mark ends gives its end, however many they are, and another place unless that is the end itself."""
    rows = [(i, 1, "x", f"Ann carried the lamp to gate {'abcdefghij'[i % 10] * 3} of Orlen.") for i in range(12_000)]
    seen = []
    best = truncation.best_threshold
    monkeypatch.setattr(truncation, "best_threshold", lambda whole, inner: seen.append((whole.sum(), inner.sum())) or best(whole, inner))
    truncation.scored(chapters(spark, rows))
    whole, inner = max(seen)
    assert whole == 12_000 and 0.95 * whole < inner <= whole


def test_bitmap_grows_with_the_contexts():
    assert truncation._bits(0) == truncation._bits(1000) == truncation.LEAST_BITS and truncation._bits(10**9) == truncation.MOST_BITS
    assert truncation.LEAST_BITS < truncation._bits(5_000_000) < truncation.MOST_BITS


def test_cuts_in_two_languages(spark):
    """Each language of a column has its cuts found by its own threshold."""
    rng = random.Random(7)
    ar = lambda: f"حمل {rng.choice(['سيلكا', 'تولميك', 'ميريل', 'كورفان'])} المصباح إلى {rng.choice(['أورلن', 'تافرين', 'مدغيت'])}"
    en = lambda: f"{rng.choice(['Ann', 'Bob', 'Cyd', 'Dan'])} carried the lamp to the old gate of {rng.choice(['Orlen', 'Tavrin', 'Mudgate'])}"
    rows, cut = [], set()
    for i in range(600):
        make = en if i % 3 == 0 else ar
        body = ". ".join(make() for _ in range(5)) + "."
        if i % 12 < 2:
            last = make()
            body += " " + last[: rng.randrange(6, len(last) - 6)]
            cut.add(i)
        rows.append((i, 1, "x", body))
    got = {r["chapter_id"]: r for r in truncation.scored(chapters(spark, rows)).collect()}
    assert all(truncation.LOWEST < r["threshold"] < truncation.HIGHEST for r in got.values())
    found = {i for i, r in got.items() if r["cut"]}
    for own in ({i for i in cut if i % 3 == 0}, {i for i in cut if i % 3}):
        assert len(found & own) >= 0.9 * len(own)
    assert len(found - cut) <= 5


# ---- p3 -------------------------------------------------------------------------------------------------------------


def test_labels(spark):
    from pyspark.sql import functions as F

    rows = [" en ", "EN", "en-US", "English", "Arabic", "zh_CN", "und", "-", "", "N/A", None, "unknown", "it"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(language.code_of(F.col("x"))).collect()]
    assert got == ["en", "en", "en", "en", "ar", "zh", None, None, None, None, None, None, None]
    assert [r[0] for r in df.orderBy("i").select(F.coalesce(language.names_another(F.col("x")), F.lit(False))).collect()][-1]


def test_language_on_held_out_lines():
    held = {"en": "The farmer went home before the rain began", "fr": "Le fermier rentra chez lui avant que la pluie ne commence", "es": "El granjero volvió a casa antes de que empezara la lluvia", "de": "Der Bauer ging nach Hause, bevor der Regen begann", "ar": "عاد المزارع إلى بيته قبل أن يبدأ المطر", "fa": "کشاورز پیش از آغاز باران به خانه برگشت", "zh": "农夫在下雨之前回家了"}
    matrix = language.fit([], [], [])
    gram, first, _, _, _ = language.features(list(held.values()))
    assert [language.LANGUAGES[i] for i in language.scores(gram, first, matrix).argmax(axis=1)] == list(held)


def test_language_cases(spark):
    matrix = language.fit([], [], [])
    en, de = "The gong of the town sounded and the guards said nothing at all.", "Der Bauer ging nach Hause und die Wache sagte nichts von dem Regen."
    rows = [(1, 1, en, None), (2, 1, en + " " + en + "\n\n" + de, " "), (3, 1, "12\n---", None), (4, 1, en, None), (5, 1, en, None), (5, 1, en, None), (6, 1, en * 2000, None)]
    labels = spark.createDataFrame([(1, "en", None), (2, "en", None), (4, "fr", None), (5, "N/A", None)], "chapter_id long, raw_lang string, translated_lang string")
    got = {(r["chapter_id"], r["field"]): r for r in language.texts_with_labels(chapters(spark, rows), labels, matrix).collect()}
    assert set(got) == {(i, "raw_text") for i in (1, 2, 4, 5, 6)}
    flags = {k[0]: (r["unlabelled"], r["mislabelled"], r["mixed"]) for k, r in got.items()}
    assert flags == {1: (False, False, False), 2: (False, False, True), 4: (False, True, False), 5: (True, False, False), 6: (True, False, False)}
    assert [s["lang"] for s in got[2, "raw_text"]["segments"]] == ["en", "de"] and got[2, "raw_text"]["segments"][1]["first_line"] == 2


# ---- p4 -------------------------------------------------------------------------------------------------------------


def test_boilerplate(spark):
    novels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, source_site string")
    rows = [(i, 1 + i % 2, f"Story line {chr(97 + i) * 3}.\r\nRead MORE at a.example {i}!\n***", None) for i in range(8)]
    rows += [(0, 1, rows[0][2], None), (20, 3, "read more at a.example", None), (21, 4, "x", None), (22, 1, None, None), (23, 1, " ", None)]
    got = sorted(map(tuple, boilerplate.found(chapters(spark, rows), novels).collect()))
    assert got == [(i, 1) for i in range(8)]
    clean = {r["chapter_id"]: r for r in boilerplate.cleaned(chapters(spark, rows), novels).collect()}
    assert clean[0]["clean_text"] == "Story line aaa.\r\n***" and clean[0]["n_removed"] == 1 and clean[20]["n_removed"] == 0 and 22 not in clean
    stat = boilerplate.statistics(chapters(spark, rows), novels).first()
    assert (stat["n_chapters"], stat["n_clusters"], stat["n_site"]) == (8, 8, 8)
    assert boilerplate.found(chapters(spark, []), novels).count() == 0


def test_republished_chapters_are_no_boilerplate(spark):
    """One chapter under eight ids: by ids all of its lines are frequent, by clusters only the notice that other chapters have too."""
    import datetime

    novels = spark.createDataFrame([(1, "a")], "id long, source_site string")
    rows = [(i, f"The river rose, {i}.\nNobody slept that night.\nRead more at a.example") for i in range(8)] + [(20 + i, f"Story {chr(97 + i) * 4}.\nRead more at a.example") for i in range(5)]
    df = spark.createDataFrame([(i, 1, t, datetime.datetime(2024, 1, 1 + i % 3)) for i, t in rows], "id long, novel_id long, raw_text string, updated_at timestamp")
    by = lambda x: {(r["chapter_id"], r["line_no"]) for r in boilerplate.found(df, novels, by=x).collect()}
    notices = {(i, t.count("\n")) for i, t in rows}
    assert by("cluster") == notices
    assert by("chapter_id") == notices | {(i, j) for i in range(8) for j in (0, 1)}


# ---- p5 -------------------------------------------------------------------------------------------------------------


def test_pairs_of_sentences_that_end_very_many_texts(spark):
    two = [("Nobody carried the old lamp to the gate of the town.", "لم يحمل أحد المصباح القديم إلى بوابة المدينة الكبيرة."), ("Seven merchants counted silver coins until their boat left.", "عد سبعة تجار نقودا فضية حتى غادر قاربهم في الصباح الباكر.")]
    same = chapters(spark, [(i, 1, *two[i % 2]) for i in range(4000)])
    got = alignment.found(same, spark.createDataFrame([], "chapter_id long"), truncation.found(same))
    assert got.distinct().count() == 4000


def _batch(*columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list("abcdefgh")[: len(columns)])


@pytest.mark.parametrize("text", ["...", "***", "«»", "…", "12", "x"])
def test_a_batch_of_one_text_with_or_without_letters(text):
    """What is left over for the last slice of a task may be such a text alone."""
    (tail,) = next(truncation._tails()(iter([_batch([7], [text])]))).to_pylist()
    assert tail["chapter_id"] == 7 and (tail["lang"] is None) == (text != "x")


def test_counts_of_a_batch_left_in_the_language_of_the_source():
    left = list(alignment._tokenised(iter([_batch([1], ["Nobody came. All slept."], ["Nobody came. All slept."])])))
    assert left[0].num_rows == 1 and list(alignment._counted(iter(left), alignment._Model([]))) == []
    whole = list(alignment._tokenised(iter([_batch([2], ["Nobody came."], ["لم يأت أحد."])])))
    alone, both = (next(alignment._counted(iter(x), alignment._Model([]))).to_pylist() for x in (whole, left + whole))
    assert alone == both


def test_lexicon_of_very_many_sentences(spark, monkeypatch):
    many, w = 4 * 10**9, alignment.WORDS
    counts = spark.createDataFrame([(1, 2, many), (1, w, many), (w, 2, many), (w, w, 2 * many)], "s int, t int, n long")
    monkeypatch.setattr(alignment, "written", lambda df, name: counts)
    vs, vt = alignment.lexicon(spark.createDataFrame([], alignment.TOKENS), alignment._Model([]))
    assert np.allclose(vs[1] / np.linalg.norm(vs[1]), vt[2] / np.linalg.norm(vt[2]), atol=1e-6)


def test_p5_takes_cut_texts_by_thresholds_of_all(spark, tmp_path, monkeypatch):
    rows = [(i, 1, f"Ann carried the lamp to gate {'abcdefghij'[i % 10] * 3} of Orlen.", f"حملت آن المصباح إلى البوابة {'ابتثجحخدذر'[i % 10] * 3} في أورلن.") for i in range(10_000)]
    chapters(spark, rows).write.parquet(str(tmp_path / "chapter.parquet"))
    seen = []
    best = truncation.best_threshold
    monkeypatch.setattr(truncation, "best_threshold", lambda whole, inner: seen.append(whole.sum()) or best(whole, inner))
    QUERIES["p5_found"](spark, str(tmp_path))
    assert max(seen) == 10_000


def test_alignment(spark):
    rng = random.Random(9)
    nouns = {f"noun{chr(97 + i)}{chr(110 - i)}": f"اسم{chr(0x628 + i)}{chr(0x641 - i % 3)}" for i in range(12)}
    verbs = {f"verb{chr(97 + i)}x": f"فعل{chr(0x628 + i)}ص" for i in range(8)}
    rows, truth = [], set()
    for c in range(400):
        src, tgt = [], []
        for k in range(8):
            a, v, b, n = rng.choice(list(nouns)), rng.choice(list(verbs)), rng.choice(list(nouns)), rng.randrange(2, 400)
            s, t = f"the {a} {v} the {b} {n} times.", f"{verbs[v]} {nouns[a]} {n} مرة {nouns[b]}."
            if rng.random() < 0.1:
                src.append(s)  # left out
                continue
            truth.add((c, len(src), len(tgt)))
            src.append(s)
            tgt.append(t)
        rows.append((c, 1, "A site line\n\n" + " ".join(src), " ".join(tgt) or None))
    truth = {(c, i + 1, j) for c, i, j in truth}
    rows += [(9000, 1, None, "x."), (9001, 1, "x.", None), (9002, 1, "...", "x."), (0, 1, rows[0][2], rows[0][3])]
    got = {(r["chapter_id"], r["raw_no"], r["translated_no"]) for r in alignment.aligned(chapters(spark, rows)).collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95
    assert alignment.aligned(chapters(spark, [])).count() == 0


@pytest.mark.parametrize("documents", [1, 3])
def test_paths_are_best(documents):
    """The paths have the score that plain recursion finds, whether all cells may begin a bead or some, in one table or in blocks of rows."""
    rng = np.random.default_rng(1)
    n, m = np.array([7, 4, 1])[:documents], np.array([5, 2, 3])[:documents]
    size = {(1, 1): (7, 5), (2, 1): (6, 5), (1, 2): (7, 4)}
    gains = [rng.normal(size=(*size[b], documents)).astype(np.float32) for b in alignment.BEADS]
    cells = [np.argwhere(g > 0) for g in gains]
    i, j, d = (np.concatenate([c[:, k] for c in cells]) for k in range(3))
    bead = np.repeat(np.arange(3), [len(c) for c in cells])
    some = alignment._Some(d, i, j, bead, np.concatenate([g[g > 0] for g in gains]), 7, documents)
    ways = [alignment._paths(n, m, alignment._by_gains(gains)), alignment._paths(n, m, some)]
    if documents == 1:
        ways += [alignment._long_path(7, 5, lambda p, high: lambda i, *rest: alignment._by_gains([g[p:high] for g in gains])(i - p, *rest), cells) for cells in (1, 12, 1000)]

    def best(d, i, j):
        if i == 0 or j == 0:
            return 0.0
        ends = [best(d, i - a, j - b) + g[i - a, j - b, d] for (a, b), g in zip(alignment.BEADS, gains) if i >= a and j >= b]
        return max(best(d, i - 1, j), best(d, i, j - 1), *ends)

    for rows in ways:
        for x in range(documents):
            assert abs(sum(gains[b][i, j, dd] for dd, i, j, b in rows if dd == x) - best(x, n[x], m[x])) < 1e-4


def test_length_model():
    """Ratio and variance of each pair of languages come from the lengths themselves."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rows = []
    for pair, ratio in ((0, 0.8), (9, 2.5)):
        for _ in range(300):
            x = rng.integers(20, 120, 12)
            y = np.maximum(ratio * x + rng.normal(size=12) * np.sqrt(3.0 * x), 1)
            rows.append((pair, x.astype(np.uint32).tobytes(), y.round().astype(np.uint32).tobytes()))
    rows.append((0, b"", np.uint32(7).tobytes()))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["pair", "x", "y"])
    got = {p: alignment._estimated(*v) for p, *v in zip(*(c.to_pylist() for c in next(alignment._length_sums(iter([batch]))).columns))}
    assert abs(got[0][0] - 0.8) < 0.03 and abs(got[9][0] - 2.5) < 0.05 and all(2.5 < v < 3.6 for _, v in got.values())


def test_length_model_comes_from_all_documents(spark):
    """Most documents leave a sentence out; the few with as many sentences on both sides, whose sentences don't belong together, don't decide."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(320):
        x = rng.integers(20, 120, 12)
        y = rng.integers(20, 120, 12) if i < 20 else np.delete(np.maximum(2 * x + rng.normal(size=12) * np.sqrt(3.0 * x), 1), rng.integers(12))
        rows.append((0, bytearray(x.astype(np.uint32).tobytes()), bytearray(y.round().astype(np.uint32).tobytes())))
    model = alignment.length_model(spark.createDataFrame(rows, "pair int, src_chars binary, tgt_chars binary"))
    ratio, variance = model.of[0]
    assert abs(ratio - 2) < 0.05 and 2 < variance < 4.5


def test_counts_in_parts_add_up(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) + ".", " ".join(rng.choice("abcdefgh") * 2 for _ in range(30)) + ".") for i in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*texts[i : i + 10])], names=["i", "a", "b"]) for i in range(0, 400, 10)]
    tokens = list(alignment._tokenised(iter(batches)))

    def sums(most):
        monkeypatch.setattr(alignment, "MOST_CODES", most)
        out, n = {}, 0
        for b in alignment._counted(iter(tokens), alignment._Model([])):
            n += 1
            for x in b.to_pylist():
                out[x["s"], x["t"]] = out.get((x["s"], x["t"]), 0) + x["n"]
        return out, n

    whole, one = sums(10**9)
    parts, many = sums(5)
    assert one == 1 < many and whole == parts


def _two_sides(n, kept):
    """Vectors and lengths of n sentences, and of the translations of those kept, with some noise."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(n, alignment.DIMENSIONS)).astype(np.float32)
    b = a[kept] + 0.5 * rng.normal(size=(len(kept), alignment.DIMENSIONS)).astype(np.float32)
    x = rng.integers(30, 90, n).astype(np.float32)
    return a, b, x, (0.8 * x[kept]).astype(np.float32)


def _side(chars):
    return alignment._Side([np.arange(len(chars), dtype=np.uint16).tobytes()], [np.ones(len(chars), np.uint32).tobytes()], [chars.astype(np.uint32).tobytes()])


@pytest.mark.parametrize("kept", [list(range(8)), list(range(7)), list(range(95, 103)), list(range(50)), list(range(0, 103, 9)), list(range(20)) + list(range(80, 103))])
@pytest.mark.parametrize("n", [103, 400])
def test_alignment_of_a_part(n, kept):
    a, b, x, y = _two_sides(n, kept)
    got = alignment._pairs(_side(x), _side(y), a, b, np.zeros(1, int), alignment._Model([]))
    assert {(int(i), int(j)) for _, i, j in got} == {(i, j) for j, i in enumerate(kept)}


def test_long_documents_like_short_ones():
    """Blocks of rows give the pairs that one table gives: omissions, a merge, a split, an exchange of two passages."""
    kept = [i for i in range(120) if i % 11]
    kept[10:20], kept[80:85] = kept[80:85] + kept[15:20], kept[10:15]
    a, b, x, y = _two_sides(120, kept)
    b[40] += b[41]
    y[40] += y[41]
    b, y = np.delete(b, 41, axis=0), np.delete(y, 41)
    whole = {tuple(map(int, r)) for r in alignment._pairs(_side(x), _side(y), a, b, np.zeros(1, int), alignment._Model([]))}
    for cells in (1, 500, 3000, 10**6):
        assert {tuple(map(int, r)) for r in alignment._long_pairs(a, b, x, y, np.float32([alignment.RATIO]), np.float32([alignment.VARIANCE]), cells)} == whole


# ---- p6 -------------------------------------------------------------------------------------------------------------


def test_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(f"{encoding.FOLDER}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    texts = [None, "", " ", "  \n\n x", "Hello world's 123abc", "<|endoftext|>", "مرحبا بالعالم", "他说。走了", "🙂🙂 a​b", "a" * 300, "é́ ﬁ \xa0x", "\t\r\n", "it's they'LL", "same same same", "ab" * 2000]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, piece string, at int")
    got = {r["doc_id"]: r["ids"] for r in encoding.encoded(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == reference.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert all(r["same"] for r in encoding.round_trip(df).collect())
    assert encoding.encoded(df.limit(0)).count() == 0


def test_encoding_of_null_and_repeated_ids(spark):
    texts = ["zqxvbk jjwqz", "qqzzxxv", "zqxvbk 🙂é́"]
    schema = "doc_id long, text string"
    alone = {t: encoding.encoded(spark.createDataFrame([(1, t)], schema)).first()["ids"] for t in texts}
    df = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (7, texts[1]), (7, texts[2]), (7, texts[2])], schema)
    got = sorted((r["doc_id"] or 0, r["ids"]) for r in encoding.encoded(df).collect())
    assert got == sorted([(0, alone[texts[0]]), (0, alone[texts[1]]), (7, alone[texts[1]]), (7, alone[texts[2]]), (7, alone[texts[2]])])
    assert [r["same"] for r in encoding.round_trip(df).collect()] == [True] * 5


# ---- p7 -------------------------------------------------------------------------------------------------------------


def test_prefix_sums(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randrange(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g string, v long")
    got = {r["i"]: r["p"] for r in mixing.prefix(df, ["g"], F.floor(F.col("i") / 37), ["i"], "v", "p").collect()}
    sums = {"a": 0, "b": 0}
    for i, g, v in rows:
        assert got[i] == sums[g]
        sums[g] += v


def test_mix(spark):
    words = "the river rose and the old man slept near it for a long time ".split()
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(20, 120))), "big" if i % 3 else "small") for i in range(600)]
    docs += [(9001, None, "big"), (9002, "", "small"), (9003, "x", None)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "big", 1.0, 1), ("m", "small", 3.0, 2), ("m", "none", 1.0, 5), ("m", "bad", None, 1), ("n", "big", 2.0, 0)], "mix_name string, source string, target_share double, max_repeats int")
    plan = spark.createDataFrame([("m", 0.6), ("n", 1.0)], "mix_name string, total_factor double")
    mix, _ = mixing.mixed(documents, targets, plan)
    rows = mix.collect()
    assert {r["mix_name"] for r in rows} == {"m"} and len({r["doc_id"] for r in rows}) == len(rows)
    total = mixing.sizes(documents).groupBy().sum("n_tokens").first()[0]
    got = {s: sum(r["n_tokens"] * r["repeats"] for r in rows if r["source"] == s) for s in ("big", "small")}
    assert abs(got["big"] / (0.6 * total * 0.2) - 1) < 0.02
    small = sum(r["n_tokens"] for r in mixing.sizes(documents).where("source = 'small'").collect())
    assert abs(got["small"] / min(0.6 * total * 0.6, 2 * small) - 1) < 0.02
    assert max(r["repeats"] for r in rows if r["source"] == "small") <= 2 and max(r["repeats"] for r in rows if r["source"] == "big") == 1
    assert mixing.mixed(documents.limit(0), targets, plan)[0].count() == 0


def test_shares_of_the_tables(spark, data):
    """Every source of every mix has the tokens that its weight and its cap allow, to less than a document; the same each time."""
    from pathlib import Path

    from bookflow.session import table

    folder = str(Path(data).parent / "sf0.01")
    tables = [table(spark, folder, t) for t in ("documents", "mix_target", "mix_plan")]
    rows = mixing.report(*tables).collect()
    longest = {r["source"]: r["most"] for r in mixing.sizes(tables[0]).groupBy("source").agg({"n_tokens": "max"}).toDF("source", "most").collect()}
    assert len(rows) == 35
    for r in rows:
        wanted = min(r["wanted_tokens"], r["available_tokens"] * r["max_repeats"])
        assert wanted - longest.get(r["source"], 0) <= r["mixed_tokens"] <= wanted + 1 and r["most_repeats"] <= r["max_repeats"], r
    again = {(r["mix_name"], r["source"]): r["mixed_tokens"] for r in mixing.report(*tables).collect()}
    assert again == {(r["mix_name"], r["source"]): r["mixed_tokens"] for r in rows}


def test_slots_follow_the_weights(spark):
    """Draws add up to the slots of the mix and differ from the expectation by a few standard deviations at most; the map from turns to blocks is one to one."""
    from pyspark.sql import functions as F

    demand = spark.createDataFrame([("m", s, g) for s, g in (("a", 6e6), ("b", 3e6), ("c", 1e6))], "mix_name string, source string, granted double")
    got = {r["source"]: r["slots"] for r in mixing.slots(demand).collect()}
    n = sum(got.values())
    assert n == -(-10**7 // mixing.BLOCK)
    assert all(abs(got[s] - p * n) < 5 * (n * p * (1 - p)) ** 0.5 for s, p in (("a", 0.6), ("b", 0.3), ("c", 0.1))) and len(set(got.values())) == 3
    for blocks in (1, 2, 97, 1000):
        df = spark.range(blocks).withColumn("blocks", F.lit(blocks).cast("long")).withColumn("shift", F.lit(blocks // 3).cast("long"))
        mapped = df.select("id", mixing._block_of(F.col("id"), F.col("blocks"), F.col("shift")).alias("b"), "blocks", "shift")
        back = mapped.select("id", "b", F.pmod(F.col("b") * mixing._prime(F.col("blocks")) + F.col("shift"), F.col("blocks")).alias("t")).collect()
        assert sorted(r["b"] for r in back) == list(range(blocks)) and all(r["t"] == r["id"] for r in back)


# ---- p8 -------------------------------------------------------------------------------------------------------------


def test_quality(spark, data):
    from bookflow.session import table

    base = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    extra = [
        (100_001, None), (100_002, ""), (100_003, " \n"), (100_004, "\n".join(f"- {x}" for x in ["Latest", "Home", "Tags", "Help", "Next"] * 5)), (100_005, "\n".join(f"{i},{i * 7},{i * 13}" for i in range(30))),
        (100_006, "%$#@ &*() {}[] " * 30), (100_007, "word " * 200), (100_008, "The road to Orlen stayed closed for 5 nights. Nobody in Tavrin believed Selka, and the guards said nothing."),
    ]
    df = spark.createDataFrame(base + extra, "doc_id long, text string")
    got = {r["doc_id"]: r["kind"] for r in quality.classified(df).collect()}
    assert len(got) == len(base) + len(extra)
    assert [got[i] for i in range(100_001, 100_004)] == [None] * 3
    assert all(got[i] in ("list", "table", "junk") for i in range(100_004, 100_008)) and got[100_008] == "prose"
    assert quality.classified(df.limit(0)).count() == 0


def test_quality_of_lists_of_names(spark, data):
    """Names stand in sentences too: lists of them, in several forms and scripts, are still found, and short prose with many names is not."""
    from pathlib import Path

    from bookflow.session import table

    rng = random.Random(9)
    names = {
        "en": ["Rudvik", "Selka", "Tolmek", "Han Seolu", "Pao Ren", "Mirelle", "Korvan", "the iron lamp", "Tavrin", "Orlen", "the old map"],
        "ar": ["رودفيك", "سيلكا", "تولميك", "هان سيولو", "باو رن", "ميريل", "كورفان", "المصباح الحديدي", "تافرين", "أورلن"],
        "zh": ["塞尔卡", "托尔梅克", "韩雪露", "鲍仁", "米蕾尔", "科尔万", "铁灯", "塔夫林", "奥伦"],
    }
    forms = [lambda x: "\n".join(f"* {n}" for n in x), lambda x: "\n".join(x), lambda x: " | ".join(x), lambda x: ", ".join(x), lambda x: "\n".join(f"{i}. {n} ({x[0]})" for i, n in enumerate(x, 1))]
    lists = [form([rng.choice(n) for _ in range(rng.randrange(9, 30))]) for n in names.values() for form in forms for _ in range(4)]
    prose = ["Rudvik and Selka waited 9 days in Tavrin. Korvan carried the iron lamp to Orlen.", "باع كورفان المصباح الحديدي مقابل 21 قطعة نقدية. حمل رودفيك المصباح الحديدي إلى تافرين.", "塞尔卡终于突破到第98阶。韩雪露带着铁灯去了塔恩。", "Korvan trug die alte Karte nach Tavrin. Niemand in Orlen glaubte Selka."] * 5
    folder = str(Path(data).parent / "sf0.01")
    base = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    df = spark.createDataFrame(base + [(10**6 + i, t) for i, t in enumerate(lists + prose)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["kind"] for r in quality.classified(df).where(f"doc_id >= {10**6}").collect()}
    found = sum(got[10**6 + i] != "prose" for i in range(len(lists)))
    assert found >= 0.9 * len(lists)
    assert sum(got[10**6 + len(lists) + i] == "prose" for i in range(len(prose))) >= 0.9 * len(prose)
