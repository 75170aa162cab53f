"""String functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it; the class reads the same in Java's and RE2's syntax.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def py_strip(x: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(x, rf"^{WS}+|{WS}+$", "")


def not_blank(x: Column) -> Column:
    """Whether there is more than white space; false for null."""
    return F.coalesce(x.rlike("[^" + WS[1:]), F.lit(False))  # stops at the first such character


def without_prefix(x: Column, prefix: str) -> Column:
    """Without a leading word, whatever its case; stripped."""
    return F.when(F.startswith(F.lower(x), F.lit(prefix.lower())), py_strip(F.substring(x, len(prefix) + 1, 1 << 30))).otherwise(x)


def clean_title(x: Column) -> Column:
    """Without digits before the word Chapter and without an age at the end ("3 days ago")."""
    x = F.regexp_replace(x, r"(?i)^[0-9]+[ \t]*(chapter)", "$1")
    return py_strip(F.regexp_replace(x, r"(?i)[ \t]*[0-9]+[ \t]+(second|minute|hour|day|week|month|year)s?[ \t]+ago[ \t]*$", ""))


def first_of(*choices: Column) -> Column:
    """The first choice that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def best_title(candidates: Column, number: Column, place: Column) -> Column:
    """The best of an array of titles for one chapter.

    White space is normalised; "#" and bare numbers don't count; a leading "#" and a leading number with a blank are taken
    off. The longest title that says more about a chapter than its number wins, else the longest of the others, the first
    on ties; without any it is named by its number, or by its place in the list."""
    plain = F.transform(candidates, lambda t: py_strip(F.regexp_replace(F.coalesce(t, F.lit("")), WS + "+", " ")))
    kept = F.filter(plain, lambda t: (t != "") & ~t.rlike(r"^#?[ ]*[0-9]*$"))
    bare = F.filter(F.transform(kept, lambda t: py_strip(F.regexp_replace(F.regexp_replace(t, r"^#[ ]*", ""), r"^[0-9]+[ ]+", ""))), lambda t: t != "")
    telling = F.filter(bare, lambda t: t.rlike("(?i)chapter") & ~t.rlike(r"(?i)^chapter[ ]*[0-9]+$"))
    others = F.filter(bare, lambda t: ~t.rlike("(?i)chapter") | t.rlike(r"(?i)^chapter[ ]*[0-9]+$"))
    longest = lambda a: F.aggregate(a, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))
    return first_of(longest(telling), longest(others), F.concat(F.lit("Chapter "), F.coalesce(number, place).cast("string")))


def titled(node: Column, attribute: Column, raw: Column, place: Column) -> Column:
    """A link's title: its title node's text, else its title attribute, else its own text cleaned, else its place in the list."""
    return first_of(py_strip(node), py_strip(attribute), clean_title(raw), F.concat(F.lit("Chapter "), place.cast("string")))


def first_long(paragraphs: Column, least: int = 60) -> Column:
    """The first of an array of texts that is longer than so many characters, null without one."""
    return F.try_element_at(F.filter(paragraphs, lambda p: F.length(py_strip(p)) > least), F.lit(1))


def distinct_badges(x: Column) -> Column:
    """Names of a list in the order in which they are first seen; stripped, without empty ones."""
    return F.array_distinct(F.filter(F.transform(x, py_strip), lambda b: b != ""))


def arabic_author(description: Column) -> Column:
    """The author that an Arabic description names between its two customary words; null without one. Every letter may stand in a name."""
    return F.nullif(py_strip(F.regexp_extract(description, rf"المؤلف{WS}+(.+?){WS}+على", 1)), F.lit(""))


def failure_line(provider: Column, reason: Column, suggestion: Column) -> Column:
    """A failed call in words: who failed and why, and what to try, if anything."""
    said = F.concat(F.lit("["), provider, F.lit("] "), F.coalesce(reason, F.lit("unknown error")))
    return F.when(F.coalesce(suggestion, F.lit("")) != "", F.concat(said, F.lit(" Suggestion: "), suggestion)).otherwise(said)


#: What stands in a settings file where a key has yet to be written (fixed values).
PLACEHOLDERS = "^(your_[a-z]+_api_key_here|<YOUR_API_KEY>)$"


def key_usable(key: Column) -> Column:
    """Whether a provider's key is there and no placeholder."""
    plain = py_strip(F.coalesce(key, F.lit("")))
    return (plain != "") & ~plain.rlike(PLACEHOLDERS)


def key_short(key: Column, least: int = 20) -> Column:
    """Whether a key is so short that it is likely wrong."""
    return F.length(py_strip(F.coalesce(key, F.lit("")))) < least


def models_with_default(listed: Column, default: Column) -> Column:
    """A list of models with the default put first if it is missing."""
    models = split_list(listed)
    return F.when((F.coalesce(default, F.lit("")) != "") & ~F.array_contains(models, default), F.array_prepend(models, default)).otherwise(models)


def default_after(models: Column, default: Column) -> Column:
    """The default after models were taken away or renamed: itself if it is left, else the first, else an empty name."""
    return F.when(F.array_contains(models, default), default).otherwise(F.coalesce(F.try_element_at(models, F.lit(1)), F.lit("")))


def paragraphs(x: Column, delimiter: str = "\n\n") -> Column:
    """Paragraphs as markup: split, stripped, empty ones dropped, inner line feeds as blanks."""
    parts = F.filter(F.transform(F.split(F.replace(x, F.lit("\r\n"), F.lit("\n")), delimiter), py_strip), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit(" ")), F.lit("</p>"))), "\n")


def escaped(x: Column) -> Column:
    """With the characters that markup reserves replaced."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def safe_title(title: Column, novel_id: Column) -> Column:
    """A file name: letters, numbers, blanks, underscores and hyphens; a name by id if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", ""), r" +$", "")
    return F.when(F.coalesce(kept, F.lit("")) != "", kept).otherwise(F.concat(F.lit("novel_"), novel_id.cast("string")))


def chapter_file(idx: Column) -> Column:
    return F.format_string("text/chapter_%04d.xhtml", idx)


def masked(x: Column) -> Column:
    """A secret with only its first four and last two characters shown, or nothing of a short one."""
    n = F.length(x)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(x, F.lit(4)), F.repeat(F.lit("•"), n - 6), F.right(x, F.lit(2))))


def variable_name(provider: Column, kind: str) -> Column:
    """The name of a provider's setting, as in ACME_API_KEY."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.upper(py_strip(provider)), r"[^A-Z0-9]+", "_"), r"^_+|_+$", ""), F.lit("_" + kind))


def site_key(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"[^a-z0-9]+", "_")


def split_list(x: Column, separator: str = ",") -> Column:
    """Parts of a list, stripped, without empty ones; their order is their priority."""
    return F.filter(F.transform(F.split(x, separator), py_strip), lambda p: p != "")


def percent(done: Column, total: Column) -> Column:
    """Whole percents, cut off as floating-point division leaves them; 0 without a total."""
    return F.when(total > 0, F.floor(done.cast("double") / total.cast("double") * 100).cast("int")).otherwise(F.lit(0))
