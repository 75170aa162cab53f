"""Trusted labels of residue: what a line of a page must look like to be a template, filler, an error or a scripts notice.

A slot or a piece of template code counts wherever it stands; the other kinds count only where they make up a whole line,
since stories also speak of such things. There are three rules for lines, none of which knows the wording of a page:

* technical words (TECHNICAL) make up most of a line, some of them words that stories hardly use;
* filler: the customary Latin, or words that writers type to fill a field;
* forms that machines write (LINES): status lines, exceptions, markup, identifiers, and a few set phrases of promise.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache, lru_cache

from bookflow.llm.kernel import UNSEEN

#: A cheap test first: without one of these there is no slot.
SLOT_HINTS = ("{", "%", "@@", "__", "[", "<", "&&", "undefined", "UNDEFINED", "Undefined")
_WORD = r"[A-Za-z][A-Za-z0-9]*(?:[._-][A-Za-z0-9]+)*"
SLOT = re.compile(
    "|".join(
        (
            r"\{\{[^{}\n]{0,120}\}\}",
            r"[$#]\{[^{}\n]{1,120}\}",
            r"\{%[^\n]{0,200}?%\}",
            r"<[%?]=?[^\n]{0,200}?[%?]>",
            rf"\{{(?:{_WORD}|\d{{1,2}})\}}",
            rf"%{_WORD}%",
            r"(?<![\w%])%[sd](?!\w)",
            rf"@@\s?{_WORD}\s?@@",
            rf"(?<![\w])__{_WORD}__(?!\w)",
            rf"\[\[\s?{_WORD}\s?\]\]",
            rf"&&{_WORD};",
            r"\[(?i:insert|your|enter|add|put)\s[^\[\]\n]{1,60}\]",
            r"\b(?i:undefined: undefined)\b",
            r"\[(?i:object object)\]",
        )
    )
)

#: Words of the customary Latin filler (fixed values).
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis"
    " nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat"
    " nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum tellus felis porta mauris"
    " massa urna arcu nunc orci leo sem vitae risus ante eget vel at ac pellentesque vestibulum curabitur donec integer".split()
)
#: Words of it of which a line must have one: the longer ones, which hardly any other line has.
MARKED = frozenset(w for w in LATIN if len(w) >= 5)
#: Words that writers type to fill a field (fixed values).
FILLERS = frozenset("asdf asdfgh qwerty qwertz foo bar baz xxx xxxx blah bla test tests testing tbd todo fixme tba placeholder placeholders dummy sample filler paste text here please ignore body paragraph content goes your chapter story".split())
#: At least one of these must be there for a line of FILLERS to count.
STRONG = frozenset("asdf asdfgh qwerty qwertz foo xxx xxxx blah test testing tbd todo fixme tba placeholder placeholders dummy sample filler paste goes".split())

#: Words of servers, browsers, scripts and unfinished pages, as they are said in English and Arabic; the second list has those that stories use as well.
TECHNICAL_ONLY = frozenset(
    "error exception traceback stack uncaught fatal undefined null nan unhandled syntax keyerror typeerror valueerror nameerror runtimeerror ioerror syntaxerror referenceerror attributeerror indexerror runtimeexception"
    " server servers gateway proxy upstream nginx apache cloudflare database connection network timeout timed dns ssl http https html url cgi php"
    " request requests requested website webpage reader reload refresh retry contact administrator"
    " deleted unavailable available temporarily maintenance offline overloaded failed failure"
    " denied forbidden blocked unauthorized permission login session expired token captcha verify verification checking ray id"
    " browser javascript js script scripts cookies cookie enable enabled disable disabled switched blocker adblock extension noscript viewer internal service"
    " coming placeholder draft dummy sample filler lorem ipsum tbd todo description paste added release filled"
    " خطأ الخطأ خادم الخادم الخدمة متاحة متاح الصفحة المطلوبة موجودة الطلب طلبك حظر رمز المتصفح متصفحك تفعيل جافاسكربت السكربتات يرجى ثانية ثوان دقيقة تحميل التحقق نتحقق تسجيل الدخول انتهت الجلسة المعرف داخلي مؤقتا مؤقتًا مؤقت تجريبي محتوى وهمية سيضاف لعرض يدعم"
    " تم بسبب كثرة المحاولات لملء المساحة فقط يوضع يصل المحتوى يكتب".split()
)
TECHNICAL_TOO = frozenset(
    "warning back return try again home front here on down missing found moved gone busy wait please too many slow seconds minute minutes content chapter text ready written title body code event reference bad load loading turn sent"
    " soon page pages refused trace editor errors support address link removed exist exists file security shield limit rate response resource site sites updated insert access oops broke broken wrong line call recent need needs must allowed run requires required"
    " غير هنا الآن الفصل انتظر حاول فقرة عنوان وصف نص لاحقا لاحقًا قريبا قريبًا عذرا عذرًا".split()
)
#: Words that hold sentences together; they count for nothing.
HOLDING = frozenset(
    "the a an of to in is are was be has have had not no your you our we this that it its and or for with by at from as one does do did will cannot can so if then once until been more my me all but only after before into which could"
    " في من على إلى لا هذا إن أن هو هي بعد حتى كان قد".split()
)

#: (a literal of the lower-cased line, a pattern that the whole cleaned line must match from its start)
LINES: tuple[tuple[str, str], ...] = (
    # status lines
    *((w, rf"(?:error )?(?:[45]\d\d )?{w}\b[.! ]*(?:\(?\d*\)?)?$") for w in ("not found", "page not found", "bad gateway", "forbidden", "access denied", "internal server error", "service unavailable", "too many requests", "gateway timeout")),
    *((str(n), rf"(?:error )?{n}$") for n in (400, 401, 403, 404, 410, 429, 500, 502, 503, 504)),
    ("undefined", r"undefined$"),
    ("null", r"null$"),
    ("nan", r"nan$"),
    # exceptions
    ("fatal error", r"(?:php )?fatal error:"),
    ("traceback (most recent", r"traceback \(most recent call last\)"),
    ("file \"", r"file \"[^\"]+\", line \d+"),
    ("error: ", r"(?:\w+\.)*\w*(?:error|exception): \S"),
    ("exception", r"(?:\w+\.)+\w*exception\b"),
    # markup and data
    ("<html", r"<html\b.*</"),
    ("<title>", r"<(?:html|head|title|!doctype)\b"),
    ("<noscript>", r"<noscript>"),
    ("\"error\":", r"\{\s*\"error\"\s*:"),
    # identifiers that stand alone
    *((f"{w} ", rf"{w} #?[0-9a-z-]*\d[0-9a-z-]*$") for w in ("reference", "event", "edge node", "ray", "المعرف:")),
    # set phrases
    ("oops", r"oops! (?:something|an error)\b"),
    ("session has expired", r"your session has expired\b"),
    ("database is ", r"(?:the )?database is (?:away|down|not available)\b"),
    ("text here", r"(?:your |the )?(?:chapter |story )?text here\b"),
    ("goes here", r"(?:your |the )?[\w ]{0,30}goes here\b"),
    ("coming soon", r"(?:chapter |content |text )?coming soon\b[.!… ]*$"),
    ("is on its way", r"(?:chapter|part|episode|page) \S+ is on its way\b"),
    ("content will be", r"(?:the )?(?:content|chapter|text) will be (?:added|updated|available)\b"),
)

_INVISIBLE = re.compile(f"[{UNSEEN}]")
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[^\W\d_]+")


def cleaned(line: str) -> str:
    """A line without what sites vary: invisible characters, runs of white space, ornaments at its ends, case."""
    return _SPACE.sub(" ", _INVISIBLE.sub("", line)).strip(" ~*>!.•·-–—|").lower()


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for i, (literal, _) in enumerate(LINES):
        by.setdefault(literal, []).append(i)
    for literal, rules in by.items():
        a.add_word(literal, tuple(rules))
    a.make_automaton()
    return a


@cache
def patterns() -> tuple[re.Pattern, ...]:
    return tuple(re.compile(p) for _, p in LINES)


def visible(text: str) -> str:
    """A text without the characters that nobody sees."""
    return text if text.isascii() else _INVISIBLE.sub("", text)


def has_slot(text: str, hints: Iterable[str] = SLOT_HINTS) -> bool:
    """Whether a text has a slot; ``hints``: those of SLOT_HINTS that it may hold."""
    for h in hints:
        if h in text:
            return bool(SLOT.search(text))
    return False


#: How a line came by its label: a wording (others may be near it), or its vocabulary or a slot (no wording to be near to).
WORDING, VOCABULARY = 1, 2


_WORDS = re.compile(r"[\w\u064b-\u0652]+")
#: A line of more words is no notice; one with a single strong word has no more than the second number. Nor is one of more blanks.
MOST_WORDS, MOST_WITH_ONE, MOST_BLANKS = 30, 12, 60


def is_technical(words, technical, only, holding):
    """The rule of technical words, from counts (numbers or arrays of them): of words that are no numbers and longer than a character, of technical ones, of different ones that stories hardly use, and of those that hold sentences together."""
    rest = words - holding
    some = (only >= 2) & (5 * technical >= 3 * rest)
    most = (only >= 1) & (4 * technical >= 3 * rest) & (rest >= 2) & (words <= MOST_WITH_ONE)
    return (words <= MOST_WORDS) & (some | most)


def technical(words: list[str]) -> bool:
    words = [w for w in words if len(w) > 1 and (w.isalpha() or not any(map(str.isdigit, w)))]
    count = lambda s: sum(w in s for w in words)
    return bool(is_technical(len(words), count(TECHNICAL_ONLY) + count(TECHNICAL_TOO), len(TECHNICAL_ONLY.intersection(words)), count(HOLDING)))


def is_residue(line: str) -> int:
    """Whether one line, as a whole, is trusted residue, and how: 0, WORDING or VOCABULARY."""
    if has_slot(line):
        return VOCABULARY
    line = cleaned(line)
    if not line:
        return 0
    compiled = patterns()
    if any(compiled[i].match(line) for _, rules in automaton().iter(line) for i in rules):
        return WORDING
    if line.count(" ") <= MOST_BLANKS and technical(_WORDS.findall(line)):
        return WORDING
    words = _TOKEN.findall(line)
    if len(words) >= 4 and any(w in MARKED for w in words) and sum(w in LATIN for w in words) >= 0.6 * len(words):
        return VOCABULARY
    if words and all(w in FILLERS for w in words) and any(w in STRONG for w in words) and (len(words) > 1 or words[0] in STRONG):
        return VOCABULARY
    return 0


#: The verdicts on the last lines of no more characters are kept, since pages repeat their notices.
KEPT = 300
_is_residue = lru_cache(4096)(is_residue)


#: A word of each literal of LINES: of those whose patterns hold for short lines only (WORDS_OF_SHORT words at most), and of the others. Words that only
#: end in "error" or "exception" are sought as parts.
SHORT = frozenset("found gateway forbidden denied server unavailable requests timeout undefined null nan reference event node ray المعرف coming".split())
ANY = frozenset("fatal traceback file html title noscript error oops text goes way content expired database".split())
WORDS_OF_SHORT = 12
PARTS = ("error: ", "exception")


def residue_lines(text: str, may: Iterable[int] | None = None, slot: bool | None = None) -> list[tuple[int, int]]:
    """(number, kind) of a text's lines that ``is_residue``.

    ``may``: lines that are to be tried, besides those with a slot or one of PARTS; all, if it is None. ``slot``: whether
    the text has a slot, if that is known."""
    low = text.lower()
    parts = any(p in low for p in PARTS)
    slot = has_slot(text) if slot is None else slot
    if may is not None and not may and not slot and not parts:
        return []
    lines = text.split("\n")
    tried = set(range(len(lines)) if may is None else may)
    if slot:
        tried |= {j for j, line in enumerate(lines) if has_slot(line)}
    if parts:
        tried |= {j for j, line in enumerate(lines) if any(p.strip() in line.lower() for p in PARTS)}
    return [(j, kind) for j in sorted(tried) if (kind := (_is_residue(lines[j]) if len(lines[j]) <= KEPT else is_residue(lines[j])))]
