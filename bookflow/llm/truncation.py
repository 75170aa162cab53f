"""Texts cut off before their end.

Method: a backward character n-gram model. For every position of every sentence of the column, the last n characters
(never beyond the sentence's start) either end the sentence or go on; the counts of both give, by backing off from long
contexts to short ones, the log-odds that a sentence may end behind a given context. A text whose end carries no end mark
is cut if the log-odds of its final context lie below the threshold of its language and column.

Thresholds come from the column itself (``thresholds``): of all texts that a mark ends, the log-odds of the end without its mark
are set against those of a place some characters before it, each without what the text itself adds to the counts; the
threshold of a language is where both kinds of error are fewest. Languages with few such texts take the threshold of all.

Only counts of the contexts at the ends of texts and at those places are needed. Their hashes go into a bitmap that is sent
to all tasks; each task counts what passes the bitmap and sends sums; the exact hashes are compared in the last join.

What stands behind the end is looked through: blanks, dividers, a sign-off line (a short line that ends many texts and is
never continued), ellipses, broken characters and pieces of markup.

Cases: null and blank texts are no cases; a text whose last sentence has its end mark is whole; repeated rows of an id
count once; texts of any length count in full; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.llm import kernel as K
from bookflow.session import written

#: Lengths of the contexts, in characters.
LEVELS = (3, 6, 10, 16, 24, 36)
#: Weight of the shorter context when a longer one is seen seldom, and the odds before anything is seen.
BACKOFF, PRIOR = 2.0, 0.02
#: A language has a threshold of its own with so many texts that a mark ends; without any text the threshold is DEFAULT.
LEAST_TEXTS, DEFAULT = 40, -2.0
#: Log-odds are counted in bins of a tenth between these; thresholds whose errors differ by no more than FLAT are equally good.
#: Of these the one UPPER of the way up is taken: whole ends lie close together, other places far apart, so the lower end says little.
LOWEST, HIGHEST, FLAT, UPPER = -6.0, 2.0, 0.005, 0.75
#: The place before the end that is set against it lies so many characters back at most.
BACK = 60
#: Bits of the bitmap for each context, and their least and greatest number (2 and 16 MB): a power of two. It changes what is counted in vain, no result.
BITS, LEAST_BITS, MOST_BITS = 8, 1 << 24, 1 << 27
#: A line is a sign-off if it ends so many texts and so large a share of them.
SIGNOFF_LEAST, SIGNOFF_SHARE = 3, 0.0005
#: Marks and closing quotes at the end of a text are looked for in so many characters.
TAIL = 200

_MARKS, _QUOTES, _BROKEN = "!?؟！？。", "\"”“»'’)]", "�"
_BEHIND = re.compile(r"(?:\s|[.…]|�|</?[A-Za-z]*|&#?[A-Za-z0-9]{0,8}|[\"”“»'’)\]])+$")
_HAS_WORD = re.compile(r"[^\W_]")


def _stripped(text: str) -> str:
    """Without blanks and lines of ornaments at the end."""
    text = text.rstrip()
    while True:
        head, _, last = text.rpartition("\n")
        if not head or _HAS_WORD.search(last) or any(c in last for c in "�.…"):
            return text
        text = head.rstrip()


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences as streams of symbols, each begun by 1: (symbols, start of each, text of each, whether it is its text's last)."""
    cp, starts = K.codepoints(texts)
    k, t = np.minimum(cp, K.TOP), K.classes()
    flags = t["flags"].take(k)
    s, e = K.sentences(cp, flags)
    if not len(s):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint32), z, z, np.zeros(0, bool)
    at = np.flatnonzero(flags & (K.LETTER | K.DIGIT))
    first, last = at[np.searchsorted(at, s)], at[np.searchsorted(at, e) - 1] + 1
    sym = t["symbol"].take(k)
    # from each sentence's first letter or digit to its last one, without marks and without the second and later of equal digits or blanks
    edge = np.zeros(len(cp) + 1, np.int8)
    edge[first] = 1
    edge[last] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    keep &= (flags & K.MARK) == 0
    again = np.flatnonzero(sym[1:] == sym[:-1]) + 1
    again = again[(sym[again] == 48) | (sym[again] == 32)]
    begins = keep[first]
    keep[again] = False
    keep[first] = begins
    at = np.flatnonzero(keep)
    left = np.searchsorted(at, last) - np.searchsorted(at, first)
    out = np.ones(len(at) + len(left), np.uint32)
    start = np.concatenate(([0], np.cumsum(left + 1)[:-1]))
    place = np.ones(len(out), bool)
    place[start] = False
    out[place] = sym.take(at)
    text = np.searchsorted(starts, s, side="right") - 1
    return out, start, text, np.concatenate((text[1:] != text[:-1], [True]))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FIRST = np.uint64(0xD6E8FEB86659FD93)


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(np.uint64(1), np.full((1 << bits) - 1, base, np.uint64)))


class _Contexts:
    """Hashes of the contexts that end at given positions, level by level, from prefix sums of a polynomial."""

    def __init__(self, sym: np.ndarray, start: np.ndarray):
        n = len(sym)
        bits = max(n.bit_length(), 12)
        self.inverse = _powers(_INVERSE, bits)
        self.plus = sym.astype(np.uint64)
        self.plus += np.uint64(1)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.plus * _powers(_BASE, bits)[:n], out=self.sums[1:])
        self.start, self.own = start, np.repeat(start, np.diff(np.append(start, n)))

    def at(self, ends: np.ndarray, level: int) -> np.ndarray:
        """The hash of the last LEVELS[level] symbols up to each end, never beyond the sentence's start; its lowest bit is 0."""
        a = ends + (1 - LEVELS[level])
        np.maximum(a, self.own.take(ends), out=a)
        with np.errstate(over="ignore"):
            h = self.sums[1:].take(ends)
            h -= self.sums.take(a)
            h *= self.inverse.take(a)
            return self._mixed(h, level)

    def first(self) -> np.ndarray:
        """The same of the first level for all positions, without look-ups: a polynomial of the last symbols."""
        size = LEVELS[0]
        with np.errstate(over="ignore"):
            h = self.plus * np.uint64(pow(_BASE, size - 1, 1 << 64))
            for back in range(1, size):
                h[back:] += self.plus[: len(h) - back] * np.uint64(pow(_BASE, size - 1 - back, 1 << 64))
        h = self._mixed(h, 0)
        near = (self.start[:, None] + np.arange(size - 1)).reshape(-1)  # at a sentence's start the contexts are shorter
        near = near[near < len(h)]
        h[near] = self.at(near, 0)
        return h

    def _mixed(self, h: np.ndarray, level: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h += np.uint64(level + 1) * _FIRST
            h = K.mix(h)
        h &= ~np.uint64(1)
        return h


@cache
def _anchors() -> np.ndarray:
    from bookflow.llm import language as L

    gram, first = L.features(list(L.ANCHORS.values()))[:2]
    return L._logs(L._counts(gram, first, np.arange(len(L.LANGUAGES)), len(L.LANGUAGES)))


def _languages(texts: list[str]) -> list[str | None]:
    from bookflow.llm import language as L

    gram, first, text, _, _ = L.features([t.replace("\n", " ") for t in texts])
    out: list[str | None] = [None] * len(texts)
    for t, i in zip(text.tolist(), L.scores(gram, first, _anchors()).argmax(axis=1).tolist()):
        out[t] = L.LANGUAGES[i]
    return out


TAILS = "chapter_id long, lang string, ended boolean, broken boolean, line long, line_ctx long, contexts array<long>, before_ended boolean, before_contexts array<long>, whole_contexts array<long>, inner_contexts array<long>"


def _ended(text: str) -> bool:
    """Whether the last sentence has its mark."""
    end = text[-TAIL:].rstrip(_QUOTES)
    return end[-1] in _MARKS or (end[-1] == "." and end[-2:-1] != ".") if end else False


def _state(text: str) -> tuple[bool, str]:
    """(the last sentence has its mark, the text without what stands behind its end)."""
    ended = _ended(text)
    return ended, text if ended else _BEHIND.sub("", text)


#: The contexts at a text's end are first looked for in so many of its characters.
END = 160


def _last_contexts(texts: list[str], size: int = END) -> list[list[int] | None]:
    """The contexts at the end of each text; None where it has no sentence.

    The last characters tell them if they hold the last sentence's start, or more of it than the longest context; else
    the whole text is looked at."""
    sym, start, text, last = _symbols([t[-size:] for t in texts])
    out: list[list[int] | None] = [None] * len(texts)
    sure = np.array([len(t) <= size for t in texts], bool)
    if len(start):
        stop = np.append(start[1:], len(sym))[last]
        contexts = _Contexts(sym, start)
        h = np.stack([contexts.at(stop - 1, j) for j in range(len(LEVELS))], axis=1)
        for t, row in zip(text[last].tolist(), h.view(np.int64).tolist()):
            out[t] = row
        only = np.append(True, last[:-1])[last]  # the text's last sentence here is its first one too
        sure[text[last]] |= ~only | (stop - start[last] > LEVELS[-1] + 2)
    rest = np.flatnonzero(~sure).tolist()
    if rest:
        for i, contexts_of in zip(rest, _last_contexts([texts[i] for i in rest], max(len(texts[i]) for i in rest))):
            out[i] = contexts_of
    return out


def _back(i: int, size: int) -> int:
    """How many characters before the end of a text of this size the other place lies; by the hash of its id."""
    h = i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return 1 + (h >> 8) % min(BACK, size - 1)


def _line_keys(lines: list[str]) -> list[int | None]:
    """A hash of each line's letters; None where it has none."""
    words = ["".join(filter(str.isalpha, line.lower())) for line in lines]
    cp, starts = K.codepoints(words, "")
    some = np.flatnonzero(np.diff(starts)).tolist()
    out: list[int | None] = [None] * len(lines)
    for i, key in zip(some, K.run_hashes(cp, starts[some], starts[1:][some]).view(np.int64).tolist()):
        out[i] = key
    return out


def _tails():
    kinds = [("chapter_id", pa.int64()), ("lang", pa.string()), ("ended", pa.bool_()), ("broken", pa.bool_()), ("line", pa.int64()), ("line_ctx", pa.int64()), ("contexts", pa.list_(pa.int64())), ("before_ended", pa.bool_()), ("before_contexts", pa.list_(pa.int64())), ("whole_contexts", pa.list_(pa.int64())), ("inner_contexts", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in K.slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[list] = []
                doubt: list[tuple[int, str, str, str, bool]] = []
                whole_ends: list[tuple[int, str, int]] = []
                for i, t in zip(ids, texts):
                    s = _stripped(t)
                    if not s:
                        continue
                    ended, bare = _state(s)
                    rows.append([i, None, ended, s.endswith(_BROKEN), *[None] * 7])
                    # a sentence never reaches further back than the longest context needs
                    if not ended:
                        head, _, line = bare.rpartition("\n")
                        before_ended, before = _state(_stripped(head)) if head else (False, "")
                        doubt.append((len(rows) - 1, bare[-2000:], line, before[-2000:] if head else "", before_ended))
                    elif len(s) > 1:
                        whole_ends.append((len(rows) - 1, s[-2000:], _back(i, len(s))))
                if whole_ends:
                    whole, inner = _last_contexts([x[1] for x in whole_ends]), _last_contexts([x[1][: -x[2]] for x in whole_ends])
                    for (r, _, _), w, n, lang in zip(whole_ends, whole, inner, _languages([x[1][-400:] for x in whole_ends])):
                        # (a place between the last letter and its mark is the end itself)
                        rows[r][1], rows[r][9], rows[r][10] = lang, w, n if n != w else None
                if doubt:
                    now = _last_contexts([x[1] for x in doubt])
                    lines = _last_contexts([x[2] for x in doubt])
                    before = _last_contexts([x[3] for x in doubt])
                    langs = _languages([x[1][-400:] for x in doubt])
                    for (r, _, _, b, be), key, c, lc, bc, lang in zip(doubt, _line_keys([x[2] for x in doubt]), now, lines, before, langs):
                        key = key if b else None
                        rows[r][1] = lang
                        rows[r][4:9] = [key, lc[-1] if lc and key is not None else None, c, be if b else None, bc if b and not be else None]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))

    return run


COUNTS = "ctx long, n_end long, n_on long"


def _counter(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        schema = pa.schema([("ctx", pa.int64()), ("n_end", pa.int64()), ("n_on", pa.int64())])
        one, last_slot = np.uint64(1), np.uint64(8 * len(bits) - 1)
        kept: list[np.ndarray] = []  # context hashes whose lowest bit is the outcome
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def fold() -> None:
            codes = np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.append(np.full(min(1, len(codes)), True), codes[1:] != codes[:-1]))
            sums.append((codes[first], np.diff(np.append(first, len(codes)))))
            kept.clear()

        def flush() -> pa.RecordBatch:
            fold()
            codes, n = (np.concatenate(x) for x in zip(*sums))
            sums.clear()
            ctx, inverse = np.unique(codes & ~one, return_inverse=True)
            end = np.bincount(inverse, weights=n * (codes & one).astype(np.int64), minlength=len(ctx)).astype(np.int64)
            total = np.bincount(inverse, weights=n, minlength=len(ctx)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ctx.view(np.int64)), pa.array(end), pa.array(total - end)], schema=schema)

        for batch in batches:
            for _, texts in K.slices(batch.column(0).to_pylist(), batch.column(0).to_pylist()):
                sym, start, text, last = _symbols(texts)
                if not len(start):
                    continue
                # outcome: the sentence's last position ends it; that of a text's last sentence only if a mark says so
                final = np.append(start[1:], len(sym)) - 1
                ended = np.fromiter((_ended(_stripped(t)) for t in texts), bool, len(texts))
                counted, outcome = np.ones(len(sym), bool), np.zeros(len(sym), np.uint64)
                counted[start] = False
                counted[final[last & ~ended[text]]] = False
                outcome[final] = 1
                contexts = _Contexts(sym, start)
                for j in range(len(LEVELS)):
                    # a context in doubt is so with all its shorter ones: what fails at one level fails at the longer ones
                    h = contexts.at(ends, j) if j else contexts.first()
                    slot = (h & last_slot).view(np.int64)
                    ok = ((bits.take(slot >> 3) >> (slot & 7).astype(np.uint8)) & np.uint8(1)).view(bool)
                    if not j:
                        ok &= counted
                    ok = np.flatnonzero(ok)
                    h, ends = h.take(ok), ends.take(ok) if j else ok
                    kept.append(h | outcome.take(ends))
                    held += len(h)
                if held > 1_000_000:
                    fold()
                    held = 0
                if sum(len(n) for _, n in sums) > 3_000_000:
                    yield flush()
        if kept or sums:
            yield flush()

    return run


def _bits(n: int) -> int:
    """The size of the bitmap of so many contexts."""
    return min(max(LEAST_BITS, 1 << (BITS * max(n, 1) - 1).bit_length()), MOST_BITS)


def _bitmap(contexts: DataFrame, n_bits: int) -> bytes:
    """Bits of all contexts looked for: at most 16 MB, whatever the size of the data."""
    slot = F.col("ctx").bitwiseAND(F.lit(n_bits - 1))
    rows = (
        contexts.groupBy(F.shiftright(slot, 5).cast("int").alias("at"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(31)).cast("int"))).alias("bits"))
        .toArrow()  # at most MOST_BITS / 32 rows, as arrays
    )
    words = np.zeros(n_bits // 32, np.uint32)
    words[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return words.tobytes()


def _odds(contexts: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of (chapter_id, ..., contexts, own_end, own_on), without these three, with the log_odds that a sentence ends behind
    the contexts, without so many counts that are the text's own."""
    kept = [c for c in contexts.columns if c not in ("contexts", "own_end", "own_on")]
    seen = lambda c, own: F.greatest(F.coalesce(c, F.lit(0)) - F.col(own), F.lit(0)).cast("double")
    each = (
        contexts.where("contexts is not null")
        .select(*kept, "own_end", "own_on", F.posexplode("contexts").alias("level", "ctx"))
        .join(counts, "ctx", "left")
        .select(*kept, "level", seen("n_end", "own_end").alias("e"), seen("n_on", "own_on").alias("o"))
        .where("level = 0 or e + o > 0")  # a context that is seen nowhere else changes nothing
    )
    # both counts of each level, side by side: at most one row per level, so each sum is that row's count, or 0
    levels = range(len(LEVELS))
    sums = each.groupBy(*kept).agg(*[F.sum(F.when(F.col("level") == j, F.col(c)).otherwise(0.0)).alias(f"{c}{j}") for c in "eo" for j in levels])

    def share(outcome: str, prior: float) -> Column:
        """The share of an outcome, each by itself: 1 less a share that rounds to 1 is 0, which has no logarithm."""
        acc = F.lit(prior)
        for j in levels:
            acc = (F.col(f"{outcome}{j}") + BACKOFF * acc) / (F.col(f"e{j}") + F.col(f"o{j}") + BACKOFF)
        return acc

    return sums.select(*kept, (F.log(share("e", PRIOR)) - F.log(share("o", 1 - PRIOR))).alias("log_odds"))


def _of(rows: DataFrame, column: str) -> DataFrame:
    """A column of contexts of which no count is the text's own."""
    return rows.select("chapter_id", F.col(column).alias("contexts"), F.lit(0).alias("own_end"), F.lit(0).alias("own_on"))


def best_threshold(whole: np.ndarray, inner: np.ndarray) -> float:
    """The threshold with the fewest errors, from counts by bin: shares of whole ends below it and of other places not below it."""
    below = np.concatenate(([0], np.cumsum(whole)))[:-1] / max(whole.sum(), 1)
    above = np.cumsum(inner[::-1])[::-1] / max(inner.sum(), 1)
    error = below + above
    good = np.flatnonzero(error <= error.min() + FLAT)
    return LOWEST + 0.1 * float(good[int(UPPER * (len(good) - 1))])


def thresholds(tails: DataFrame, counts: DataFrame) -> dict[str | None, float]:
    """The threshold of each language, and of all (None), from the ends and other places of all texts that a mark ends."""
    bin_ = F.least(F.greatest(F.floor((F.col("log_odds") - LOWEST) * 10), F.lit(0)), F.lit(int((HIGHEST - LOWEST) * 10) - 1)).cast("int")
    kind = lambda whole, column: F.struct(F.lit(whole).alias("whole"), F.col(column).alias("contexts"))
    both = tails.where("whole_contexts is not null").select("chapter_id", "lang", F.inline(F.array(kind(True, "whole_contexts"), kind(False, "inner_contexts"))))
    each = _odds(both.withColumn("own_end", F.col("whole").cast("int")).withColumn("own_on", (~F.col("whole")).cast("int")), counts)
    rows = each.groupBy("lang", "whole", bin_.alias("bin")).agg(F.count("*").alias("n")).collect()  # a row per language and bin
    bins: dict[str | None, np.ndarray] = {}
    for r in rows:
        for lang in (r["lang"], None):
            bins.setdefault(lang, np.zeros((2, int((HIGHEST - LOWEST) * 10))))[int(r["whole"]), r["bin"]] += r["n"]
    return {None: DEFAULT} | {lang: best_threshold(b[1], b[0]) for lang, b in bins.items() if lang is None or b[1].sum() >= LEAST_TEXTS}


def scored(chapters: DataFrame, key: str = "id", text: str = "translated_text") -> DataFrame:
    """(chapter_id, lang, ended, broken, signoff, log_odds, threshold, cut) of every text that is not blank; log_odds is null where a mark ends it."""
    narrow = chapters.select(F.col(key).cast("long").alias("chapter_id"), F.col(text).alias("text")).where("chapter_id is not null and text is not null")
    tails = written(narrow.mapInArrow(_tails(), TAILS).repartition("chapter_id").groupBy("chapter_id").agg(*[F.first(c).alias(c) for c in ("lang", "ended", "broken", "line", "line_ctx", "contexts", "before_ended", "before_contexts", "whole_contexts", "inner_contexts")]), "tails")
    doubt = tails.where("not ended")
    none = F.array().cast("array<long>")
    contexts = F.concat(*[F.coalesce(c, none) for c in ("contexts", "before_contexts", "whole_contexts", "inner_contexts")], F.array_compact(F.array("line_ctx")))
    total = tails.count()
    bitmap = chapters.sparkSession.sparkContext.broadcast(_bitmap(tails.select(F.explode(contexts).alias("ctx")), _bits(2 * len(LEVELS) * total)))
    counts = written(narrow.select("text").mapInArrow(_counter(bitmap), COUNTS).groupBy("ctx").agg(F.sum("n_end").alias("n_end"), F.sum("n_on").alias("n_on")), "contexts")
    low = thresholds(tails, counts)
    # a sign-off ends many texts, and what stands in that place is never continued
    lines = doubt.where("line is not null").groupBy("line").agg(F.count("*").alias("n_line"), F.min("line_ctx").alias("ctx"))
    signoffs = (
        lines.where((F.col("n_line") >= SIGNOFF_LEAST) & (F.col("n_line") >= SIGNOFF_SHARE * total))
        .join(counts, "ctx", "left")
        .where(F.coalesce("n_on", F.lit(0)) <= 0.5 * F.col("n_line"))
        .select("line", F.lit(True).alias("signoff"))
    )
    threshold = F.lit(low[None])
    for lang, t in low.items():
        if lang is not None:
            threshold = F.when(F.col("lang") == lang, t).otherwise(threshold)
    return (
        tails.join(signoffs, "line", "left")
        .join(_odds(_of(doubt, "contexts"), counts), "chapter_id", "left")
        .join(_odds(_of(doubt, "before_contexts"), counts).withColumnRenamed("log_odds", "before_odds"), "chapter_id", "left")
        .withColumn("signoff", F.coalesce("signoff", F.lit(False)))
        .withColumn("ended", F.when(F.col("signoff"), F.coalesce("before_ended", F.lit(True))).otherwise(F.col("ended")))
        .withColumn("log_odds", F.when(~F.col("ended"), F.when(F.col("signoff"), F.col("before_odds")).otherwise(F.col("log_odds"))))
        .withColumn("threshold", threshold)
        .select("chapter_id", "lang", "ended", "broken", "signoff", "log_odds", "threshold", (~F.col("ended") & (F.col("broken") | F.coalesce(F.col("log_odds") < F.col("threshold"), F.lit(False)))).alias("cut"))
    )


def found(chapters: DataFrame) -> DataFrame:
    """(chapter_id) of the chapters whose translation is cut."""
    return scored(chapters).where("cut").select("chapter_id")


def site_rates(chapters: DataFrame, novels: DataFrame) -> DataFrame:
    """(source_site, n_translated, n_cut, cut_share): how often each source truncates."""
    sites = novels.where("id is not null").groupBy(F.col("id").alias("novel_id")).agg(F.min("source_site").alias("source_site"))
    of = chapters.select(F.col("id").alias("chapter_id"), "novel_id").where("chapter_id is not null").groupBy("chapter_id").agg(F.min("novel_id").alias("novel_id"))
    each = scored(chapters).select("chapter_id", "cut").join(of, "chapter_id").join(sites, "novel_id")
    return each.groupBy("source_site").agg(F.count("*").alias("n_translated"), F.count_if("cut").alias("n_cut")).withColumn("cut_share", F.col("n_cut") / F.col("n_translated"))
