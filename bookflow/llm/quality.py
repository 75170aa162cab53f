"""Text statistics of documents, and which texts are prose, list, table or junk.

Method: a Gaussian mixture is fitted by expectation-maximization on the standardized statistics of all documents. It
starts with a component at each of the inspected examples (``quality_examples.EXAMPLES``: texts that someone looked at and
named), and each component is mapped to the kind of the examples that fall to it; a document has the kind whose components
explain it best.

Which words are common in sentences is learned from the corpus: for each word, the share of documents that have it in a
line shaped like a sentence, against the share that have it in a line shaped like a list's or a table's. The logarithm of
their ratio is the word's lean; names and things, which fill lists as well as sentences, lean to lists or nowhere, and the
words that hold sentences together lean to sentences, in each language and at every size of the corpus, since only shares
are compared. A word's first document does not count, so that no text vouches for its own words: those of random letters
stay unknown. A line is prose if its words lean to sentences in the mean.

Cases: null and blank texts have no kind and zeros for statistics; every row of the input gets a row; very long texts are
read whole; repeated texts count like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm import kernel as K
from bookflow.llm.quality_examples import EXAMPLES
from bookflow.session import written

KINDS = ("prose", "list", "table", "junk")
WORDS = 1 << 18
#: Shares below which a word counts as never seen, and the bounds of its lean.
UNSEEN, MOST_LEAN = 3e-6, 3.0
#: A word with such a lean is common in sentences; a line with such a mean is prose; a line with more symbols is none.
COMMON_LEAN, PROSE_LEAN, MOST_SYMBOLS = 0.7, 0.4, 0.25
ROUNDS = 8
NUMBERS = ("n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "end_share", "common_share", "lean", "prose_share", "known_share", "distinct_share", "words_per_line")
#: Statistics that the mixture sees.
VECTOR = NUMBERS[2:]
LOGARITHMIC = ("mean_word_length", "words_per_line")
STATISTICS = "doc_id long, blank boolean, " + ", ".join(f"{c} double" for c in NUMBERS)
#: Marks that part the fields of a list's or a table's line, and quotes that end a sentence.
_FIELDS = [ord(c) for c in ":=|\t："]
_QUOTES = [ord(c) for c in "\"”“»'’"]


def _analysed(texts: list[str]) -> dict[str, np.ndarray]:
    """Words and lines of a batch."""
    cp, starts = K.codepoints(texts)
    k, t = np.minimum(cp, K.TOP), K.classes()
    flags = t["flags"][k]
    letter, digit, mark = ((flags & x) != 0 for x in (K.LETTER, K.DIGIT, K.MARK))
    space = (flags & (K.SPACE | K.BREAK)) != 0
    ideograph = (flags & K.IDEOGRAPH) != 0
    newline = cp == 10
    line_of = np.cumsum(newline) - newline
    n_lines = int(newline.sum())
    begin = np.concatenate(([0], np.flatnonzero(newline)[:-1] + 1)) if n_lines else np.zeros(0, np.int64)
    inside = letter | digit | mark
    cut = ideograph | np.concatenate(([False], ideograph[:-1]))
    ws, we = K.runs(inside, cut)
    words = (K.run_hashes(t["lower"][k], ws, we) & np.uint64(WORDS - 1)).astype(np.int64)
    letters = np.concatenate(([0], np.cumsum(letter)))
    lettered = letters[we] > letters[ws]
    line = line_of[ws]
    visible = np.add.reduceat(~space, begin, dtype=np.int64) if n_lines else np.zeros(0, np.int64)
    symbol = ~(inside | space)
    symbols = np.add.reduceat(symbol, begin, dtype=np.int64) if n_lines else visible
    digits = np.add.reduceat(digit, begin, dtype=np.int64) if n_lines else visible
    fields = np.add.reduceat(np.isin(cp, _FIELDS), begin, dtype=np.int64) if n_lines else visible
    # the last visible character of each line: an end mark, a quote, or a bracket behind one of them
    at = np.where(space, -1, np.arange(len(cp)))
    last = np.maximum.reduceat(at, begin) if n_lines else visible
    ends = np.zeros(n_lines, bool)
    some = visible > 0
    mark, behind = flags[last[some]], flags[np.maximum(last[some] - 1, 0)]
    ends[some] = ((mark & (K.ENDER | K.FULL)) != 0) | np.isin(cp[last[some]], _QUOTES) | (((mark & K.CLOSER) != 0) & ((behind & (K.ENDER | K.FULL | K.CLOSER)) != 0))
    first = np.minimum.reduceat(np.where(space, len(cp), np.arange(len(cp))), begin) if n_lines else visible
    opens = np.zeros(n_lines, bool)
    opens[some] = ((flags[np.minimum(first[some], len(cp) - 1)] & (K.LETTER | K.CLOSER)) != 0) | np.isin(cp[np.minimum(first[some], len(cp) - 1)], [0xAB, 0x22, 0x201E, 0x201C, 0x2018, 0xBF, 0xA1, 0x200B, 0xFEFF])
    text_of_line = np.searchsorted(starts, begin, side="right") - 1
    return {"words": words, "lettered": lettered, "size": we - ws, "line": line, "visible": visible, "symbols": symbols, "digits": digits, "ends": ends, "opens": opens, "fields": fields, "text": text_of_line}


COUNTS = "word int, n_sentence long, n_list long"


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have each word in a line shaped like a sentence, and in one shaped like a list's or a table's."""
    counts = np.zeros((2, WORDS), np.int64)
    for batch in batches:
        for _, texts in K.slices(batch.column(0).to_pylist(), batch.column(0).to_pylist()):
            a = _analysed(texts)
            n = np.bincount(a["line"], minlength=len(a["visible"]))
            clean, dense = a["symbols"] <= MOST_SYMBOLS * a["visible"], a["symbols"] * 12 > a["visible"] + 24
            sentence = (n >= 4) & a["ends"] & a["opens"] & clean & ~dense & (a["digits"] <= 0.2 * a["visible"])
            listed = (n > 0) & ~a["ends"] & ((n <= 3) | ~a["opens"] | ~clean | dense | (a["fields"] > 0))
            w, line = a["words"][a["lettered"]], a["line"][a["lettered"]]
            code = a["text"][line] * np.int64(WORDS) + w
            for i, of in enumerate((sentence, listed)):
                counts[i] += np.bincount(np.unique(code[of[line]]) % WORDS, minlength=WORDS)
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["word", "n_sentence", "n_list"])


def leans(texts: DataFrame) -> np.ndarray:
    """The lean of each hashed word, NaN if it is unknown: WORDS numbers, whatever the data."""
    rows = (
        texts.mapInArrow(_word_counts, COUNTS)
        .groupBy("word")
        .agg(F.sum("n_sentence").alias("s"), F.sum("n_list").alias("o"))
        .where("s > 1 or o > 1")
        .toPandas()  # at most WORDS rows
    )
    s, o = np.zeros(WORDS), np.zeros(WORDS)
    word = rows["word"].to_numpy()
    s[word], o[word] = np.maximum(rows["s"].to_numpy() - 1, 0), np.maximum(rows["o"].to_numpy() - 1, 0)
    s, o = s / max(s.sum(), 1), o / max(o.sum(), 1)
    out = np.clip(np.log((s + UNSEEN) / (o + UNSEEN)), -MOST_LEAN, MOST_LEAN).astype(np.float32)
    out[np.maximum(s, o) < UNSEEN] = np.nan
    return out


def _statistics(texts: list[str], lean: np.ndarray) -> dict[str, np.ndarray]:
    a = _analysed(texts)
    n, lines = len(texts), len(a["visible"])
    text_of_word = a["text"][a["line"]]
    known = a["lettered"] & ~np.isnan(lean[a["words"]])
    leaning = np.where(known, lean[a["words"]], 0)
    lettered = np.bincount(text_of_word, weights=a["lettered"], minlength=n)
    words = np.bincount(text_of_word, minlength=n)
    of_line = np.bincount(a["line"], weights=a["lettered"], minlength=lines)
    prose_line = (np.bincount(a["line"], weights=leaning, minlength=lines) > PROSE_LEAN * of_line) & (a["symbols"] <= MOST_SYMBOLS * a["visible"])
    total = lambda x: np.bincount(a["text"], weights=x, minlength=n)
    visible, filled = np.maximum(total(a["visible"]), 1), np.maximum(total(a["visible"] > 0), 1)
    pair = np.unique(text_of_word * np.int64(WORDS) + a["words"]) // WORDS
    distinct = np.bincount(pair, minlength=n)
    per, per_lettered = np.maximum(words, 1), np.maximum(lettered, 1)
    return {
        "blank": total(a["visible"]) == 0,
        "n_words": words.astype(float),
        "n_lines": total(a["visible"] > 0),
        "mean_word_length": np.bincount(text_of_word, weights=a["size"], minlength=n) / per,
        "symbol_ratio": total(a["symbols"]) / visible,
        "digit_ratio": total(a["digits"]) / visible,
        "end_share": total(a["ends"]) / filled,
        "common_share": np.bincount(text_of_word, weights=known & (leaning > COMMON_LEAN), minlength=n) / per_lettered,
        "lean": np.bincount(text_of_word, weights=leaning, minlength=n) / per_lettered,
        # of characters and of lines alike, since a list may follow one long sentence
        "prose_share": (total(prose_line * a["visible"]) / visible + total(prose_line) / filled) / 2,
        "known_share": np.bincount(text_of_word, weights=known, minlength=n) / per_lettered,
        # a short text repeats little: against what a text of its length would have
        "distinct_share": np.where(words > 0, np.minimum(distinct / np.maximum(np.minimum(words, 6 * np.sqrt(per)), 1), 1.0), 0.0),
        "words_per_line": words / filled,
    }


def statistics(documents: DataFrame, key: str = "doc_id", text: str = "text", lean: np.ndarray | None = None) -> DataFrame:
    """Every document's statistics."""
    narrow = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if lean is None:
        lean = leans(narrow.select("text"))
    shared = documents.sparkSession.sparkContext.broadcast(lean)  # 1 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in K.slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = _statistics(texts, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s["blank"])] + [pa.array(s[c].astype(float)) for c in NUMBERS], names=["doc_id", "blank", *NUMBERS])

    return narrow.mapInArrow(run, STATISTICS)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Lengths on a logarithmic scale; ratios as they are."""
    x = np.array(x, float)
    for c in LOGARITHMIC:
        x[:, VECTOR.index(c)] = np.log1p(x[:, VECTOR.index(c)])
    return x


class Mixture:
    """A Gaussian mixture with diagonal covariances over standardized statistics, and the kind of each component."""

    #: Statistics are held within so many deviations; variances don't fall below the floor.
    CLIP, FLOOR = 4.0, 0.02
    #: Share of the documents that each example counts for, whatever their number, so that no component loses its meaning.
    PRIOR, SPREAD = 0.002, 0.1

    def __init__(self, mean: np.ndarray, scale: np.ndarray, examples: np.ndarray, kinds: list[str]):
        """``examples``: their statistics, a row each; ``kinds``: what they are."""
        self.mean, self.scale = mean, scale
        self.examples = self.standardized(_scaled(examples))
        n = len(kinds)
        self.mu, self.var, self.pi = self.examples.copy(), np.full_like(self.examples, 0.25), np.full(n, 1 / n)
        self.kind = np.array([KINDS.index(k) for k in kinds])

    def standardized(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -self.CLIP, self.CLIP)

    def responsibilities(self, z: np.ndarray) -> np.ndarray:
        log = np.stack([-0.5 * (((z - m) ** 2 / v).sum(axis=1) + np.log(v).sum()) + np.log(max(p, 1e-12)) for m, v, p in zip(self.mu, self.var, self.pi)], axis=1)
        log -= log.max(axis=1, keepdims=True)
        e = np.exp(log)
        return e / e.sum(axis=1, keepdims=True)

    def updated(self, n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> None:
        """Maximization."""
        prior = self.PRIOR * max(n.sum(), 1.0)
        s1 = s1 + prior * self.examples
        s2 = s2 + prior * (self.examples**2 + self.SPREAD)
        n = n + prior
        self.mu = s1 / n[:, None]
        self.var = np.maximum(s2 / n[:, None] - self.mu**2, self.FLOOR)
        self.pi = n / n.sum()

    def mapped(self) -> None:
        """Each component gets the kind of most examples that fall to it; one without an example keeps its own."""
        r = self.responsibilities(self.examples)
        own = self.kind.copy()
        for c in range(len(self.mu)):
            votes = np.bincount(own, weights=r[:, c], minlength=len(KINDS))
            if votes.sum() > 0.5:
                self.kind[c] = votes.argmax()

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        r = self.responsibilities(z)
        return np.stack([r[:, self.kind == k].sum(axis=1) for k in range(len(KINDS))], axis=1)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return _scaled(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in VECTOR], axis=1))


def fitted(stats: DataFrame, lean: np.ndarray, examples: tuple[tuple[str, str], ...] = EXAMPLES) -> Mixture | None:
    """The mixture fitted on all documents that are not blank: in each round one pass of sums, a row per component."""
    used = stats.where("not blank").select(*VECTOR)
    logs = [F.log1p(c) if c in LOGARITHMIC else F.col(c) for c in VECTOR]
    row = used.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(logs)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(logs)]).first()
    if row["m0"] is None:
        return None
    d = len(VECTOR)
    own = _statistics([text for _, text in examples], lean)
    mixture = Mixture(np.array([row[f"m{i}"] for i in range(d)]), np.maximum([row[f"s{i}"] for i in range(d)], 0.02), np.stack([own[c] for c in VECTOR], axis=1), [kind for kind, _ in examples])
    schema = "component int, n double, " + ", ".join(f"a{i} double, b{i} double" for i in range(d))
    names = ["component", "n", *[x for i in range(d) for x in (f"a{i}", f"b{i}")]]
    for _ in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], mixture: Mixture = mixture) -> Iterator[pa.RecordBatch]:
            k = len(mixture.mu)
            n, s1, s2 = np.zeros(k), np.zeros((k, d)), np.zeros((k, d))
            for batch in batches:
                z = mixture.standardized(_vectors(batch))
                r = mixture.responsibilities(z)
                n, s1, s2 = n + r.sum(axis=0), s1 + r.T @ z, s2 + r.T @ z**2
            cols = [np.arange(k, dtype=np.int32), n, *[x for i in range(d) for x in (s1[:, i], s2[:, i])]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        sums = used.mapInArrow(run, schema).groupBy("component").agg(*[F.sum(c).alias(c) for c in names[1:]]).toPandas().sort_values("component")  # a row per component
        mixture.updated(sums["n"].to_numpy(), sums[[f"a{i}" for i in range(d)]].to_numpy(), sums[[f"b{i}" for i in range(d)]].to_numpy())
    mixture.mapped()
    return mixture


def classified(documents: DataFrame, key: str = "doc_id", text: str = "text", examples: tuple[tuple[str, str], ...] = EXAMPLES) -> DataFrame:
    """Statistics, kind and its probability for every document; no kind for blank texts."""
    lean = leans(documents.select(F.coalesce(F.col(text), F.lit("")).alias("text")))
    stats = written(statistics(documents, key, text, lean), "quality")
    mixture = fitted(stats, lean, examples)
    schema = STATISTICS + ", kind string, probability double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if mixture is None:
                kind, p = [None] * batch.num_rows, [None] * batch.num_rows
            else:
                probabilities = mixture.probabilities(mixture.standardized(_vectors(batch)))
                blank = batch.column("blank").to_pylist()
                best = probabilities.argmax(axis=1)
                kind = [None if b else KINDS[i] for b, i in zip(blank, best.tolist())]
                p = [None if b else float(x) for b, x in zip(blank, probabilities.max(axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind, pa.string()), pa.array(p, pa.float64())], names=[*batch.schema.names, "kind", "probability"])

    return stats.mapInArrow(run, schema)


def found(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose text is for the most part no prose."""
    return classified(documents).where("kind is not null and kind <> 'prose'").select("doc_id")
