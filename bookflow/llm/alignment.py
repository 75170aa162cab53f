"""Sentence alignment of documents that exist in two languages.

Method: dynamic programming over beads (one to one, omission on either side, two to one, one to two), with a
probabilistic model of sentence lengths: the target's length is normal about ``ratio`` times the source's, with a variance
that grows with it. Ratio and variance are estimated from the corpus for each pair of languages (``length_model``). The
programming runs twice. The first run knows lengths only; words that occur together in its one-to-one
beads, counted over the whole corpus, give a lexicon of fixed size. The second run adds to each bead the likeness of its two
sides under that lexicon, with equal numbers as further evidence; sentences that it leaves out on both sides are then
paired if they are alike, which takes care of reordering.

Omissions are free and a bead adds what it is better than the omission of its sentences, so the score of all beginnings of
both texts never falls; a row of the table is the row above, raised by the beads that end in it, and made rising. In the
second run few beads are better than omissions, and only these are looked at.

The lexicon has WORDS hashed words a side and TOP partners for each; its vectors are sent to all tasks and have a fixed size.

Cases: documents with a null or blank text on either side have no pairs; sentences left in the source's language
translate nothing; pieces without a letter are no sentences; repeated rows of an id give their pairs once; documents of
any length are aligned whole, the longest in blocks of rows, so time grows with the product of the two
numbers of sentences and memory does not; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookflow.llm import kernel as K
from bookflow.session import written

#: Hashed words a side; codes beyond are hashed numbers, the same on both sides.
WORDS = 1 << 14
TOP, LEAST_COUNT, LEAST_PHI = 6, 3, 0.08
DIMENSIONS, NUMBER_WEIGHT = 64, 6.0
#: Likeness that a bead needs beyond an omission, cost of a merge or split, weight of the lengths, least likeness of a reordered pair.
LEAST_LIKENESS, BEAD_COST, LENGTH_WEIGHT, REORDERED = 0.34, 0.08, 0.01, 0.5
#: Least likeness of a sentence that joins the partner of its neighbour.
JOINED = 0.38
#: Length model where a pair of languages has too few sentences to estimate it: characters of the target per character of the source, variance per character.
RATIO, VARIANCE, LEAST_PAIRS = 0.8, 6.8, 200
#: First run: what a bead of each kind adds beyond the omission of its sentences, before the cost of its lengths (in units of half its square).
LENGTH_GAINS = {(1, 1): 7.5, (2, 1): 5.5, (1, 2): 8.0}
#: Cells aligned at once; documents beyond that are aligned one by one, in blocks of rows.
CELLS = 120_000
#: A translated sentence is left in the source's language if so many of its words stand in the source.
LEFT_SHARE = 0.6

TOKENS = "chapter_id long, pair int, src_words binary, src_sizes binary, src_chars binary, tgt_words binary, tgt_sizes binary, tgt_chars binary"


def _tokens(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(hash of each word; whether it is a number; its sentence; text of each sentence; characters of each sentence; shares of letters by text: Latin, Persian, ideographs)."""
    cp, starts = K.codepoints(texts)
    k, t = np.minimum(cp, K.TOP), K.classes()
    flags = t["flags"].take(k)
    s, e = K.sentences(cp, flags)
    at = np.flatnonzero((flags & K.MARK) == 0)
    if len(at) < len(k):
        k, flags = k.take(at), flags.take(at)
    ideograph = (flags & K.IDEOGRAPH) != 0
    # a run of letters or of digits; an ideograph stands alone
    kind = flags & np.uint16(K.LETTER | K.DIGIT)
    cut = ideograph.copy()
    cut[1:] |= (kind[1:] != kind[:-1]) | ideograph[:-1]
    ws, we = K.runs(kind != 0, cut)
    words = K.run_hashes(t["value"].take(k), ws, we)
    sentence = np.searchsorted(s, at[ws], side="right") - 1
    ok = (sentence >= 0) & (at[ws] < e[np.maximum(sentence, 0)]) if len(s) else np.zeros(len(ws), bool)
    text = np.searchsorted(starts, s, side="right") - 1
    # the first position of each text among those kept; every text ends with a line feed, so none is empty
    begin = np.searchsorted(at, starts[:-1])
    letters, latin, persian, han = (np.add.reduceat((flags & x) != 0, begin, dtype=np.int64) for x in (K.LETTER, K.LATIN, K.PERSIAN, K.IDEOGRAPH))
    letters = np.maximum(letters, 1)
    return words[ok], ((flags[ws] & K.DIGIT) != 0)[ok], sentence[ok], text, e - s, latin / letters, persian / letters, han / letters


def _target_languages(texts: list[str], latin: np.ndarray, persian: np.ndarray) -> np.ndarray:
    """A number for each target language, so that each has a lexicon of its own: Arabic 0, Persian 1, others by their n-grams."""
    from bookflow.llm.truncation import _languages

    out = np.where(persian > 0.01, 1, 0)
    other = np.flatnonzero(latin > 0.5)
    if len(other):
        names = sorted(["en", "fr", "es", "de"])
        for i, lang in zip(other.tolist(), _languages([texts[i] for i in other.tolist()])):
            out[i] = 2 + names.index(lang) if lang in names else 2
    return out


def _by_text(text: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(text, np.arange(n + 1))


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("chapter_id", pa.int64()), ("pair", pa.int32()), *[(c, pa.binary()) for c in ("src_words", "src_sizes", "src_chars", "tgt_words", "tgt_sizes", "tgt_chars")]])
    for batch in batches:
        ids, raw, translated = (batch.column(i).to_pylist() for i in range(3))
        pairs = list(zip(raw, translated))
        for part, both in K.slices(list(range(len(ids))), [r + t for r, t in pairs], 150_000):
            del both
            src, tgt = [raw[i] for i in part], [translated[i] for i in part]
            a, b = _tokens(src), _tokens(tgt)
            n = len(part)
            lang = _target_languages(tgt, b[5], b[6])
            # a translated sentence most of whose words stand in its source was left as it was
            in_text_a, in_text_b = a[3][a[2]] if len(a[2]) else a[2], b[3][b[2]] if len(b[2]) else b[2]
            # (a source all of whose letters are Latin shares no word with a target that has none)
            may = (a[5] < 1) | (b[5] > 0)
            wa, wb = may[in_text_a], may[in_text_b] & ~b[1]
            with np.errstate(over="ignore"):
                key_a = a[0][wa] + in_text_a[wa].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                key_b = b[0][wb] + in_text_b[wb].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            same = np.zeros(len(b[0]), bool)
            same[wb] = np.isin(key_b, key_a)
            words_b = np.bincount(b[2][~b[1]], minlength=len(b[3]))
            left = np.bincount(b[2][same], minlength=len(b[3])) >= LEFT_SHARE * np.maximum(words_b, 1)
            keep = ~left[b[2]] if len(b[2]) else np.zeros(0, bool)
            with np.errstate(over="ignore"):
                code_a = (K.mix(a[0] + lang[in_text_a].astype(np.uint64) * np.uint64(7919)) & np.uint64(WORDS - 1)).astype(np.uint16)
                code_b = (K.mix(b[0]) & np.uint64(WORDS - 1)).astype(np.uint16)
            code_a[a[1]] = (K.mix(a[0][a[1]]) & np.uint64(WORDS - 1)).astype(np.uint16) + WORDS
            code_b[b[1]] = (K.mix(b[0][b[1]]) & np.uint64(WORDS - 1)).astype(np.uint16) + WORDS
            # the pair of languages: the source's by its script, the target's as above
            pair = np.select([a[7] > 0.2, a[5] > 0.5, a[6] > 0.01], [1, 0, 2], 3) * 8 + lang
            # sentences of both sides by document; documents without any on a side are left out
            sides = []
            for x, code, sel in ((a, code_a, None), (b, code_b, keep)):
                of, code = (x[2], code) if sel is None else (x[2][sel], code[sel])
                sizes = np.bincount(of, minlength=len(x[3]))
                sides.append((code, sizes, x[4], _by_text(x[3], n), np.concatenate(([0], np.cumsum(sizes)))))
            full = np.flatnonzero(np.all([np.diff(side[3]) > 0 for side in sides], axis=0))
            if not len(full):
                continue
            columns = [pa.array(np.array([ids[part[i]] for i in full.tolist()], np.int64)), pa.array(pair[full].astype(np.int32))]
            for code, sizes, chars, by, w in sides:
                columns += [_binaries(code, w[by], full, np.uint16), _binaries(sizes, by, full, np.uint32), _binaries(chars, by, full, np.uint32)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _binaries(values: np.ndarray, edges: np.ndarray, chosen: np.ndarray, dtype) -> pa.Array:
    """The values between neighbouring edges as bytes, for the chosen places."""
    bounds = edges * np.dtype(dtype).itemsize
    every = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(values.astype(dtype).tobytes())])
    return every if len(chosen) == len(every) else every.take(pa.array(chosen))


class _Side:
    """The sentences of one side of many documents, padded to one size when asked for."""

    def __init__(self, words: list[bytes], sizes: list[bytes], chars: list[bytes]):
        self.sizes = [np.frombuffer(x, np.uint32) for x in sizes]
        self.chars = [np.frombuffer(x, np.uint32) for x in chars]
        self.words = [np.frombuffer(x, np.uint16) for x in words]
        self.n = np.array([len(x) for x in self.sizes])


def _length_cost(x: np.ndarray, y: np.ndarray, ratio, variance) -> np.ndarray:
    """Squared deviation of the target's length from what the source's length lets expect, in units of its spread."""
    return np.minimum((y - ratio * x) ** 2 / (variance * np.maximum(x, 1)), 50.0)


#: Beads other than omissions: sentences taken on each side. Beside their numbers, a cell may say that a sentence of either side is left out.
BEADS = ((1, 1), (2, 1), (1, 2))
UP, LEFT = 3, 4


def _forward(low: int, high: int, before: np.ndarray | None, above: np.ndarray, beads, back: np.ndarray | None = None) -> tuple[np.ndarray | None, np.ndarray]:
    """The last two rows of scores up to row ``high``, from rows low - 1 and low; a row holds [j, document].

    ``beads(i, above, before, row, back)`` raises a row by the beads that end in it."""
    for i in range(low + 1, high + 1):
        row = above.copy()
        way = None if back is None else back[i - low]
        beads(i, above, before, row, way)
        risen = _risen(row)
        if way is not None:
            left = (risen > row).view(np.int8)
            way += left * (np.int8(LEFT) - way)
        before, above = above, risen
    return before, above


def _risen(row: np.ndarray) -> np.ndarray:
    """The greatest value up to each j: by doubling, since many documents stand side by side."""
    if row.shape[1] == 1:
        return np.maximum.accumulate(row.reshape(-1)).reshape(-1, 1)
    reach = 1
    while reach < len(row):
        risen = np.empty_like(row)
        risen[:reach] = row[:reach]
        np.maximum(row[reach:], row[:-reach], out=risen[reach:])
        row = risen
        reach *= 2
    return row


def _way_back(back: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rows (document, i, j, bead) of the beads on the best paths; ``back[i, j, document]`` tells how a cell was reached."""
    doc, i, j = np.arange(len(n)), n.copy(), m.copy()
    steps = np.array([*BEADS, (1, 0), (0, 1)])
    out = [np.zeros((0, 4), np.int64)]
    while True:
        on = (i > 0) & (j > 0)
        if not on.all():
            doc, i, j = doc[on], i[on], j[on]
        if not len(doc):
            return np.concatenate(out)
        b = back[i, j, doc]
        i, j = i - steps[b, 0], j - steps[b, 1]
        bead = b < UP
        out.append(np.stack((doc[bead], i[bead], j[bead], b[bead]), axis=1))


def _by_gains(gains: list[np.ndarray | None]):
    """Beads of all cells: ``gains[bead][i, j, document]`` is what the bead that begins at sentences i, j adds."""

    space: list[np.ndarray] = []

    def beads(i: int, above: np.ndarray, before: np.ndarray | None, row: np.ndarray, way: np.ndarray | None) -> None:
        if not space or space[0].shape[1:] != row.shape:
            space[:] = [np.full((len(BEADS), *row.shape), -1e9, np.float32)]
        values = space[0]
        for bead, (di, dj) in enumerate(BEADS):
            start = above if di == 1 else before
            if start is None or gains[bead] is None:
                values[bead] = -1e9
                continue
            np.add(start[: len(start) - dj], gains[bead][i - di], out=values[bead, dj:])
            np.maximum(row, values[bead], out=row)
        if way is not None:  # the first of: nothing, and the beads in their order, that gives the row's value; by sums, which are faster than choices
            way[:] = np.int8(len(BEADS) - 1)
            for bead in range(len(BEADS) - 2, -1, -1):
                way += (row == values[bead]).view(np.int8) * (np.int8(bead) - way)
            way += (row == above).view(np.int8) * (np.int8(UP) - way)

    return beads


class _Some:
    """Beads of some cells, by the row in which they end: document, i, j, bead and gain of each."""

    def __init__(self, doc: np.ndarray, i: np.ndarray, j: np.ndarray, bead: np.ndarray, gain: np.ndarray, n: int, documents: int, first: int = 0):
        steps = np.array(BEADS)
        end = (i + steps[bead, 0]) * len(BEADS) + bead
        order = np.argsort(end, kind="stable")
        self.bounds = np.searchsorted(end[order], np.arange((n + 1) * len(BEADS) + 1))
        self.start = (j * documents + doc)[order]
        self.stop = self.start + steps[bead[order], 1] * documents
        self.gain, self.first = gain[order], first

    def __call__(self, i: int, above: np.ndarray, before: np.ndarray | None, row: np.ndarray, way: np.ndarray | None) -> None:
        flat = row.reshape(-1)
        for bead, (di, _) in enumerate(BEADS):
            k = (i - self.first) * len(BEADS) + bead
            u, v = self.bounds[k], self.bounds[k + 1]
            start = above if di == 1 else before
            if u == v or start is None:
                continue
            stop = self.stop[u:v]
            value = start.reshape(-1)[self.start[u:v]] + self.gain[u:v]
            better = value > flat[stop]
            flat[stop[better]] = value[better]
            if way is not None:
                way.reshape(-1)[stop[better]] = bead


def _paths(n: np.ndarray, m: np.ndarray, beads) -> np.ndarray:
    """Rows (document, i, j, bead) of the best paths of many documents at once."""
    d, big_n, big_m = len(n), int(n.max()), int(m.max())
    back = np.full((big_n + 1, big_m + 1, d), UP, np.int8)
    _forward(0, big_n, None, np.zeros((big_m + 1, d), np.float32), beads, back)
    return _way_back(back, n, m)


def _long_path(n: int, m: int, beads_of, cells: int) -> np.ndarray:
    """The same for one document of any length. The scores run forward row by row, and two rows are kept where each block of
    rows begins; then the blocks are run again from the last one, each with its way back. ``beads_of(p, high)``: the beads
    that begin in rows p to high, with i counted from p."""
    step = max(cells // (m + 1), math.isqrt(n) + 1)
    state: tuple[np.ndarray | None, np.ndarray] = (None, np.zeros((m + 1, 1), np.float32))
    kept = []
    for low in range(0, n, step):
        kept.append(state)
        high = min(n, low + step)
        state = _forward(low, high, *state, beads_of(max(low - 1, 0), high))
    i, j, out = n, m, []
    for low in range(step * (len(kept) - 1), -1, -step):
        high = min(n, low + step)
        if i <= low:  # a bead of two sentences crossed the border
            continue
        back = np.full((high - low + 1, m + 1, 1), UP, np.int8)
        _forward(low, high, *kept[low // step], beads_of(max(low - 1, 0), high), back)
        while i > low and j > 0:
            b = int(back[i - low, j, 0])
            di, dj = (*BEADS, (1, 0), (0, 1))[b]
            i, j = i - di, j - dj
            if b < UP:
                out.append((0, i, j, b))
    return np.array(out, np.int64).reshape(-1, 4)


def _blocks(n: np.ndarray, m: np.ndarray, cells: int = CELLS) -> Iterator[np.ndarray]:
    """Documents of like size together, so that padding costs little."""
    order = np.lexsort((m, n))
    order = order[np.argsort(np.maximum(n, m)[order], kind="stable")]
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * (n[order[start : stop + 1]].max() + 1) * (m[order[start : stop + 1]].max() + 1) <= cells and stop - start < 4000:
            stop = min(len(order), stop + 16)
        yield order[start:stop]
        start = stop


def _padded(values: list[np.ndarray], size: int, dtype=np.float32) -> np.ndarray:
    out = np.zeros((len(values), size), dtype)
    for r, v in enumerate(values):
        out[r, : len(v)] = v
    return out


class _Model:
    """The length model by pair of languages: ratio and variance."""

    def __init__(self, rows: list[tuple[int, float, float]]):
        self.of = {p: (r, v) for p, r, v in rows}

    def __call__(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, v = zip(*(self.of.get(p, (RATIO, VARIANCE)) for p in pairs.tolist()))
        return np.array(r, np.float32), np.array(v, np.float32)


SUMS = "pair int, n long, x double, y double, yy double"


def _sums_of(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total[:, 0])
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at, 0].astype(np.int64)), *[pa.array(total[at, i]) for i in (1, 2, 3)]], names=["pair", "n", "x", "y", "yy"])


def _mean_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By pair of languages, over all documents: their number and the sums of the mean lengths of their sentences."""
    total = np.zeros((32, 4))
    for batch in batches:
        sizes = [np.fromiter(map(len, c), np.int64, len(c)) // 4 for c in (batch.column(i).to_pylist() for i in (1, 2))]
        some = (sizes[0] > 0) & (sizes[1] > 0)
        pair = batch.column(0).to_numpy()[some]
        total[:, 0] += np.bincount(pair, minlength=32)
        for k, n in enumerate(sizes, 1):
            chars = np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32)
            ends = np.concatenate(([0], np.cumsum(chars, dtype=np.int64)))[np.cumsum(n)]
            total[:, k] += np.bincount(pair, weights=(np.diff(ends, prepend=0) / np.maximum(n, 1))[some], minlength=32)
    yield _sums_of(total)


def _length_sums(batches: Iterator[pa.RecordBatch], start: _Model | None = None) -> Iterator[pa.RecordBatch]:
    """Sums of lengths by pair of languages, over the one-to-one beads of all documents under a first model, which is that of the batches' own means where none is given."""
    if start is None:
        batches = list(batches)
        start = _first_model(zip(*(c.to_pylist() for c in next(_mean_sums(iter(batches))).columns)))
    total = np.zeros((32, 4))
    for batch in batches:
        c = [column.to_pylist() for column in batch.columns]
        for lo in range(0, len(c[0]), 2000):
            pair, x, y = (column[lo : lo + 2000] for column in c)
            pair, src, tgt = np.array(pair), _Side([], x, x), _Side([], y, y)
            beads = _pairs_by_length(src, tgt, pair, start)
            x, y = (np.concatenate(side.chars).astype(float)[(np.cumsum(side.n) - side.n)[beads[:, 0]] + beads[:, k]] for side, k in ((src, 1), (tgt, 2)))
            for k, values in enumerate((np.ones(len(x)), x, y, y * y / np.maximum(x, 1))):
                total[:, k] += np.bincount(pair[beads[:, 0]], weights=values, minlength=32)
    yield _sums_of(total)


def _first_model(sums: Iterable[tuple]) -> _Model:
    """From the sums of means: what a sentence's length becomes, whatever is left out on either side."""
    return _Model([(pair, y / x, VARIANCE) for pair, _, x, y, _ in sums if x > 0])


def _estimated(n: float, x: float, y: float, yy: float) -> tuple[float, float]:
    """(ratio, variance per character) from the number of pairs and the sums of x, y and y * y / x."""
    r = y / x
    return r, max((yy - 2 * r * y + r * r * x) / n, 1.0)


def length_model(tokens: DataFrame) -> _Model:
    """Ratio and variance of each pair of languages with LEAST_PAIRS pairs of sentences, from the one-to-one beads of all documents; at most 32 rows."""
    lengths = tokens.select("pair", "src_chars", "tgt_chars")
    summed = lambda run: lengths.mapInArrow(run, SUMS).groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "yy")]).where(F.col("x") > 0).collect()
    start = _first_model(summed(_mean_sums))
    return _Model([(r["pair"], *_estimated(r["n"], r["x"], r["y"], r["yy"])) for r in summed(lambda batches: _length_sums(batches, start)) if r["n"] >= LEAST_PAIRS])


def _length_gains(x: np.ndarray, y: np.ndarray, ratio: np.ndarray, variance: np.ndarray) -> list[np.ndarray | None]:
    """What lengths let each bead add: [i, j, document] for lengths x [i, document] and y [j, document]."""

    def gain(bead: tuple[int, int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        scale = 1 / np.sqrt(variance * np.maximum(x, 1))
        out = y[None] * scale[:, None]
        out -= (ratio * x * scale)[:, None]
        np.multiply(out, out, out=out)
        return np.subtract(np.float32(LENGTH_GAINS[bead]), out, out=out)

    two_x, two_y = x[:-1] + x[1:], y[:-1] + y[1:]
    return [gain((1, 1), x, y), gain((2, 1), two_x, y) if len(two_x) else None, gain((1, 2), x, two_y) if len(two_y) else None]


def _pairs_by_length(src: _Side, tgt: _Side, pairs: np.ndarray, model: _Model) -> np.ndarray:
    """(document, i, j) of the one-to-one beads that lengths alone suggest."""
    some = np.flatnonzero((src.n > 0) & (tgt.n > 0))
    ratio, variance = model(pairs) if len(pairs) else (np.zeros(0), np.zeros(0))
    long = (src.n[some] + 1) * (tgt.n[some] + 1) > CELLS
    out = [np.zeros((0, 3), np.int64)]
    short = some[~long]
    for which in _blocks(src.n[short], tgt.n[short]):
        docs = short[which]
        n, m = src.n[docs], tgt.n[docs]
        x, y = _padded([src.chars[d] for d in docs], n.max()), _padded([tgt.chars[d] for d in docs], m.max())
        rows = _paths(n, m, _by_gains(_length_gains(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), ratio[docs], variance[docs])))
        rows = rows[rows[:, 3] == 0][:, :3]
        rows[:, 0] = docs[rows[:, 0]]
        out.append(rows)
    for d in some[long]:
        x, y = src.chars[d].astype(np.float32)[:, None], tgt.chars[d].astype(np.float32)[:, None]

        def beads_of(p: int, high: int, x=x, y=y, d=d):
            rows = _by_gains(_length_gains(x[p:high], y, ratio[[d]], variance[[d]]))
            return lambda i, *rest: rows(i - p, *rest)

        rows = _long_path(int(src.n[d]), int(tgt.n[d]), beads_of, CELLS)
        rows = rows[rows[:, 3] == 0][:, :3]
        rows[:, 0] = d
        out.append(rows)
    return np.concatenate(out)


COUNTS = "s int, t int, n long"
#: Pairs of words that a task holds before it gives its sums on.
MOST_CODES = 4_000_000


def _cooccurrences(model: _Model):
    return lambda batches: _counted(batches, model)


def _counted(batches: Iterator[pa.RecordBatch], model: _Model) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("s", pa.int32()), ("t", pa.int32()), ("n", pa.int64())])
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        codes, counts = np.concatenate([c for c, _ in kept]), np.concatenate([c for _, c in kept])
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        return codes[first], np.add.reduceat(counts, first)

    def batch_of(u: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        u = u.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array((u // (WORDS + 1)).astype(np.int32)), pa.array((u % (WORDS + 1)).astype(np.int32)), pa.array(n.astype(np.int64))], schema=schema)

    for batch in batches:
        c = [batch.column(i).to_pylist() for i in range(8)]
        for lo in range(0, len(c[0]), 2000):
            part = slice(lo, lo + 2000)
            src, tgt = _Side(c[2][part], c[3][part], c[4][part]), _Side(c[5][part], c[6][part], c[7][part])
            pairs = _pairs_by_length(src, tgt, np.array(c[1][part]), model)
            if not len(pairs):
                continue
            sides = []
            for side, column in ((src, 1), (tgt, 2)):
                sizes = np.concatenate(side.sizes).astype(np.int64)
                words = np.concatenate(side.words)
                first = np.concatenate(([0], np.cumsum(side.n)[:-1]))
                at = np.concatenate(([0], np.cumsum(sizes)))
                which = first[pairs[:, 0]] + pairs[:, column]
                sides.append((words, at[which], sizes[which]))
            (wa, sa, na), (wb, sb, nb) = sides
            ok = (na > 0) & (nb > 0)
            if not ok.any():  # as where every sentence was left in the source's language
                continue
            sa, na, sb, nb = sa[ok], na[ok], sb[ok], nb[ok]
            total += len(na)
            # the words of both sides of all pairs, one after the other; numbers have their own codes and need no lexicon
            flat = []
            for words, at, size in ((wa, sa, na), (wb, sb, nb)):
                begin = np.concatenate(([0], np.cumsum(size)[:-1]))
                w = words[np.repeat((at - begin).astype(np.int32), size) + np.arange(int(size.sum()), dtype=np.int32)].astype(np.int32)
                word = w < WORDS
                flat.append((w[word], np.add.reduceat(word, begin, dtype=np.int32)))
            (wa, na), (wb, nb) = flat
            # each source word meets the run of its pair's target words
            runs = np.repeat(nb, na)
            begin = np.concatenate(([0], np.cumsum(nb)[:-1])).astype(np.int32)
            first = np.concatenate(([0], np.cumsum(runs)[:-1])).astype(np.int32)
            t = wb[np.repeat(np.repeat(begin, na) - first, runs) + np.arange(int(runs.sum()), dtype=np.int32)]
            codes = [np.repeat(wa * np.int32(WORDS + 1), runs) + t, wa * np.int32(WORDS + 1) + np.int32(WORDS), np.int32(WORDS * (WORDS + 1)) + wb]
            u, n = np.unique(np.concatenate(codes).astype(np.int32), return_counts=True)
            kept.append((u, n))
            if len(kept) > 30:
                kept[:] = [merged()]
                if len(kept[0][0]) > MOST_CODES:
                    yield batch_of(*kept.pop())
    if kept:
        u, n = merged()
        yield batch_of(np.append(u, WORDS * (WORDS + 1) + WORDS), np.append(n, total))
    elif total:
        yield batch_of(np.array([WORDS * (WORDS + 1) + WORDS]), np.array([total]))


def lexicon(tokens: DataFrame, model: _Model) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all codes, source and target: a source word points where its partners do."""
    counts = tokens.mapInArrow(_cooccurrences(model), COUNTS).groupBy("s", "t").agg(F.sum("n").alias("n"))
    counts = written(counts.where((F.col("n") >= LEAST_COUNT) | (F.col("s") == WORDS) | (F.col("t") == WORDS)), "cooccurrences")  # rarer pairs are no partners
    ms = counts.where((F.col("t") == WORDS) & (F.col("s") < WORDS)).select("s", F.col("n").alias("ns"))
    mt = counts.where((F.col("s") == WORDS) & (F.col("t") < WORDS)).select("t", F.col("n").alias("nt"))
    total = counts.where((F.col("s") == WORDS) & (F.col("t") == WORDS)).first()
    rng = np.random.default_rng(17)
    base = rng.choice(np.array([-1.0, 1.0], np.float32), (2 * WORDS, DIMENSIONS)) / np.float32(np.sqrt(DIMENSIONS))
    vs, vt = np.zeros_like(base), np.zeros_like(base)
    vs[WORDS:] = vt[WORDS:] = base[WORDS:] * np.float32(NUMBER_WEIGHT)
    if total is None:
        return vs, vt
    n = float(total["n"])
    phi = (n * F.col("n") - F.col("ns") * 1.0 * F.col("nt")) / F.sqrt(F.col("ns") * 1.0 * F.col("nt") * F.greatest(n - F.col("ns"), F.lit(1.0)) * F.greatest(n - F.col("nt"), F.lit(1.0)))
    w = Window.partitionBy("s").orderBy(F.desc("phi"), "t")
    best = (
        counts.where((F.col("s") < WORDS) & (F.col("t") < WORDS) & (F.col("n") >= LEAST_COUNT))
        .join(F.broadcast(ms), "s")  # at most WORDS rows each
        .join(F.broadcast(mt), "t")
        .withColumn("phi", phi)
        .where(F.col("phi") >= LEAST_PHI)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= TOP)
        .select("s", "t", "phi", "ns")
        .toPandas()  # at most WORDS * TOP rows
    )
    for t, c in mt.toPandas().itertuples(index=False):
        vt[t] = base[t] * np.float32(np.log(1 + n / c))
    for s, g in best.groupby("s"):
        v = (base[g["t"].to_numpy()] * (g["phi"].to_numpy(np.float32) ** 2)[:, None]).sum(axis=0)
        vs[s] = v / np.linalg.norm(v) * np.float32(np.log(1 + n / g["ns"].iloc[0]))
    return vs, vt


def _vectors(side: _Side, table: np.ndarray) -> list[np.ndarray]:
    """The sum of its words' vectors for each sentence, by document."""
    sizes = np.concatenate(side.sizes).astype(np.int64)
    words = np.concatenate(side.words)
    sums = np.zeros((len(sizes), DIMENSIONS), np.float32)
    # sentences of one size together: a sum along an axis of a dense block
    at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(order) else []
    for u, v in zip(edges, [*edges[1:], len(order)]):
        if size := int(ordered[u]):
            which = order[u:v]
            for lo in range(0, len(which), 256):
                part = which[lo : lo + 256]
                sums[part] = table.take(words.take(at[part][:, None] + np.arange(size)), axis=0).sum(axis=1)
    return np.split(sums, np.cumsum(side.n)[:-1])


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("dik,dik->di", a, a))


def _likeness(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Cosines of all vectors of both sides: [document, i, j]."""
    like = a @ b.transpose(0, 2, 1)
    like /= np.maximum(na, np.float32(1e-6))[:, :, None]
    like /= np.maximum(nb, np.float32(1e-6))[:, None]
    return like


#: Least likeness of each sentence of a merge or split: one that adds nothing is no part of the bead.
LEAST_PART = 0.15


def _better_beads(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, na: np.ndarray, nb: np.ndarray, like: np.ndarray, ratio: np.ndarray, variance: np.ndarray, first: int = 0) -> _Some:
    """The beads that are better than omissions, with what they add: likeness beyond LEAST_LIKENESS, less the cost of their lengths.

    a, b: [document, sentence, dimension]; x, y: characters; na, nb: norms; ratio, variance: by document."""
    cost = lambda d, u, v: np.float32(LENGTH_WEIGHT) * np.minimum(_length_cost(u, v, ratio[d], variance[d]), 10)
    d, i, j = _where(like > LEAST_LIKENESS)
    found = [(d, i, j, np.zeros(len(d), np.int64), like[d, i, j] - np.float32(LEAST_LIKENESS) - cost(d, x[d, i], y[d, j]))]
    part = like > LEAST_PART
    for bead, (u, v) in ((1, (1, 0)), (2, (0, 1))):
        d, i, j = _where(part[:, : part.shape[1] - u, : part.shape[2] - v] & part[:, u:, v:])
        if u:
            two = np.sqrt(np.maximum(na[d, i] ** 2 + na[d, i + 1] ** 2 + 2 * _cross(a)[d, i], 0))
            both = (like[d, i, j] * na[d, i] + like[d, i + 1, j] * na[d, i + 1]) / np.maximum(two, np.float32(1e-6))
            lengths = cost(d, x[d, i] + x[d, i + 1], y[d, j])
        else:
            two = np.sqrt(np.maximum(nb[d, j] ** 2 + nb[d, j + 1] ** 2 + 2 * _cross(b)[d, j], 0))
            both = (like[d, i, j] * nb[d, j] + like[d, i, j + 1] * nb[d, j + 1]) / np.maximum(two, np.float32(1e-6))
            lengths = cost(d, x[d, i], y[d, j] + y[d, j + 1])
        found.append((d, i, j, np.full(len(d), bead), np.float32(1.1) * both - np.float32(LEAST_LIKENESS + BEAD_COST) - lengths))
    d, i, j, bead, gain = (np.concatenate(c) for c in zip(*found))
    ok = gain > 0
    return _Some(d[ok], i[ok], j[ok], bead[ok], gain[ok].astype(np.float32), a.shape[1], len(a), first)


def _where(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As np.nonzero, which is slower for more than one dimension."""
    at = np.flatnonzero(flags)
    rest, j = np.divmod(at, max(flags.shape[2], 1))
    d, i = np.divmod(rest, max(flags.shape[1], 1))
    return d, i, j


def _cross(a: np.ndarray) -> np.ndarray:
    """Products of neighbours."""
    return np.einsum("dik,dik->di", a[:, :-1], a[:, 1:])


def _links(rows: np.ndarray) -> np.ndarray:
    """The pairs of sentences of beads (document, i, j, bead)."""
    bead = rows[:, 3]
    return np.concatenate((rows[:, :3], rows[bead == 1][:, :3] + [0, 1, 0], rows[bead == 2][:, :3] + [0, 0, 1]))


def _pairs(src: _Side, tgt: _Side, vs: np.ndarray, vt: np.ndarray, pairs: np.ndarray, model: _Model) -> np.ndarray:
    """(document, i, j) of all pairs of sentences that translate one another."""
    a_all, b_all = _vectors(src, vs), _vectors(tgt, vt)
    ratio, variance = model(pairs)
    docs_all = np.flatnonzero((src.n > 0) & (tgt.n > 0))
    long = (src.n[docs_all] + 1) * (tgt.n[docs_all] + 1) > CELLS
    out = [np.zeros((0, 3), np.int64)]
    some = docs_all[~long]
    for which in _blocks(src.n[some], tgt.n[some]):
        docs = some[which]
        n, m = src.n[docs], tgt.n[docs]
        x, y = _padded([src.chars[d] for d in docs], n.max()), _padded([tgt.chars[d] for d in docs], m.max())
        a = np.zeros((len(docs), n.max(), DIMENSIONS), np.float32)
        b = np.zeros((len(docs), m.max(), DIMENSIONS), np.float32)
        for r, d in enumerate(docs):
            a[r, : n[r]], b[r, : m[r]] = a_all[d], b_all[d]
        na, nb = _norms(a), _norms(b)
        like = _likeness(a, b, na, nb)
        links = _links(_paths(n, m, _better_beads(a, b, x, y, na, nb, like, ratio[docs], variance[docs])))
        links = np.concatenate((links, _reordered(like, links, n, m)))
        links = np.concatenate((links, _joined(a, b, na, nb, links, n, m)))
        links[:, 0] = docs[links[:, 0]]
        out.append(links)
    for d in docs_all[long]:
        links = _long_pairs(a_all[d], b_all[d], src.chars[d].astype(np.float32), tgt.chars[d].astype(np.float32), ratio[[d]], variance[[d]])
        links[:, 0] = d
        out.append(links)
    return np.concatenate(out)


def _long_pairs(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, ratio: np.ndarray, variance: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """(0, i, j) of the pairs of one document that is too long for one table of all cells."""
    a, b, x, y = a[None], b[None], x[None], y[None]
    na, nb = _norms(a), _norms(b)
    n, m = np.array([a.shape[1]]), np.array([b.shape[1]])

    def beads_of(p: int, high: int) -> _Some:
        ab, nab = a[:, p:high], na[:, p:high]
        return _better_beads(ab, b, x[:, p:high], y, nab, nb, _likeness(ab, b, nab, nb), ratio, variance, p)

    links = _links(_long_path(a.shape[1], b.shape[1], beads_of, cells))
    links = np.concatenate((links, _long_reordered(a, b, na, nb, links, n, m, cells)))
    return np.concatenate((links, _joined(a, b, na, nb, links, n, m)))


def _long_reordered(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, links: np.ndarray, n: np.ndarray, m: np.ndarray, cells: int) -> np.ndarray:
    """As _reordered for one document: taking the most alike of what is left is taking pairs that are each other's best."""
    free_a, free_b = (np.flatnonzero(f[0]) for f in _free(links, n, m, a.shape[1], b.shape[1]))
    found = [(np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, cells // max(1, len(free_b)))
    for low in range(0, len(free_a) if len(free_b) else 0, step):
        rows = free_a[low : low + step]
        like = _likeness(a[:, rows], b[:, free_b], na[:, rows], nb[:, free_b])[0]
        i, j = np.nonzero(like >= REORDERED)
        found.append((like[i, j], rows[i], free_b[j]))
    value, i, j = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((j, i, -value))
    used_i, used_j, out = set(), set(), []
    for p, q in zip(i[order].tolist(), j[order].tolist()):
        if p not in used_i and q not in used_j:
            used_i.add(p)
            used_j.add(q)
            out.append((0, p, q))
    return np.array(out, np.int64).reshape(-1, 3)


def _free(links: np.ndarray, n: np.ndarray, m: np.ndarray, big_n: int, big_m: int) -> tuple[np.ndarray, np.ndarray]:
    """Sentences without a link, by document: (documents, source), (documents, target)."""
    a = np.arange(big_n)[None, :] < n[:, None]
    b = np.arange(big_m)[None, :] < m[:, None]
    a[links[:, 0], links[:, 1]] = False
    b[links[:, 0], links[:, 2]] = False
    return a, b


def _reordered(like: np.ndarray, links: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Links between sentences left out on both sides: pairs that are each other's best and alike enough."""
    a, b = _free(links, n, m, *like.shape[1:])
    docs = np.flatnonzero(a.any(axis=1) & b.any(axis=1))
    out = [np.zeros((0, 3), np.int64)]
    if not len(docs):
        return out[0]
    free = np.where(a[docs][:, :, None] & b[docs][:, None, :], like[docs], np.float32(-1))
    while True:
        j, i = free.argmax(axis=2), free.argmax(axis=1)
        value = np.take_along_axis(free, j[:, :, None], axis=2)[:, :, 0]
        mutual = (np.take_along_axis(i, j, axis=1) == np.arange(free.shape[1])[None, :]) & (value >= REORDERED)
        d, i = np.nonzero(mutual)
        if not len(d):
            return np.concatenate(out)
        j = j[d, i]
        out.append(np.stack((docs[d], i, j), axis=1))
        free[d, i, :] = -1
        free[d, :, j] = -1


def _joined(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, links: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Links of a sentence left out with the partner of its neighbour, where the two together are more like it than the neighbour alone."""
    free_a, free_b = _free(links, n, m, a.shape[1], b.shape[1])
    out = [np.zeros((0, 3), np.int64)]
    dot = lambda d, i, j: np.einsum("lk,lk->l", a[d, i], b[d, j])
    like = lambda d, i, j: dot(d, i, j) / np.maximum(na[d, i] * nb[d, j], np.float32(1e-6))
    for step in (1, -1):
        # source: sentence i = neighbour - step is free
        d, i, j = links.T
        k = i - step
        ok = (k >= 0) & (k < n[d])
        d, i, j, k = d[ok], i[ok], j[ok], k[ok]
        ok = free_a[d, k]
        d, i, j, k = d[ok], i[ok], j[ok], k[ok]
        ok = like(d, k, j) >= JOINED
        d, i, j, k = d[ok], i[ok], j[ok], k[ok]
        if len(d):
            two = np.linalg.norm(a[d, i] + a[d, k], axis=1)
            both = (dot(d, i, j) + dot(d, k, j)) / np.maximum(two * nb[d, j], 1e-6)
            ok = both > like(d, i, j) + 0.02
            out.append(np.stack((d[ok], k[ok], j[ok]), axis=1))
        d, i, j = links.T
        k = j - step
        ok = (k >= 0) & (k < m[d])
        d, i, j, k = d[ok], i[ok], j[ok], k[ok]
        ok = free_b[d, k]
        d, i, j, k = d[ok], i[ok], j[ok], k[ok]
        ok = like(d, i, k) >= JOINED
        d, i, j, k = d[ok], i[ok], j[ok], k[ok]
        if len(d):
            two = np.linalg.norm(b[d, j] + b[d, k], axis=1)
            both = (dot(d, i, j) + dot(d, i, k)) / np.maximum(two * na[d, i], 1e-6)
            ok = both > like(d, i, j) + 0.02
            out.append(np.stack((d[ok], i[ok], k[ok]), axis=1))
    return np.unique(np.concatenate(out), axis=0)


PAIRS = "chapter_id long, raw_no int, translated_no int"


def _aligner(shared, model: _Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vs, vt = shared.value
        schema = pa.schema([("chapter_id", pa.int64()), ("raw_no", pa.int32()), ("translated_no", pa.int32())])
        for batch in batches:
            c = [batch.column(i).to_pylist() for i in range(9)]
            for lo in range(0, len(c[0]), 2000):
                part = slice(lo, lo + 2000)
                src, tgt = _Side(c[2][part], c[3][part], c[4][part]), _Side(c[5][part], c[6][part], c[7][part])
                p = _pairs(src, tgt, vs, vt, np.array(c[1][part]), model)
                cut = np.array(c[8][part], bool)
                p = p[~(cut[p[:, 0]] & (p[:, 2] == tgt.n[p[:, 0]] - 1))]
                ids = np.array(c[0][part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[p[:, 0]]), pa.array(p[:, 1].astype(np.int32)), pa.array(p[:, 2].astype(np.int32))], schema=schema)

    return run


def aligned(chapters: DataFrame, without: DataFrame | None = None, cut: DataFrame | None = None) -> DataFrame:
    """(chapter_id, raw_no, translated_no): all pairs.

    ``without``: chapter_id of documents that have none; ``cut``: chapter_id of those whose last translated sentence was cut
    off and translates nothing. Both are joined to the documents' tokens, not to the pairs."""
    both = chapters.select(F.col("id").cast("long").alias("chapter_id"), "raw_text", "translated_text").where("chapter_id is not null and raw_text is not null and translated_text is not null")
    tokens = written(both.mapInArrow(_tokenised, TOKENS), "sentences")
    model = length_model(tokens)
    shared = chapters.sparkSession.sparkContext.broadcast(lexicon(tokens, model))  # 16 MB, whatever the data
    once = tokens.repartition("chapter_id").dropDuplicates(["chapter_id"])  # shuffled as they are: sorted once, behind the shuffle
    if without is not None:
        once = once.join(without.select("chapter_id"), "chapter_id", "left_anti")
    if cut is not None:
        once = once.join(cut.select("chapter_id", F.lit(True).alias("cut")).distinct(), "chapter_id", "left")
    else:
        once = once.withColumn("cut", F.lit(False))
    return once.withColumn("cut", F.coalesce("cut", F.lit(False))).mapInArrow(_aligner(shared, model), PAIRS)


def found(chapters: DataFrame, residue: DataFrame, cut: DataFrame) -> DataFrame:
    """(chapter_id, raw_no, translated_no): the pairs, without those of residue and those with a sentence that was cut off."""
    return aligned(chapters, residue, cut)
