"""Template residue, filler, error pages and script notices among chapters.

Method: trusted rules label lines; every line of every chapter gets the set of its five-word shingles; lines whose sets
have a Jaccard similarity of 0.8 or more with those of labelled ones take the label over, and so on through the connected
component. The search is exact: two such sets always share one of their first shingles in the order of the hashes (the
prefix), so lines are joined by the shingles of their prefixes and then compared. A chapter is residue if it has a slot
or template code anywhere, or labelled lines beside no more than a short opening.

Only components that hold a labelled line can change anything, so the search starts at the labelled lines and follows
links until no new line is reached: the labels are those of the full components, and unlabelled components are never built.

Cases: null, empty and blank texts are never residue; repeated rows of an id count once; texts of any length are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookflow.llm import kernel as K
from bookflow.llm import residue_rules as R
from bookflow.session import written

SHINGLE = 5
#: Least Jaccard similarity of a link, as a fraction: sets of n shingles that have it share n - n // 5 at least.
ALIKE, OF = 4, 5
#: Bits of the filter of prefix shingles that is sent to all tasks: a fixed 1 MB.
FILTER_BITS = 1 << 23
#: Words beside the residue that a page may have: two or three sentences of opening and the site's own lines.
MAX_OTHER_WORDS = 80

LINES = "chapter_id long, line_no int, key long, n_words int, n_shingles int, trusted boolean, seed boolean, slot boolean, shingles binary, codes array<int>"


#: Classes of words by which lines are chosen that the rules must try.
ONLY, FILLER, SHORT, ANY = (1 << i for i in range(4))


@cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words that the rules know, in order, the classes of each, and a table of their lowest bits."""
    of: dict[str, int] = {}
    for words, c in ((R.TECHNICAL_ONLY, ONLY), (R.FILLERS, FILLER), (R.SHORT, SHORT), (R.ANY | R.MARKED, ANY)):
        for w in words:
            of[w] = of.get(w, 0) | c
    words = list(of)
    cp, starts = K.codepoints(words)
    hashes = K.run_hashes(cp, starts[:-1], starts[1:] - 1)
    order = np.argsort(hashes)
    table = np.zeros(1 << 16, bool)
    table[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
    return hashes[order], np.array([of[words[i]] for i in order], np.uint8), table


def _to_try(words: np.ndarray, sizes: np.ndarray, first: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Which lines the rules must try: more than they name, never fewer."""
    hashes, classes, table = _classes()
    at = np.flatnonzero(table[(words & np.uint64(0xFFFF)).astype(np.int64)])
    place = np.minimum(np.searchsorted(hashes, words[at]), len(hashes) - 1)
    of = np.zeros(len(words), np.uint8)
    of[at] = np.where(hashes[place] == words[at], classes[place], 0)
    count = lambda c: np.add.reduceat((of & c) != 0, first, dtype=np.int32)
    number = np.add.reduceat(words == 0, first, dtype=np.int32)
    counted = np.add.reduceat((words != 0) & (sizes > 1), first, dtype=np.int32)  # a word of the rules may be several here, where an underscore joins them
    technical = (count(ONLY) > 0) & (counted <= 3 * R.MOST_WORDS)
    short = ((count(SHORT) > 0) & (n_words <= R.WORDS_OF_SHORT)) | ((number > 0) & (n_words <= 3))
    return technical | short | (count(ANY) > 0) | (count(FILLER) + number == n_words)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("chapter_id", pa.int64()), ("line_no", pa.int32()), ("key", pa.int64()), ("n_words", pa.int32()), ("n_shingles", pa.int32()), ("trusted", pa.bool_()), ("seed", pa.bool_()), ("slot", pa.bool_()), ("shingles", pa.binary()), ("codes", pa.list_(pa.int32()))])
    for batch in batches:
        for ids, texts in K.slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield from _lines_of(ids, texts, schema)


def _lines_of(ids: list, texts: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    texts = [R.visible(t) for t in texts]  # words stand apart by what is seen
    joined = "\n".join(texts)
    hints = [h for h in R.SLOT_HINTS if h in joined]
    with_slot = [R.has_slot(t, hints) for t in texts]
    slots = [i for i, s in zip(ids, with_slot) if s]
    if slots:  # a row of its own, since such a text may hold no word
        n = len(slots)
        no, zero = pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(np.full(n, -1, np.int32)), pa.nulls(n, pa.int64()), zero, zero, no, no, pa.array(np.ones(n, bool)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int32()))], schema=schema)
    cp, starts = K.codepoints(texts)
    k, t = np.minimum(cp, K.TOP), K.classes()
    flags = t["flags"].take(k)
    ws, we = K.runs((flags & (K.LETTER | K.DIGIT | K.MARK)) != 0, (flags & K.IDEOGRAPH) != 0)
    low = t["lower"].take(k)
    words = K.run_hashes(low, ws, we)
    words[np.searchsorted(ws, np.flatnonzero(flags & K.DIGIT), side="right") - 1] = 0  # a number, or a code of digits and letters: one word for all of them
    breaks = np.concatenate(([0], np.cumsum(cp == 10)))  # lines before each position, over the whole chunk
    line = breaks[ws]
    if not len(ws):
        return
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    last = np.append(first[1:], len(ws))
    n_words = last - first
    tried = first[_to_try(words, we - ws, first, n_words)]
    by_text: dict[int, list[int]] = {}
    for i, j in zip((np.searchsorted(starts, ws[tried], side="right") - 1).tolist(), line[tried].tolist()):
        by_text.setdefault(i, []).append(j - int(breaks[starts[i]]))
    labelled = [(i, j, kind) for i, text in enumerate(texts) for j, kind in R.residue_lines(text, by_text.get(i, ()), with_slot[i])]
    key = K.run_hashes(words, first, last, 11)

    # shingles: position i starts one if four more words of its line follow
    place = np.arange(len(ws))
    end_of = np.repeat(last, n_words)
    full = place + SHINGLE <= end_of
    at = np.flatnonzero(full)
    with np.errstate(over="ignore"):
        above = words + np.uint64(1)
        sh = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
        for j, m in enumerate(K.multipliers(SHINGLE, 13)):
            sh += above[j : j + len(sh)] * m
        sh = K.mix(sh.take(at))
    # the set of each line: its different shingles, of 32 bits, in ascending order
    of_line = np.repeat(np.arange(len(first), dtype=np.uint64), np.maximum(n_words - SHINGLE + 1, 0))
    both = np.sort(of_line << np.uint64(32) | sh & np.uint64(0xFFFFFFFF))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    of_line = (both >> np.uint64(32)).astype(np.int64)
    packed = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    n_sh = np.bincount(of_line, minlength=len(first))
    ends = np.concatenate(([0], np.cumsum(n_sh)))
    n_codes = np.where(n_sh > 0, n_sh * (OF - ALIKE) // OF + 1, 0)
    prefix = packed[np.arange(len(packed)) - ends[of_line] < n_codes[of_line]]

    doc = np.searchsorted(starts, ws[first], side="right") - 1
    number = line[first] - breaks[starts[doc]]
    trusted, seeds = np.zeros(len(first), bool), np.zeros(len(first), bool)
    if labelled:
        i, j, kind = np.array(labelled, np.int64).T
        ids_of = doc << 32 | number  # ascending
        place = np.minimum(np.searchsorted(ids_of, i << 32 | j), len(ids_of) - 1)
        ok = ids_of[place] == i << 32 | j  # (a line without words has no row)
        trusted[place[ok]] = True
        seeds[place[ok & (kind == R.WORDING)]] = True
    lists = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])
    codes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_codes))).astype(np.int32)), pa.array(prefix.view(np.int32)))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.asarray(ids, np.int64)[doc]),
            pa.array(number.astype(np.int32)),
            pa.array(key.view(np.int64)),
            pa.array(n_words.astype(np.int32)),
            pa.array(n_sh.astype(np.int32)),
            pa.array(trusted),
            pa.array(seeds),
            pa.array(np.zeros(len(doc), bool)),
            lists,
            codes,
        ],
        schema=schema,
    )


def line_table(chapters: DataFrame, key: str = "id", text: str = "raw_text") -> DataFrame:
    """One row per line that has words, with its key, shingles, prefix and trusted label, and one, numbered -1, per text with a slot; written to the shared folder."""
    narrow = chapters.select(F.col(key).cast("long").alias("chapter_id"), F.col(text).alias("text")).where("chapter_id is not null and text is not null")
    return written(narrow.mapInArrow(_lines, LINES), "residue-lines")


def _filter(frontier: DataFrame) -> Callable[[Column], Column]:
    """A test of a prefix shingle against a fixed-size bitmap of the frontier's."""
    slot = F.pmod(F.col("code"), F.lit(FILTER_BITS))
    rows = (
        frontier.select(F.explode("codes").alias("code"))
        .groupBy(F.shiftright(slot, 6).cast("int").alias("at"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("bits"))
        .collect()  # at most FILTER_BITS / 64 rows, whatever the size of the data
    )
    words = [0] * (FILTER_BITS // 64)
    for r in rows:
        words[r["at"]] = r["bits"]
    table = F.from_json(F.lit(json.dumps(words, separators=(",", ":"))), "array<bigint>")  # folded to one literal by the optimizer
    return lambda code: F.getbit(F.element_at(table, (F.shiftright(F.pmod(code, F.lit(FILTER_BITS)), 6) + 1).cast("int")), F.pmod(code, F.lit(64)).cast("int")) == 1


def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two sets of shingles have a Jaccard similarity of ALIKE / OF or more."""
    sets = ((set(np.frombuffer(x, np.uint32).tolist()), set(np.frombuffer(y, np.uint32).tolist())) for x, y in zip(a, b))
    return pd.Series([OF * len(x & y) >= ALIKE * len(x | y) for x, y in sets], dtype=bool)


def propagated(lines: DataFrame) -> DataFrame:
    """Keys of lines that a chain of near-duplicates joins to a trusted line, the trusted ones included."""
    # (a seed is trusted, and lines of one key have the same shingles: the other lines need not be grouped)
    known = written(lines.where("trusted").groupBy("key").agg(F.max("seed").alias("seed"), F.max("n_shingles").alias("n_shingles"), F.first("codes").alias("codes")), "residue-keys")
    found = [known.select("key")]
    frontier = known.where(F.col("seed") & (F.col("n_shingles") > 0)).select("key", "n_shingles", "codes")
    index = lines.where(F.col("n_shingles") > 0)
    sizes = (F.col("n_shingles") * OF >= F.col("from_shingles") * ALIKE) & (F.col("from_shingles") * OF >= F.col("n_shingles") * ALIKE)
    while frontier.limit(1).count():
        passes = _filter(frontier)
        near = (
            index.select("key", "n_shingles", F.filter("codes", passes).alias("codes"))
            .where(F.size("codes") > 0)
            .groupBy("key")
            .agg(F.first("n_shingles").alias("n_shingles"), F.first("codes").alias("codes"))
            .select("key", "n_shingles", F.explode("codes").alias("code"))
        )
        start = frontier.select(F.col("key").alias("from_key"), F.col("n_shingles").alias("from_shingles"), F.explode("codes").alias("code"))
        pairs = near.join(start, "code").where((F.col("key") != F.col("from_key")) & sizes).select("key", "from_key").distinct()
        for f in found:
            pairs = pairs.join(f, "key", "left_anti")
        pairs = written(pairs, "residue-pairs")
        if not pairs.limit(1).count():
            break
        linked = (
            pairs.join(index.join(pairs.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"), F.first("codes").alias("codes"), F.first("n_shingles").alias("n_shingles")), "key")
            .join(index.select(F.col("key").alias("from_key"), "shingles").join(pairs.select("from_key").distinct(), "from_key", "left_semi").groupBy("from_key").agg(F.first("shingles").alias("from_shingles")), "from_key")
            .where(F.pandas_udf(_alike, T.BooleanType())("shingles", "from_shingles"))
        )
        frontier = written(linked.groupBy("key").agg(F.first("codes").alias("codes"), F.first("n_shingles").alias("n_shingles")), "residue-frontier")
        found.append(frontier.select("key"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def residue_chapters(chapters: DataFrame, key: str = "id", text: str = "raw_text", max_other_words: int = MAX_OTHER_WORDS) -> DataFrame:
    """(chapter_id, has_slot, residue_words, other_words) of the chapters that are residue."""
    lines = line_table(chapters, key, text)
    labelled = propagated(lines).withColumn("residue", F.lit(True))
    marked = lines.select("chapter_id", "line_no", "key", "n_words", "slot").join(labelled, "key", "left").select("chapter_id", "line_no", "n_words", "slot", "residue").repartition("chapter_id")  # one shuffle for both groupings
    per_line = marked.groupBy("chapter_id", "line_no").agg(F.max("n_words").alias("n_words"), F.max("slot").alias("slot"), F.max("residue").alias("residue"))
    return (
        per_line.groupBy("chapter_id")
        .agg(
            F.max("slot").alias("has_slot"),
            F.sum(F.when(F.col("residue"), F.col("n_words")).otherwise(0)).alias("residue_words"),
            F.sum(F.when(F.col("residue"), 0).otherwise(F.col("n_words"))).alias("other_words"),
        )
        .where(F.col("has_slot") | ((F.col("residue_words") > 0) & (F.col("other_words") <= max_other_words)))
    )
