"""Encoding of texts with a public byte-level BPE vocabulary, all in Spark expressions.

Method: texts are split by the vocabulary's pattern, and the words are made distinct and counted. Higher-order functions
fold the ranked merges over the bytes of each distinct word: each step joins the pair of lowest rank, the leftmost first,
until no pair has a rank; a word that is a token as it stands has its id. The rank map is a literal: an array of small
maps, by hash of the token, so that one look-up compares a few keys. Bytes are written as characters U+0000 to U+00FF,
since keys of such maps are strings. Decoding concatenates the tokens' binary pieces.

The ids of the vocabulary's own tokens and of the FREQUENT most frequent other words are a literal of the same kind, so
that a document finds nearly all of its words where it is read. Only the others, none of which makes up more than one in
FREQUENT words, are joined to the distinct words by shuffle, and only documents that have such words move.

Cases: null and empty texts have an empty list of ids; every row of the input gets a row; strings that look like special
tokens are ordinary text; texts and pieces of any length are encoded whole; repeated texts are encoded like any other.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.session import written

#: Where the vocabulary files are; a parameter, never copied.
FOLDER = os.environ.get("BOOKFLOW_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pattern of the vocabulary (a fixed value); (?U) lets white space be that of Unicode.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 16_384
NONE = 2**31 - 1
#: Words besides the vocabulary's tokens whose ids every task knows.
FREQUENT = 32_768


def _bucket(token: Column) -> Column:
    return (F.crc32(token) % BUCKETS + 1).cast("int")


def _maps(items: Iterable[tuple[str, object]], value: str) -> Column:
    """A literal array of small maps, by hash of the key; folded to one literal by the optimizer."""
    maps: list[dict[str, object]] = [{} for _ in range(BUCKETS)]
    for k, v in items:
        maps[zlib.crc32(k.encode()) % BUCKETS][k] = v
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), f"array<map<string,{value}>>")


class Vocabulary:
    """Ranks by token, as Spark literals. Its size is that of the vocabulary file, whatever the data."""

    def __init__(self, path: str | None = None):
        with open(path or os.path.join(FOLDER, VOCABULARY), "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.tokens = {base64.b64decode(a): int(b) for a, b in pairs}
        self.table = _maps(((t.decode("latin-1"), r) for t, r in self.tokens.items()), "int")
        pieces = [""] * (max(self.tokens.values()) + 1)
        for a, b in pairs:
            pieces[int(b)] = a.decode()
        self.pieces = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<binary>")

    def bound(self, body) -> Column:
        """``body(rank)`` with the table bound once, however often ``rank`` (of a token; null if it has none) is used."""
        return _let(self.table, lambda table: body(lambda token: F.element_at(F.element_at(table, _bucket(token)), token)))

    def words(self) -> dict[str, list[int]]:
        """The tokens that are texts, with their ids."""
        out = {}
        for t, r in self.tokens.items():
            try:
                out[t.decode()] = [r]
            except UnicodeDecodeError:
                continue
        return out


def as_bytes(text: Column) -> Column:
    """The text's bytes in UTF-8, each as the character of its number."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merged(piece: Column, rank) -> Column:
    """Ids of one piece (as bytes): ranked merges, folded. ``rank`` gives the rank of a token."""
    pair = lambda a, b: F.coalesce(rank(F.concat(a, b)), F.lit(NONE))
    parts = F.transform(F.sequence(F.lit(1), F.length(piece)), lambda i: F.substring(piece, i, F.lit(1)))

    def start(p: Column) -> Column:
        ranks = F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: pair(F.element_at(p, i), F.element_at(p, i + 1)))).otherwise(F.array().cast("array<int>"))
        return F.struct(p.alias("p"), ranks.alias("r"))

    def join(acc: Column, k: Column) -> Column:
        """Parts k and k + 1 become one; only the ranks beside it change."""
        p, r = acc["p"], acc["r"]

        def with_token(token: Column) -> Column:
            none = F.array().cast("array<int>")
            before = F.when(k > 1, F.array(pair(F.element_at(p, F.greatest(k - 1, F.lit(1))), token))).otherwise(none)
            after = F.when(k < F.size(r), F.array(pair(token, F.element_at(p, F.least(k + 2, F.size(p)))))).otherwise(none)
            return F.struct(
                F.concat(F.slice(p, F.lit(1), k - 1), F.array(token), F.slice(p, k + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))), before, after, F.slice(r, k + 2, F.size(p))).alias("r"),
            )

        return _let(F.concat(F.element_at(p, k), F.element_at(p, k + 1)), with_token)

    def step(acc: Column, _: Column) -> Column:
        return _let(F.coalesce(F.array_min(acc["r"]), F.lit(NONE)), lambda low: F.when(low == NONE, acc).otherwise(_let(F.array_position(acc["r"], low).cast("int"), lambda k: join(acc, k))))

    folded = _let(parts, lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p)), start(p), step))
    return F.transform(folded["p"], rank)


def _split(documents: DataFrame, text: str, *columns: str) -> DataFrame:
    return documents.select(*columns, F.coalesce(F.when(F.col(text) != "", pieces(F.col(text))), F.array().cast("array<string>")).alias("words"))


def distinct_words(documents: DataFrame, text: str, vocabulary: Vocabulary) -> DataFrame:
    """(word, n, ids): all words of all texts, each once; written to the shared folder."""
    counts = _split(documents, text).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    spread = counts.repartition(4 * documents.sparkSession.sparkContext.defaultParallelism, "word")  # few bytes, but long to merge
    ids = vocabulary.bound(lambda rank: _let(as_bytes(F.col("word")), lambda piece: F.when(rank(piece).isNotNull(), F.array(rank(piece))).otherwise(merged(piece, rank))))
    return written(spread.select("word", "n", ids.alias("ids")), "words")


def _known(distinct: DataFrame, vocabulary: Vocabulary, counts: bool) -> Column:
    """The literal of the tokens and the FREQUENT most frequent other words: their ids, or only how many they are."""
    own = vocabulary.words()
    rows = distinct.where(F.size("ids") > 1).orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", F.size("ids").alias("ids") if counts else F.col("ids")).collect()
    if counts:
        return _maps([*((w, 1) for w in own), *((r["word"], r["ids"]) for r in rows)], "int")
    return _maps([*own.items(), *((r["word"], r["ids"]) for r in rows)], "array<int>")


def _looked_up(documents: DataFrame, text: str, table: Column, *columns: str) -> DataFrame:
    """(columns, row, parts, rest): what each word has in the table, null if it has nothing, and the words without; written to the shared folder."""
    parts = _let(table, lambda t: F.transform("words", lambda w: F.element_at(F.element_at(t, _bucket(w)), w)))
    found = _split(documents, text, *columns).select(*columns, "words", parts.alias("parts"))
    open_ = F.filter(F.transform(F.arrays_zip("words", "parts"), lambda x, i: F.struct(i.alias("at"), F.when(x["parts"].isNull(), x["words"]).alias("word"))), lambda x: x["word"].isNotNull())
    rest = F.when(F.exists("parts", lambda p: p.isNull()), open_)
    return written(found.select(*columns, F.monotonically_increasing_id().alias("row"), "parts", rest.alias("rest")), "looked-up")  # the row's number is fixed by writing


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: Vocabulary | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns to keep, ids) of every row: the ids of its text. Rows of one key, or without one, stay apart."""
    vocabulary = vocabulary or Vocabulary()
    distinct = distinct_words(documents, text, vocabulary)
    rows = _looked_up(documents, text, _known(distinct, vocabulary, False), key, *keep)
    whole = rows.where("rest is null").select(key, *keep, F.flatten("parts").alias("ids"))
    broken = rows.where("rest is not null")
    joined = broken.select("row", F.explode("rest").alias("x")).select("row", "x.at", "x.word").join(distinct.select("word", "ids"), "word")
    found = joined.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("found"))
    # both lists by place: what was looked up has no hole where the other has a word
    known = F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("at"), p.alias("ids"))), lambda x: x["ids"].isNotNull())
    filled = F.transform(F.array_sort(F.concat(known, "found")), lambda x: x["ids"])
    mended = broken.select(key, *keep, "row", "parts").join(found, "row").select(key, *keep, F.flatten(filled).alias("ids"))
    return whole.unionByName(mended)


def counted(documents: DataFrame, text: str = "text", vocabulary: Vocabulary | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(columns to keep, n_tokens) of every row: how many ids its text has, without making them."""
    vocabulary = vocabulary or Vocabulary()
    distinct = distinct_words(documents, text, vocabulary)
    rows = _looked_up(documents, text, _known(distinct, vocabulary, True), *keep)
    own = rows.select(*keep, "row", F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + F.coalesce(p, F.lit(0))).alias("own"))
    rest = rows.where("rest is not null").select("row", F.explode("rest.word").alias("word")).join(distinct.select("word", F.size("ids").alias("n")), "word")
    more = rest.groupBy("row").agg(F.sum("n").alias("more"))
    return own.join(more, "row", "left").select(*keep, (F.col("own") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


#: Pieces concatenated at once: each step copies what came before, so long texts are put together in two levels.
CHUNK = 256


def decoded(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of a list of ids: its tokens' binary pieces, one after the other."""
    empty = F.lit(bytearray()).cast("binary")
    joined = lambda a: F.aggregate(a, empty, lambda acc, x: F.concat(acc, x))
    chunks = F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    binary = _let(vocabulary.pieces, lambda pieces: joined(F.transform(chunks, lambda c: joined(F.transform(F.slice(ids, c * CHUNK + 1, CHUNK), lambda i: F.element_at(pieces, i + 1))))))
    return F.decode(binary, "UTF-8")


def round_trip(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, same): whether decoding the ids gives the text back."""
    vocabulary = Vocabulary()
    return encoded(documents, key, text, vocabulary, (text,)).select(key, F.size("ids").alias("n_tokens"), (decoded(F.col("ids"), vocabulary) == F.coalesce(F.col(text), F.lit(""))).alias("same"))
