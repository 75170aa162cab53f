"""Mixing sources to target weights.

Method: the documents of each source are packed, in pseudorandom order, into a stream of tokens that is cut into blocks
of BLOCK tokens. The mix has as many slots as its size takes blocks; slots come in shards, and each shard draws from the
multinomial distribution how many of its slots each source gets (seeded by mix and shard). The slots of a source run
through its blocks by a pseudorandom permutation of their indexes, again and again if there are more slots than blocks:
full passes meet every block, and the slots of the last pass are mapped to indexes and joined to the blocks by them. A
document is repeated as often as slots meet the block in which it begins.

A draw has its noise, and documents are not cut at blocks, so each source is then settled: documents at the end of the
permutation are taken back, or further ones that fit are added, until its tokens are those granted to it, to less than a
document.

A source gets ``target_share`` (its weight over the mix's weights) of the wanted size, which is ``total_factor`` times
the tokens of all documents, but no document more often than ``max_repeats``. What a source cannot give is not filled up
from others, since they would then exceed their shares; the report tells both the share of the wanted size and of the mix.

Positions are prefix sums, computed in buckets of bounded size: no task holds a whole source.

Cases: null and empty texts have no tokens and are in no mix; sources without documents get nothing; weights and repeats that are null
or not positive give nothing; rows of one mix and source that occur twice count as one, with the sum of the weights and
the larger cap; repeated texts under other ids are documents of their own; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookflow.llm import encoding
from bookflow.session import written

BLOCK, SHARD = 256, 4096
#: Rounds in which what is left of a source's tokens is filled with further documents that fit.
FILLS = 3
#: Documents in one bucket of a prefix sum, about.
BUCKET_ROWS = 50_000
#: Multipliers of the permutations: primes, of which the first that does not divide a source's number of blocks is taken.
PRIMES = (611_953, 611_957, 611_969, 611_977, 611_993, 611_999, 612_011, 612_023)


def sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents with tokens, written to the shared folder."""
    return written(encoding.counted(documents.where("doc_id is not null"), keep=("doc_id", "source")).where("n_tokens > 0"), "sizes")


def prefix(df: DataFrame, group: list[str], bucket: Column, order: list, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows of the group before each row; rows are ordered by bucket, then by ``order``."""
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy(*group, "_bucket").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")
    w = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_own", F.coalesce(F.sum(value).over(w), F.lit(0))).join(before, [*group, "_bucket"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_bucket", "_own", "_before")


def demands(size: DataFrame, targets: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and source: what is wanted, what there is, and what is granted, in tokens. As small as ``targets``."""
    clean = targets.where("mix_name is not null and source is not null and target_share > 0").groupBy("mix_name", "source").agg(F.sum("target_share").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    factor = plan.where("mix_name is not null and total_factor > 0").groupBy("mix_name").agg(F.max("total_factor").alias("total_factor"))
    have = size.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("n_docs"))
    all_tokens = size.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens")).first()["all_tokens"]
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("mix_name"))
    repeats = F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))
    return written(
        clean.join(factor, "mix_name")
        .withColumn("target_share", share)
        .join(have, "source", "left")
        .select("mix_name", "source", "target_share", repeats.alias("max_repeats"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), (F.col("total_factor") * F.lit(all_tokens)).alias("mix_tokens"))
        .withColumn("wanted", F.col("target_share") * F.col("mix_tokens"))
        .withColumn("granted", F.least(F.col("wanted"), (F.col("max_repeats") * F.col("available")).cast("double"))),
        "demands",
    )


def _draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of each source in each shard: one multinomial draw."""
    for batch in batches:
        mix, shard, slots, sources, shares = (c.to_pylist() for c in batch.columns)
        rows: list[tuple[str, str, int]] = []
        for m, s, n, names, p in zip(mix, shard, slots, sources, shares):
            p = np.array(p)
            rows += [(m, x, int(k)) for x, k in zip(names, np.random.default_rng([s, *m.encode()]).multinomial(n, p / p.sum()))]
        if rows:
            a, b, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c, pa.int64())], names=["mix_name", "source", "slots"])


def slots(demand: DataFrame) -> DataFrame:
    """(mix_name, source, slots): the multinomial draws of all shards, added up."""
    spread = demand.where("granted > 0").groupBy("mix_name").agg(F.sort_array(F.collect_list(F.struct("source", "granted"))).alias("x"), F.sum("granted").alias("total"))  # a list per mix, as long as its rows in the targets
    n = F.ceil(F.col("total") / BLOCK).cast("long")
    shards = spread.select("mix_name", "x", "total", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / SHARD).cast("long"))).alias("shard"))
    each = shards.select("mix_name", "shard", F.least(F.lit(SHARD).cast("long"), F.col("n") - F.col("shard") * SHARD).alias("slots"), F.col("x.source").alias("sources"), F.transform("x", lambda y: y["granted"] / F.col("total")).alias("shares"))
    return each.repartition("mix_name", "shard").mapInArrow(_draws, "mix_name string, source string, slots long").groupBy("mix_name", "source").agg(F.sum("slots").alias("slots"))


def mixed(documents: DataFrame, targets: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents of each mix with their repeats, the demands)."""
    size = sizes(documents)
    demand = demands(size, targets, plan)
    # pack: the position of each document in its source's stream of tokens
    h = F.xxhash64("doc_id", F.lit("pack"))
    counts = size.groupBy("source").agg(F.count("*").alias("_n"), F.sum("n_tokens").alias("_tokens"))
    packed = prefix(size.join(counts, "source").withColumn("_h", h), ["source"], F.pmod(F.col("_h"), F.floor(F.col("_n") / BUCKET_ROWS) + 1), ["_h", "doc_id"], "n_tokens", "at")
    packed = written(packed.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long")).drop("at", "_h"), "packed")
    # slots: full passes, and those of the last one, one row each, mapped to the index of a block
    blocks = counts.select("source", F.ceil(F.col("_tokens") / BLOCK).cast("long").alias("blocks"))
    exact = F.col("granted") / F.col("available") * F.col("blocks")
    # a source of few blocks is held within a pass of what it is granted, however the draw fell
    drawn = F.least(F.greatest(F.col("slots"), F.ceil(exact) - F.col("blocks")), F.floor(exact) + F.col("blocks")).cast("long")
    wanted = demand.join(slots(demand), ["mix_name", "source"]).join(blocks, "source").withColumn("drawn", F.greatest(drawn, F.lit(0)))
    wanted = written(wanted.select("mix_name", "source", "max_repeats", "granted", "blocks", F.floor(F.col("drawn") / F.col("blocks")).alias("times"), F.pmod("drawn", "blocks").alias("rest")), "slots")
    # the permutation of a mix's last pass over a source; documents stand in their blocks in pseudorandom order already
    shift = F.pmod(F.xxhash64("source", "mix_name", "times"), F.col("blocks"))
    starts = wanted.where("rest > 0").select("mix_name", "source", "blocks", "times", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rest") - 1) / SHARD).cast("long"))).alias("shard"))
    turns = starts.repartition("mix_name", "source", "shard").select("mix_name", "source", "blocks", "times", F.explode(F.sequence(F.col("shard") * SHARD, F.least((F.col("shard") + 1) * SHARD, F.col("rest")) - 1)).alias("turn"))
    met = turns.select("mix_name", "source", _block_of(F.col("turn"), F.col("blocks"), shift).alias("block"), F.lit(1).alias("extra"))
    every = packed.join(F.broadcast(wanted.drop("rest")), "source").withColumn("turn", F.pmod(F.col("block") * _prime(F.col("blocks")) + shift, F.col("blocks")))  # a row per row of the targets
    out = written(every.join(met, ["mix_name", "source", "block"], "left").withColumn("extra", F.coalesce("extra", F.lit(0))).drop("block", "blocks"), "mix")
    repeats = F.least(F.col("times") + F.col("extra"), F.col("max_repeats")).cast("int")
    keys = ["mix_name", "source"]

    def left_of(mix: DataFrame) -> DataFrame:
        """What each source lacks of its tokens, or has beyond them: a row per row of the targets."""
        return F.broadcast(mix.groupBy(*keys).agg((F.max("granted") - F.sum(F.col("n_tokens") * repeats)).alias("left")))

    # taken back: from the end of the permutation, those of the last pass first
    over = out.join(left_of(out), keys).where((F.col("left") < 0) & (repeats > 0))
    over = over.withColumn("_back", (F.col("extra") == 0).cast("int")).withColumn("_part", F.floor(-F.col("turn") * (F.floor(F.col("_n") / BUCKET_ROWS) + 1) / F.ceil(F.col("_tokens") / BLOCK)))
    run = prefix(over, keys, F.struct("_back", "_part"), ["_back", F.desc("turn"), "doc_id"], "n_tokens", "run")
    back = run.where(F.col("run") < -F.col("left")).select("mix_name", "doc_id", F.lit(1).alias("back"))
    # capped repeats stand above the cap by what the last pass adds; they fall from the cap
    out = written(out.join(back, ["mix_name", "doc_id"], "left").withColumn("extra", F.when(F.col("back").isNull(), F.col("extra")).otherwise(repeats - F.col("times") - 1)).drop("back"), "mix")
    for _ in range(FILLS):
        fits = out.join(left_of(out), keys).where((F.col("n_tokens") <= F.col("left")) & (repeats < F.col("max_repeats")))
        fits = fits.withColumn("_h", F.xxhash64("doc_id", F.lit("fill")))
        run = prefix(fits, keys, F.struct("extra", F.pmod(F.col("_h"), F.floor(F.col("_n") / BUCKET_ROWS) + 1).alias("part")), ["_h", "doc_id"], "n_tokens", "run")  # those repeated least come first
        fill = run.where(F.col("run") + F.col("n_tokens") <= F.col("left")).select("mix_name", "doc_id", F.lit(1).alias("fill"))
        out = written(out.join(fill, ["mix_name", "doc_id"], "left").withColumn("extra", F.col("extra") + F.coalesce("fill", F.lit(0))).drop("fill"), "mix")
    return out.withColumn("repeats", repeats).where("repeats > 0").select("mix_name", "doc_id", "source", "n_tokens", "repeats"), demand


def _prime(blocks: Column) -> Column:
    """A multiplier without a common divisor with the number of blocks: the first of PRIMES that doesn't divide it."""
    out = F.lit(PRIMES[-1]).cast("long")
    for p in reversed(PRIMES[:-1]):
        out = F.when(blocks % p != 0, F.lit(p).cast("long")).otherwise(out)
    return out


def _block_of(turn: Column, blocks: Column, shift: Column) -> Column:
    """The block whose turn it is: the inverse of ``pmod(block * prime + shift, blocks)``, by the extended Euclidean algorithm in a fold."""
    start = F.struct(F.pmod(_prime(blocks), blocks).alias("r"), blocks.alias("q"), F.lit(1).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))

    def step(acc: Column, _: Column) -> Column:
        d = F.floor(acc["q"] / F.greatest(acc["r"], F.lit(1).cast("long"))).cast("long")
        return F.when(acc["r"] <= 1, acc).otherwise(F.struct((acc["q"] - d * acc["r"]).alias("r"), acc["r"].alias("q"), (acc["y"] - d * acc["x"]).alias("x"), acc["x"].alias("y")))

    # 64 bits take no more than 93 divisions
    inverse = F.pmod(F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step)["x"], blocks)
    return F.pmod(F.pmod(turn - shift, blocks) * inverse, blocks)


def report(documents: DataFrame, targets: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and source: target share, tokens wanted, available and mixed, share of the wanted size and of the mix."""
    mix, demand = mixed(documents, targets, plan)
    got = mix.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.count("*").alias("n_documents"), F.max("repeats").alias("most_repeats"))
    every = demand.join(got, ["mix_name", "source"], "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    total = F.sum("mixed_tokens").over(Window.partitionBy("mix_name"))
    return every.select(
        "mix_name",
        "source",
        "target_share",
        "max_repeats",
        F.col("wanted").alias("wanted_tokens"),
        F.col("available").alias("available_tokens"),
        "mixed_tokens",
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.try_divide("mixed_tokens", "mix_tokens").alias("share_of_wanted"),
        F.try_divide("mixed_tokens", total).alias("actual_share"),
    )
