"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. ``plan``: one row per source with weight, words, target and a quota of blocks. Targets share the words of the mix by
   weight; one that reaches ``most`` times its source's words stops there and the others share the rest.
2. ``lines``: the documents of a source stand in hashed order in one long line of words, cut into blocks of equal
   length. Places in the line are running sums over ranges of the hash that hold few documents, so a source of any size is spread out.
3. ``draws``: the quotas are the colours of an urn. A node of the tree gives its left half of output shards as many
   blocks as these shards hold, drawn from the multivariate hypergeometric law; at the leaves each shard
   has an exact number of blocks of each source, and the numbers of a source add up to its quota. The
   ``j``-th draw of a source takes the ``j``-th block of a keyed permutation, pass by pass, so shards hold disjoint
   blocks and no block comes twice in a pass. A shard orders its blocks by a hash.

Everything follows from the seed and the rows, so runs agree. Blocks grow with the mix so that there are at
most ``MOST_BLOCKS`` of them (the limit of the sampler); a source has at least ``LEAST_BLOCKS`` where it has that
many words. A source's words in the mix differ from its target by less than one and a half of its blocks.
The plan and each node hold one small row per source.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import materialise

from .rows import numbered, partitions

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, LEAST_BLOCKS, MOST_BLOCKS = 256, 256, 500_000_000
SHARD_WORDS = 1 << 22
BUCKET_DOCS = 20_000
FAN = 64  # shards or groups of shards that one step makes of a node
INLINE_SOURCES = 100_000  # sources up to which the plan is broadcast: rows of about 100 bytes
STEP = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(plan: DataFrame, words: float, most: float) -> float:
    """Target per weight of the sources that do not stop at ``most`` times their size; scalars only, one small job a round."""
    stop = F.col("source_size") * F.lit(float(most))
    level, stopped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > stop
        r = plan.agg(F.sum(F.when(over, stop)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("w"), F.count_if(over).alias("n")).first()
        if r["n"] == stopped or not r["w"]:
            return level
        stopped, level = r["n"], (words - (r["full"] or 0.0)) / r["w"]


def splits(node: pd.DataFrame, seed: int, per_shard: tuple[int, int]) -> pd.DataFrame:
    """Rows of one node (shards ``lo`` to ``hi``; a row per source with ``quota`` draws from draw ``first`` on), split into up to ``FAN`` parts."""
    each, extra = per_shard
    node = node.sort_values("source_no")
    todo = [(int(node["lo"].iloc[0]), int(node["hi"].iloc[0]), node["quota"].to_numpy(np.int64), node["first"].to_numpy(np.int64), FAN)]
    out = []
    while todo:
        lo, hi, quota, first, fan = todo.pop()
        if hi - lo == 1 or fan == 1:
            out.append(node.assign(lo=lo, hi=hi, quota=quota, first=first)[quota > 0])
            continue
        mid = (lo + hi) // 2
        room = each * (mid - lo) + max(0, min(mid, extra) - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(quota, room, method="marginals")
        todo += [(lo, mid, left, first, fan // 2), (mid, hi, quota - left, first + left, fan // 2)]
    return pd.concat(out)


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n-1: four Feistel rounds over the next even number of bits, walked until inside."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.SeedSequence(key).generate_state(4, np.uint64)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(31)
            left, right = right, left ^ ((f * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) & mask
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def draw(batches, seed: int):
    """From leaves of the tree to one row per drawn block."""
    for batch in batches:
        for r in batch.to_pylist():
            for at in range(0, r["quota"], STEP):
                j = r["first"] + np.arange(at, min(at + STEP, r["quota"]))
                turn = j // r["n_blocks"]
                block = np.concatenate([permuted(j[turn == t] % r["n_blocks"], r["n_blocks"], (seed << 40) + (r["source_no"] << 2) + int(t)) for t in np.unique(turn)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), r["source_no"])), pa.array(block), pa.array(turn), pa.array(np.full(len(j), r["lo"]))],
                                                 names=["source_no", "block", "pass", "shard"])


@dataclass(frozen=True)
class Mix:
    """``plan``: a row per source; ``lines``: a row per document; ``draws``: a row per drawn block."""

    plan: DataFrame
    lines: DataFrame
    draws: DataFrame
    seed: int

    def _pieces(self) -> DataFrame:
        """Documents cut at the borders of their source's blocks; documents without words have none."""
        a, w = F.col("start"), F.col("block_words")
        end = a + F.col("size")
        cut = self.lines.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(a / w), F.floor((end - 1) / w))))
        lo, hi = F.greatest(a, F.col("block") * w), F.least(end, (F.col("block") + 1) * w)
        return cut.select("source_no", "bucket", "line", "doc_id", "source", "block", (lo - a).alias("first_word"), (hi - lo).alias("n_words"))

    def rows(self) -> DataFrame:
        """The mix: ``shard``, ``place`` in it, and the words ``first_word`` .. of a document; ``pass`` tells repeats apart."""
        mixed = F.xxhash64(F.lit(self.seed), "source_no", "pass", "block")
        order = Window.partitionBy("shard").orderBy(mixed, "source_no", "pass", "block", "bucket", "line")
        found = self.draws.join(self._pieces(), ["source_no", "block"]).withColumn("place", F.row_number().over(order))
        return found.select("shard", "place", "doc_id", "source", "pass", "first_word", "n_words")

    def taken(self) -> DataFrame:
        """One row per document, repeated ones too: ``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` words."""
        n = self.draws.join(self._pieces(), ["source_no", "block"]).groupBy("source_no", "bucket", "line").agg(F.sum("n_words").alias("taken"))
        out = self.lines.join(n, ["source_no", "bucket", "line"], "left")
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42,
                shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Plan and draw a mix of ``share`` times the words of all documents; weights go round over the sources by code point, null last.

    Null texts have no words; documents without words, and sources without words, have target or taken 0. Rows
    that share an id are documents of their own; among equal (id, source, size) any is any. Other columns are left
    out, whatever their names. An empty table gives empty frames. ``share`` is at most ``most``.
    """
    if share > most:
        raise ValueError("the mix cannot hold more than the sources may be repeated")
    spark = docs.sparkSession
    sized = materialise(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                                    word_count(F.col(f"`{text_col}`")).alias("size")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    plan = numbered(sources, [F.col("source").asc_nulls_last()], "source_no", "sources").withColumn("weight", weight)
    total, n_sources = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    words = share * total
    level = water_level(plan, words, most) if total else 0.0
    size = F.col("source_size")
    widest = max(BLOCK_WORDS, -(-int(words) // MOST_BLOCKS))
    plan = plan.withColumn("target", F.least(F.col("weight") * F.lit(level), size * F.lit(float(most))))
    plan = plan.withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(widest), F.floor(size / LEAST_BLOCKS))).cast("long"))
    plan = plan.withColumn("n_blocks", F.ceil(size / F.col("block_words")).cast("long"))
    plan = plan.withColumn("quota", F.when(size > 0, F.round(F.col("target") * F.col("n_blocks") / size)).otherwise(0).cast("long"))
    n_docs = plan.agg(F.sum("docs")).first()[0] or 1
    most_docs = max(1, min(BUCKET_DOCS, n_docs // (4 * partitions(docs))))  # a quarter of a fair partition at most
    plan = materialise(plan.withColumn("buckets", F.ceil(F.col("docs") / most_docs).cast("long")), "plan")

    facts = plan.select(F.col("source").alias("__source"), "source_no", "source_size", "target", "block_words", "buckets")
    if n_sources <= INLINE_SOURCES:
        known = sized.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("__source")))
    else:  # every source in 64 copies, so that one source's documents meet in 64 tasks
        salt = F.pmod(F.xxhash64(F.lit(3), "doc_id", "size"), F.lit(64)).cast("int")
        spread = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        known = sized.withColumn("__s", salt).join(spread, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__s") == F.col("__salt"))).drop("__s", "__salt")
    mixed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    known = known.drop("__source").withColumn("mixed", mixed)  # buckets are ranges of the hash: the order of a line does not depend on their number
    known = known.withColumn("bucket", F.shiftright((F.shiftright("mixed", 32) + F.lit(1 << 31)) * F.col("buckets"), 32))
    per = Window.partitionBy("source_no", "bucket").orderBy("mixed", "doc_id", "size")
    placed = known.withColumns({"line": F.row_number().over(per), "before": F.sum("size").over(per.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    sums = known.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    lines = placed.join(sums, ["source_no", "bucket"]).withColumn("start", F.col("offset") + F.col("before"))
    lines = materialise(lines.drop("mixed", "buckets", "before", "offset"), "lines")

    tree = "source_no long, n_blocks long, quota long, first long, lo long, hi long"
    blocks, block_words = plan.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.coalesce(F.max("block_words"), F.lit(1))).first()
    shards = max(1, -(-blocks * block_words // shard_words))
    nodes = plan.where("quota > 0").select("source_no", "n_blocks", "quota", F.lit(0).cast("long").alias("first"),
                                           F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"))
    split = lambda node: splits(node, seed, divmod(blocks, shards))[["source_no", "n_blocks", "quota", "first", "lo", "hi"]]
    made = 1
    while made < shards:
        nodes, made = nodes.groupBy("lo", "hi").applyInPandas(split, tree), made * FAN
    draws = nodes.mapInArrow(lambda batches: draw(batches, seed), "source_no long, block long, pass long, shard long")
    return Mix(plan, lines, materialise(draws, "draws"), seed)


def op12_source_mix(spark, sf_dir: str) -> DataFrame:
    """A mix of half as many words again as there are; every document has one row, with or without words, repeated or without an id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).taken()
