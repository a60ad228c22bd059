"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets for the verdict.

Texts with equal sets of word 5-grams form a class; only the class's first document (its representative) goes on. The number
of bands and rows is chosen for ``RECALL`` at the threshold. Representatives that agree in a band meet in a bucket. A bucket
is cut into blocks of about ``BLOCK`` rows by a hash of the row, and pairs of blocks are compared, so no bucket has to fit into a
task; a pair is compared in the first band that it shares only. What leaves a block is never a list of pairs but, for
each representative, how many links it has there and the first representative that it hangs together with. Sums
give the link counts, and label propagation over those few edges gives the groups.

Texts travel only to blocks where they have a pair to be compared: a first pass over the band hashes tells.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import materialise

from .graph_dedup import word_symbols
from .repeats import mix, spread
from .rows import chunks, freeing, partitions, utf8, with_rid

N, SIMILARITY, RECALL, BLOCK = 5, 0.8, 0.9999, 256
SIGNATURE = "id long, rid long, a long, b long, size int, bands array<long>"


def banding(similarity: float, recall: float, most: int = 160) -> tuple[int, int]:
    """Bands and rows: the longest rows (fewest false candidates) whose bands reach the recall within ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, 16):
        p = similarity ** rows
        bands = 1 if p >= 1 else ceil(log(1 - recall) / log(1 - p))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted set of word n-gram hashes of each row. A text of fewer words has one n-gram, its words; one without words none."""
    words, rows = word_symbols(data, offsets)
    grams = spread(words, (n,))[n] if len(words) >= n else np.zeros(0, np.uint64)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(rows[i]), int(rows[i + 1])
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            h = words[a:a + 1]
            for j in range(a + 1, b):
                h = mix(h, words[j:j + 1])
            out.append(mix(h, np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """For each document: two 64-bit digests and the size of its n-gram set, and its band hashes (none without n-grams)."""
    rng = np.random.default_rng(20)
    times = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def bands_of(s: np.ndarray) -> np.ndarray:
        least = np.full(len(times), np.iinfo(np.uint64).max)
        for at in range(0, len(s), 2048):
            part = s[at:at + 2048]
            least = np.minimum(least, ((part[None, :] * times[:, None] + plus[:, None]) >> np.uint64(24)).min(axis=1))
        h = np.arange(bands, dtype=np.uint64)
        for r in range(rows):
            h = mix(h, least[r::rows])
        return h.view(np.int64)

    def run(batches):
        for batch in chunks(batches, "text", 1 << 20):
            sets = shingle_sets(*utf8(batch.column("text")), n)
            a = np.array([np.bitwise_xor.reduce(mix(s, np.uint64(1))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            b = np.array([np.add.reduce(mix(s, np.uint64(2))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            lists = [bands_of(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rid"), pa.array(a), pa.array(b), pa.array([len(s) for s in sets], pa.int32()),
                                              pa.array(lists, pa.list_(pa.int64()))], names=["id", "rid", "a", "b", "size", "bands"])

    return docs.mapInArrow(freeing(run), SIGNATURE)


def whole_groups(batches, key: str):
    """Regroup sorted batches so that no key is parted; a key has two blocks of rows at most."""
    held = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = np.asarray(batch.column(key))
        last = int(np.searchsorted(keys, keys[-1]))
        if last > 0 or (held and np.asarray(held[-1].column(key))[-1] != keys[-1]):
            out = held + ([batch.slice(0, last)] if last else [])
            if out:
                yield pa.Table.from_batches(out).combine_chunks()
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pairs_within(keys: np.ndarray, most: int = 1 << 20):
    """All pairs (i, j), i < j, of rows with equal keys, as index arrays of bounded length."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    ends = np.append(starts[1:], len(keys))
    left = np.repeat(ends, ends - starts) - np.arange(len(keys)) - 1
    at = 0
    while at < len(keys):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(left[at:]), most, "right")) + at)
        n = left[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield i, j
        at = stop


def table_bands(table: pa.Table, bands: int) -> np.ndarray:
    return np.asarray(table.column("bands").combine_chunks().flatten(), np.int64).reshape(-1, bands)


def due(table: pa.Table, bands: int):
    """The pairs that this bucket has to compare: of two different blocks (or one), and no earlier band is shared."""
    keys = np.asarray(table.column("block"))
    h, lone, side, band = table_bands(table, bands), np.asarray(table.column("lone")), np.asarray(table.column("side")), np.asarray(table.column("band"))
    for i, j in pairs_within(keys):
        ok = lone[i] | (side[i] != side[j])
        i, j = i[ok], j[ok]
        for k in range(bands):
            early = band[i] > k
            if not early.any():
                break
            ok = ~(early & (h[i, k] == h[j, k]))
            i, j = i[ok], j[ok]
        if len(i):
            yield i, j


def wanted(members: DataFrame, bands: int) -> DataFrame:
    """The members that have a pair to be compared in their block."""

    def run(batches):
        for table in whole_groups(batches, "block"):
            use = np.zeros(table.num_rows, bool)
            for i, j in due(table, bands):
                use[i] = use[j] = True
            yield from table.filter(pa.array(use)).to_batches()

    return members.mapInArrow(freeing(run), members.schema)


def verified(members: DataFrame, bands: int, n: int, similarity: float) -> DataFrame:
    """``rid, links, root``: links found in a block, and the smallest representative that hangs together with this one there."""

    def run(batches):
        for table in whole_groups(batches, "block"):
            rid = np.asarray(table.column("rid"))
            column = table.column("text").combine_chunks()
            sets = []
            for batch in chunks([pa.RecordBatch.from_arrays([column], names=["text"])], "text", 1 << 20):
                sets += shingle_sets(*utf8(batch.column("text")), n)
            links, root = np.zeros(len(rid), np.int64), np.arange(len(rid))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, j in due(table, bands):
                for x, y in zip(i.tolist(), j.tolist()):
                    s, t = sets[x], sets[y]
                    if min(len(s), len(t)) < similarity * max(len(s), len(t)):
                        continue
                    both = np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s)
                    if both >= similarity * (len(s) + len(t) - both):
                        links[x] += 1
                        links[y] += 1
                        u, v = top(x), top(y)
                        if u != v:
                            u, v = (u, v) if rid[u] < rid[v] else (v, u)
                            root[v] = u
            use = np.flatnonzero(links)
            roots = np.array([rid[top(x)] for x in use.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rid[use]), pa.array(links[use]), pa.array(roots)], names=["rid", "links", "root"])

    return members.mapInArrow(freeing(run), "rid long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """``rid, label``: the smallest row of each connected group, by hash-to-min with pointer jumping. Every round is a stored table."""
    both = materialise(edges.select(F.col("rid").alias("x"), F.col("root").alias("y")).unionByName(edges.select(F.col("root").alias("x"), F.col("rid").alias("y")))
                       .filter("x <> y").distinct(), "edges")
    labels = materialise(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "rid"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("rid", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        low = labels.join(near, labels["rid"] == near["x"], "left").select("rid", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        low = materialise(low, "labels")
        jump = low.select(F.col("rid").alias("j"), F.col("low").alias("further"))
        new = materialise(low.join(jump, low["low"] == jump["j"], "left").select("rid", F.least("low", "further").alias("label"), "old"), "labels")
        if new.filter("label <> old").isEmpty():
            return new.select("rid", "label")
        labels = new.select("rid", "label")


def similar_groups(base: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``rid, doc_id, class_id, rep_id, n_links, kept``, one row per row of ``with_rid``.

    ``rep_id`` is the first document with the same n-gram set, ``n_links`` the number of other representatives whose similarity to it
    reaches the threshold, ``class_id`` the first document of the group that links hold together, ``kept`` whether it is that. Null and
    wordless texts have no links and are classes of their own. Rows that share an id are documents of their own.
    """
    bands, rows = banding(similarity, recall)
    shuffle = partitions(base)
    sig = materialise(signatures(base, n, bands, rows), "signatures")
    classes = sig.filter("size > 0").groupBy("a", "b", "size").agg(F.min("rid").alias("rep"))
    classes = materialise(classes, "classes")
    reps = sig.select("rid", "bands").join(classes.select(F.col("rep").alias("rid")), "rid")
    placed = materialise(reps.select("rid", F.posexplode("bands").alias("band", "h")).select("rid", "band", "h"), "band-rows")
    sizes = placed.groupBy("band", "h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = placed.join(sizes, ["band", "h"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64(F.lit(3), "rid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = met.select("rid", "band", F.xxhash64("band", "h", low, high).alias("block"), (low == high).alias("lone"), (F.col("own") == low).alias("side"))
    members = met.join(sig.select("rid", "bands"), "rid").repartition(shuffle, "block").sortWithinPartitions("block")
    need = materialise(wanted(members, bands), "to-compare")
    texts = base.select("rid", "text").join(need.select("rid").distinct(), "rid", "left_semi")
    found = materialise(verified(need.join(texts, "rid").repartition(shuffle, "block").sortWithinPartitions("block"), bands, n, similarity), "links")
    label = components(found.select("rid", "root"))
    links = found.groupBy("rid").agg(F.sum("links").alias("n_links"))
    names = sig.select(F.col("rid").alias("label"), F.col("id").alias("class_id")).join(label.select("label").distinct(), "label")
    info = classes.join(links.join(label, "rid").join(names, "label").withColumnRenamed("rid", "rep"), "rep", "left")
    rep_ids = sig.select(F.col("rid").alias("rep"), F.col("id").alias("rep_id"))
    info = materialise(info.join(rep_ids, "rep"), "class-info")
    out = sig.select("id", "rid", "a", "b", "size").join(info, ["a", "b", "size"], "left")
    grouped = F.when(F.col("label").isNotNull(), F.col("class_id")).when(F.col("rep").isNotNull(), F.col("rep_id")).otherwise(F.col("id"))
    return out.select("rid", F.col("id").alias("doc_id"), grouped.alias("class_id"), F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("rep_id")).alias("rep_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("rid") == F.coalesce("label", "rep", "rid")).alias("kept"))


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, rep_id, n_links, kept`` of every document; see ``similar_groups``."""
    return similar_groups(with_rid(docs, id_col, text_col), n, similarity, recall).drop("rid")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each group, with the columns of ``docs``."""
    base = with_rid(docs, id_col, text_col, tuple(docs.columns))
    gone = materialise(similar_groups(base.select("id", "text", "rid")).filter("not kept").select("rid"), "dropped")
    return base.join(gone, "rid", "left_anti").select("row.*")


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join_similar(docs)
