"""Exact dedup by content sort.

Rows are range-partitioned by sampled splitters over their normalised bytes, sorted externally so that
equal texts are neighbours, and neighbours are compared in full; the smallest id of a run stays.

The splitters are drawn on the first ``PREFIX`` characters and a 64-bit hash that parts texts with a
common beginning, so the driver's sample is of short keys however long the texts are. A text with
more rows than a quarter of a fair partition is hot: there are at most 4 x partitions of them, by
count. Its rows are sorted in ``slice`` pieces, sized so that no piece exceeds that quarter, and the
heads of the pieces (8 x partitions rows at most) are merged by full comparison afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import materialise

from .rows import partitions

PREFIX = 48


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def group_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and the ``carry`` columns in a struct ``row``.

    Null texts are empty. Null ids sort first, so a null id stays if its text has one. Of rows that share
    both id and text one is kept: of equal ids, the first of the sorted run. An empty table gives no rows.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm"),
                       F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")]).alias("row"))
    base = base.withColumn("h", F.xxhash64("norm"))
    n, total = partitions(docs), docs.count()
    most = max(2, total // (4 * n))
    hot = base.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    hot = hot.select("h", F.ceil(F.col("n") / most).cast("int").alias("slices"))  # at most 4 x partitions rows
    keyed = (base.join(F.broadcast(hot), "h", "left")
             .withColumn("slice", F.coalesce(F.pmod(F.xxhash64(F.lit(7), "id"), F.col("slices")).cast("int"), F.lit(-1)))
             .withColumn("prefix", F.substring("norm", 1, PREFIX)).drop("slices"))
    dealt = keyed.repartitionByRange(n, "prefix", "h", "slice")
    run = Window.partitionBy("prefix", "h", "slice", "norm")
    order = run.orderBy(F.col("id").asc_nulls_first())
    found = dealt.select("id", "row", "slice", F.first("id").over(order).alias("first_id"), F.row_number().over(order).alias("place"),
                         F.count(F.lit(1)).over(run).alias("size"), F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), "norm")
    head = (F.col("place") == 1) & (F.col("slice") >= 0)
    found = materialise(found.withColumn("head", F.when(head, F.col("norm"))).drop("norm"), "content-sorted")
    # the heads of a hot text's pieces: 8 x partitions rows at most, compared in full
    first = F.min(F.struct(F.col("first_id").isNotNull().alias("set"), "first_id", "slice"))
    merged = (found.filter("head is not null").groupBy("head").agg(first.alias("best"), F.sum("size").alias("all"), F.first("text_sha256").alias("text_sha256"))
              .select("text_sha256", F.col("best.first_id").alias("hot_id"), F.col("best.slice").alias("hot_slice"), F.col("all").alias("hot_size")))
    out = found.join(F.broadcast(merged), "text_sha256", "left")  # at most 4 x partitions rows of fixed width
    is_hot = F.col("slice") >= 0
    keep = F.when(is_hot, F.col("hot_id")).otherwise(F.col("first_id"))
    kept = (F.col("place") == 1) & (~is_hot | (F.col("slice") == F.col("hot_slice")))
    return out.select("id", keep.alias("keep_id"), F.when(is_hot, F.col("hot_size")).otherwise(F.col("size")).alias("group_size"),
                      kept.alias("kept"), "text_sha256", "row")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    kept = group_exact(docs, id_col, text_col, tuple(docs.columns)).filter("kept").select("row.*")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return group_exact(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")
