"""Helpers shared by the text operators: row identity, byte views of Arrow text, stored tables."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.session import materialise

CHUNK_BYTES = 4 << 20


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle is dealt to; the session decides, by the size of its cluster and input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_rid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``text``, ``rid``: the documents with an integer key that is unique and follows the order of ids.

    Where the ids are unique and not null the key is the id itself. Otherwise rows are numbered in
    the order of (id, text), nulls first, and stored, so rows that share an id count as documents
    of their own. Null texts become empty ones. ``carry`` names columns to keep as they are in a struct ``row``.
    """
    extra = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *extra)
    repeated = base.groupBy("id").count().filter("id is null or count > 1")
    if repeated.isEmpty():
        return base.withColumn("rid", F.col("id"))
    # splitters are drawn on the beginning of a text, so the driver sees short keys however long texts are
    head = [F.col("id").asc_nulls_first(), F.substring("text", 1, 64)]
    return numbered(base, head, "rid", "numbered", [*head, F.col("text")])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, then let the session drop the shuffle files of the finished step: they are
    deleted once the driver has collected the plan that made them, which on a quiet driver may be long after."""
    out = materialise(df, name)
    for _ in range(2):  # handles first, then what they held
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column end to end, and the offsets of its rows (one more than rows)."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    large = column.cast(pa.large_binary())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset:large.offset + len(large) + 1]
    data = large.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]] if len(offsets) else raw, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text; a longer row stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives back what the task held: workers live on, beside those of later stages. Its variables are
    gone by then; Arrow's pool lets go of free blocks, and the C library of free pages where it has a call for that."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return task


def numbered(df: DataFrame, order: list[Column], out: str, name: str = "numbered", within: list[Column] | None = None) -> DataFrame:
    """The stored rows with their place from 0 in the global order: range partitions sorted apart, and an offset for each
    (one number per partition is all the driver sees). ``within`` is a finer order that agrees with ``order``."""
    part, row = F.shiftright(F.col("__at"), 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    at = df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*(within or order))
    stored_rows = materialise(at.withColumn("__at", F.monotonically_increasing_id()), name)
    sizes = {r["p"]: r["n"] for r in stored_rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    if not offsets:
        return stored_rows.drop("__at").withColumn(out, F.lit(0).cast("long"))
    spark = df.sparkSession
    starts = spark.createDataFrame(offsets, "__part long, __start long")
    return (stored_rows.withColumn("__part", part).join(F.broadcast(starts), "__part")  # a row per partition
            .withColumn(out, F.col("__start") + row).drop("__at", "__part", "__start"))
