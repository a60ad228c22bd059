"""Repeated windows over whole corpora: the scan and the dealing that the two substring operators share.

All windows of ``window`` symbols are looked at, but they travel in runs. Within each window the ``key``
symbols with the least hash are its anchor (leftmost of equals). Which they are depends on the window's own
symbols alone, so equal windows have equal anchors at equal offsets, and consecutive windows with one anchor
form a run. A run is known by its anchor's hash and its content's hash (all symbols of its windows, and where
the anchor lies). Runs with equal content have equal windows throughout; a run whose anchor is nowhere
else has no repeated window; only runs that share an anchor but not their content are looked at window by window.

Before anything is shuffled each task combines the equal runs of a block of texts: one goes on for all, so a passage
that a third of the documents share costs a row per block. Hashes have 64 bits, and runs compare 128.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import chunks, stored, utf8

C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
RUN = "kind int, key long, content long, rid long, start int, n int, many boolean"
MARKED, EXPAND, BOTH = 1, 2, 3
BLOCK = 1 << 20
LOW = np.uint64(0xFFFFFFFF)


def mix(a: np.ndarray, b) -> np.ndarray:
    x = a * C1
    x ^= x >> np.uint64(29)
    x += b
    x *= C2
    x ^= x >> np.uint64(32)
    return x


def spread(symbols: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all substrings of the given lengths, by doubling."""
    out, h, size = {}, symbols, 1
    for length in sorted(lengths):
        while size * 2 <= length:
            h = mix(h[:-size], h[size:])
            size *= 2
        out[length] = h if size == length else mix(h[:len(symbols) - length + 1], h[length - size:])
    return out


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:len(values) - (width - size)], values[width - size:]) if size < width else values


def runs_of(symbols: np.ndarray, offsets: np.ndarray, window: int, key: int):
    """(row, start, n, anchor hash, content hash) of all runs, and the window hashes by position."""
    n = len(symbols)
    if n < window:
        e = np.zeros(0, np.int64)
        return e, e, e, e.view(np.uint64), e.view(np.uint64), e.view(np.uint64)
    h = spread(symbols, (key, window))
    anchor, whole = h[key], h[window]
    at = (anchor & ~LOW) | np.arange(len(anchor), dtype=np.uint64)
    at = (least(at, window - key + 1) & LOW).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(row[:n - window + 1] == row[window - 1:])
    if not len(starts):
        e = np.zeros(0, np.int64)
        return e, e, e, e.view(np.uint64), e.view(np.uint64), whole
    at = at[starts]
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.append(first[1:], len(starts)) - 1
    s0, s1, p = starts[first], starts[last], at[first]
    content = mix(mix(whole[s0], whole[s1]), ((p - s0) * (2 * window) + (s1 - s0)).astype(np.uint64))
    r = row[s0]
    return r, s0 - offsets[r], s1 - s0 + 1, anchor[p], content, whole


def combined(key, content, rid, start, n, many, every: bool) -> pa.RecordBatch:
    """Rows to shuffle. Of the block's equal runs the first (by rid, start) goes on under the anchor's key; the others are
    marked already and are dealt by place. ``every``: the first of several is marked as well, which ``many`` tells."""
    order = np.lexsort((start, rid, content, key))
    key, content, rid, start, n, many = (x[order] for x in (key, content, rid, start, n, many))
    if len(key):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])])
        group = np.flatnonzero(new)
        size = np.diff(np.append(group, len(key)))
        if every:
            many = many.copy()
            many[group] = np.logical_or.reduceat(many, group) | (size > 1)
        kind = np.where(new, 0, MARKED).astype(np.int32)
        key = np.where(new, key, mix(rid.astype(np.uint64), start.astype(np.uint64)))
    else:
        kind = np.zeros(0, np.int32)
    arrays = [kind, key.view(np.int64), content.view(np.int64), rid, start.astype(np.int32), n.astype(np.int32), many]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["kind", "key", "content", "rid", "start", "n", "many"])


def scan(docs: DataFrame, symbols, window: int, key: int, every: bool) -> DataFrame:
    """The runs of all texts, combined by block. ``symbols`` turns bytes and offsets of a block into symbol hashes and their offsets."""

    def run(batches):
        for batch in chunks(batches, "text", BLOCK):
            values, offsets = symbols(*utf8(batch.column("text")))
            rid = np.asarray(batch.column("rid").to_numpy(zero_copy_only=False), np.int64)
            r, start, n, k, c, _ = runs_of(values, offsets, window, key)
            yield combined(k, c, rid[r], start, n, np.zeros(len(r), bool), every)

    return docs.select("rid", "text").mapInArrow(run, RUN)


def deal(runs: DataFrame, every: bool) -> DataFrame:
    """``rid, start, n, kind`` of the runs that matter: marked as repeated, to be looked at window by window, or both.

    One shuffle by anchor. The rows of one anchor are as many as blocks at most, not as many as occurrences.
    """
    anchor = Window.partitionBy("kind", "key")
    same = Window.partitionBy("kind", "key", "content")
    split = runs.select("*", (F.min("content").over(anchor) != F.max("content").over(anchor)).alias("split"),
                        F.row_number().over(same.orderBy("rid", "start")).alias("place"), F.count(F.lit(1)).over(same).alias("size"))
    head = (F.col("kind") == 0) & (F.col("place") == 1) & F.col("split")
    if every:
        marked = (F.col("kind") == MARKED) | F.col("many") | (F.col("size") > 1)
    else:
        marked = (F.col("kind") == MARKED) | (F.col("place") > 1)
    kind = F.when(marked & head, BOTH).when(marked, MARKED).when(head, EXPAND)
    return split.select("rid", "start", "n", kind.alias("kind")).filter("kind is not null")


def by_document(marks: DataFrame) -> DataFrame:
    """The marks of a document in one row; a text has no more of them than symbols."""
    return marks.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "kind")).alias("marks"))


def marks_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, n, kind) of a list column; null lists are empty."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), [len(x) if x.is_valid else 0 for x in lists]) if len(flat) else np.zeros(0, np.int64)
    start, n, kind = (np.asarray(flat.field(i), np.int64) for i in range(3))
    return row, start, n, kind


def windows(docs: DataFrame, marks: DataFrame, symbols, window: int, every: bool) -> DataFrame:
    """The windows of the runs to be looked at, as runs of one window each, combined by block."""
    wanted = by_document(marks.filter(F.col("kind") >= EXPAND))

    def run(batches):
        for batch in chunks(batches, "text", BLOCK):
            values, offsets = symbols(*utf8(batch.column("text")))
            whole = spread(values, (window,))[window]
            rid = np.asarray(batch.column("rid"), np.int64)
            row, start, n, kind = marks_of(batch.column("marks"))
            each = np.repeat(np.arange(len(row)), n)
            s = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            h = whole[offsets[row[each]] + s]
            yield combined(h, np.zeros(len(h), np.uint64), rid[row[each]], s, np.ones(len(h), np.int64), kind[each] == BOTH, every)

    return docs.join(wanted, "rid").select("rid", "text", "marks").mapInArrow(run, RUN)


def covered(length: int, start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which of a text's symbols lie in a marked window."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(docs: DataFrame, symbols, window: int, key: int, every: bool) -> DataFrame:
    """``id, rid, text, marks``: every document with the runs of its windows that count as repeated.

    ``docs`` has a unique ``rid``. With ``every`` all occurrences count, else all but the first by (rid, start).
    """
    first = stored(deal(scan(docs, symbols, window, key, every), every), "runs")
    second = stored(deal(windows(docs, first, symbols, window, every), every).filter(F.col("kind") == MARKED), "windows")
    marks = first.filter(F.col("kind") != EXPAND).unionByName(second)
    return docs.join(by_document(marks), "rid", "left").select("id", "rid", "text", "marks")
