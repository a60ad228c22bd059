"""Substring dedup on a compacted De Bruijn graph of words.

Words make the symbols and the anchors (``repeats``) are the k-mers of a sparse graph: an edge is the path of
windows that hang on one anchor, so a path without branches is compact from the start and a join on the
anchor, then on the path's content, counts how often it is walked. Paths that branch (an anchor with more than
one content) are opened into single windows, and those are counted. Repeated edges that follow each other in a
document are then compacted into spans by their source coordinates, which also say which words go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import BLOCK, covered, marks_of, mix, repeated
from .rows import chunks, utf8, with_rid
from .suffix_dedup import BYTES

WINDOW, KMER = 35, 8
OUTPUT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept string"
POWER = np.uint64(0x9DDFEA08EB382D69)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the offsets of rows in words; ASCII white space and row ends part words."""
    ink = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    begin = ink.copy()
    begin[1:] &= ~ink[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = ink[edges]
    starts = np.flatnonzero(begin)
    stop = ink.copy()
    stop[:-1] &= ~ink[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    stop[ends] = ink[ends]
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word: a polynomial over scrambled bytes, mixed with the length."""
    starts, ends, rows = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    size = ends - starts
    powers = np.full(int(size.max()), POWER)
    powers = np.cumprod(powers)
    each = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(data)]])))
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    value = np.where(inside, BYTES[data] * powers[np.minimum(each, len(powers) - 1)], np.uint64(0))
    return mix(np.add.reduceat(value, starts), size.astype(np.uint64)), rows


def cut_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Per document: words, words removed, maximal removed spans, the digest of the kept words joined by a space, and those.

    Null texts have no words. Texts shorter than the window lose nothing. Rows that share an id are documents of
    their own, so a repeated row of enough words is removed in all its copies.
    """
    found = repeated(with_rid(docs, id_col, text_col), word_symbols, window, kmer, True)

    def run(batches):
        for batch in chunks(batches, "text", BLOCK):
            data, offsets = utf8(batch.column("text"))
            starts, ends, rows = word_bounds(data, offsets)
            row, start, n, _ = marks_of(batch.column("marks"))
            order = np.argsort(row, kind="stable")
            row, start, n = row[order], start[order], n[order]
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            raw, out = data.tobytes(), []
            for i in range(batch.num_rows):
                a, b = starts[rows[i]:rows[i + 1]], ends[rows[i]:rows[i + 1]]
                at = slice(cuts[i], cuts[i + 1])
                gone = covered(len(a), start[at], n[at], window) if cuts[i] < cuts[i + 1] else np.zeros(len(a), bool)
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                kept = b" ".join([raw[x:y] for x, y in zip(a[~gone].tolist(), b[~gone].tolist())])
                out.append((len(a), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode()))
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             names=["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256", "kept"])

    return found.mapInArrow(run, OUTPUT)


def op8_graph_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_spans(docs).drop("kept")
