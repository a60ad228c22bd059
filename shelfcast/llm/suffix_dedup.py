"""Suffix-array dedup by depth-limited radix sort.

Suffixes are told apart through ``window`` bytes only, by passes over digits of many bytes, the most
significant first; after a pass a suffix that is alone leaves, and what is equal to the end is a repeated window.
The first digit is the window's anchor (``repeats``), which lets neighbouring suffixes go through the first two
passes as one run: pass one groups runs by anchor, pass two by the run's whole content, pass three
splits the runs that are still mixed into single suffixes and groups these by all their bytes. The order
among unequal digits is never used, so it is that of hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import BLOCK, covered, marks_of, mix, repeated
from .rows import chunks, utf8, with_rid

WINDOW, ANCHOR = 100, 32
OUTPUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
BYTES = mix(np.arange(1, 257, dtype=np.uint64), np.uint64(0x5851F42D4C957F2D))


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTES[data], offsets


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, the digest of what is kept, and those bytes.

    Null texts are empty. Texts shorter than the window lose nothing. Rows that share an id are documents
    of their own in the order of their texts (``with_rid``).
    """
    found = repeated(with_rid(docs, id_col, text_col), byte_symbols, window, anchor, False)

    def run(batches):
        for batch in chunks(batches, "text", BLOCK):
            data, offsets = utf8(batch.column("text"))
            row, start, n, _ = marks_of(batch.column("marks"))
            order = np.argsort(row, kind="stable")
            row, start, n = row[order], start[order], n[order]
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out = []
            for i in range(batch.num_rows):
                text, at = data[offsets[i]:offsets[i + 1]], slice(cuts[i], cuts[i + 1])
                gone = covered(len(text), start[at], n[at], window) if cuts[i] < cuts[i + 1] else np.zeros(len(text), bool)
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                kept = text[~gone].tobytes()
                out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return found.mapInArrow(run, OUTPUT)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_repeats(docs).drop("kept")
