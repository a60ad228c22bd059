"""Periodic runs of words: multi-scale minimizers seed them, exact extension and comparison settle them.

A run is a stretch of words with smallest period ``q`` and at least ``max(MIN_WORDS, MIN_TIMES * q)`` words that no
neighbouring word extends. Periods up to ``SHORT`` are found by comparing the text with itself at each lag. Longer
ones are split into scales: at scale ``k`` the periods above the scale before and up to ``k``. Inside a run of such
a period the ``k``-word strings of one period all differ (``k >= q``), so a window minimum of their hashes is met
again exactly one period on, and the windows are short enough for two of them, a period apart, to fit into three
periods. Pairs of equal neighbouring minima whose distance lies in the scale are therefore seeds that miss no run.
Seeds are extended both ways by comparing prefix hashes; what is long enough is then compared word by word, so
no result rests on a hash. A stretch found at several lags counts once, with the smallest: the others are multiples.

Texts are taken in batches of bounded size, each document whole; nothing is shuffled.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import chunks

MIN_WORDS, MIN_TIMES = 24, 3
SHORT = 16
SPREAD = 1.5  # a scale covers periods up to so many times those of the scale before
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = np.uint64(0xD6E8FEB86659FD93)

Run = tuple[int, int, int]  # start, length, period


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ODD + b
    x ^= x >> np.uint64(29)
    x *= _MIX
    return x ^ (x >> np.uint64(32))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width``, by doubling."""
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[:len(x) - (width - done)], x[width - done:]) if width > done else x


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each position, by doubling; ``k`` is at least 2."""
    h, done = _mix(ids, ids), 1
    while done * 2 <= k:
        h = _mix(h[:-done], h[done:])
        done *= 2
    return _mix(h[:len(h) - (k - done)], h[k - done:]) if k > done else h


def _lag_runs(ids: np.ndarray, q: int, least: int) -> list[Run]:
    """All maximal stretches of at least ``least`` words in which words ``q`` apart are equal."""
    if len(ids) <= q:
        return []
    differ = np.flatnonzero(ids[:-q] != ids[q:])
    edges = np.concatenate([[-1], differ, [len(ids) - q]])
    same = np.diff(edges) - 1
    return [(int(edges[i]) + 1, int(same[i]) + q, q) for i in np.flatnonzero(same >= least - q)]


def _seeds(ids: np.ndarray, above: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and lags of equal neighbouring window minima, with ``above < lag <= k``."""
    width = 2 * (above + 1) - k + 1
    none = np.zeros(0, np.int64)
    if len(ids) < k + width:
        return none, none
    h = _grams(ids, k)
    low = _slide(h, width, np.minimum)
    best = _slide(np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    at = np.flatnonzero(h == best)
    at = at[np.argsort(h[at], kind="stable")]
    lag = np.diff(at)
    use = (h[at[1:]] == h[at[:-1]]) & (lag > above) & (lag <= k)
    return at[:-1][use], lag[use]


def _extend(ids: np.ndarray, at: np.ndarray, lag: np.ndarray) -> list[Run]:
    """The maximal stretch around each seed in which words ``lag`` apart are equal, once per stretch, compared in full."""
    if not len(at):
        return []
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(ids), _BASE)]))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(ids, ids) * power[:-1])])

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (prefix[b] - prefix[a]) * power[lag] == prefix[b + lag] - prefix[a + lag]

    lo, hi = np.zeros(len(at), np.int64), len(ids) - lag - at
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        ok = same(at, at + mid)
        lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
    ahead = lo
    lo, hi = np.zeros(len(at), np.int64), at.copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        ok = same(at - mid, at)
        lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
    out = []
    for s, n, q in {(int(x - b), int(a + b + g), int(g)) for x, a, b, g in zip(at, ahead, lo, lag)}:
        if n < max(MIN_WORDS, MIN_TIMES * q):
            continue
        if np.array_equal(ids[s:s + n - q], ids[s + q:s + n]):
            out.append((s, n, q))
        else:  # equal hashes of unequal words
            out += _lag_runs(ids, q, max(MIN_WORDS, MIN_TIMES * q))
    return out


def find_runs(ids: np.ndarray, offsets: np.ndarray) -> list[list[Run]]:
    """Runs of each document, by start and period; ``ids`` holds word numbers end to end, ``offsets`` one more than documents."""
    sizes = np.diff(offsets)
    best: dict[tuple[int, int, int], int] = {}
    above, k = 0, SHORT
    while True:
        docs = np.flatnonzero(sizes >= max(MIN_WORDS, MIN_TIMES * (above + 1)))
        if not len(docs):
            break
        parts = []
        for n, d in enumerate(docs):  # a number of its own behind each document: nothing reaches across
            parts += [ids[offsets[d]:offsets[d + 1]], np.array([(1 << 62) + n])]
        line = np.concatenate(parts).astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes[docs] + 1)])
        if above == 0:
            found = [r for q in range(1, k + 1) for r in _lag_runs(line, q, max(MIN_WORDS, MIN_TIMES * q))]
        else:
            found = _extend(line, *_seeds(line, above, k))
        for s, n, q in found:
            i = int(np.searchsorted(starts, s, "right")) - 1
            key = (int(docs[i]), s - int(starts[i]), n)
            best[key] = min(q, best.get(key, q))
        above, k = k, int(k * SPREAD)
    out: list[list[Run]] = [[] for _ in sizes]
    for (d, s, n), q in best.items():
        out[d].append((s, n, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q:s + n] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``runs`` (by start, then period), ``strongest`` (greatest length / period; of equal ones the
    smallest start, then period; null without a run) and ``collapsed``, the text without the repeats of its runs.

    Rows are judged one by one: repeated rows, null ids and empty tables need no care, other columns are left out
    whatever their names. A null text is empty, an empty one has no runs.
    """

    def run(batches):
        for batch in chunks(batches, "text"):
            number: dict[bytes, int] = {}
            words = [t.split() for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            offsets = np.cumsum([0, *map(len, words)])
            ids = np.fromiter((number.setdefault(w, len(number)) for doc in words for w in doc), np.int64, int(offsets[-1]))
            found = find_runs(ids, offsets)
            item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            rows = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
            top = [min(r, key=lambda x: (Fraction(-x["length"], x["period"]), x["start"], x["period"]), default=None) for r in rows]
            text = pa.array([collapse(w, r) for w, r in zip(words, found)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(item)), pa.array(top, item), text],
                                             names=["doc_id", "runs", "strongest", "collapsed"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, runs array<{RUN}>, strongest {RUN}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, with the end of every tenth text or so (by crc32 of the id; a null id counts as an empty
    string) made periodic: word ``i`` from ``a`` on becomes word ``a + (i - a) % p``."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    text = F.coalesce("text", F.lit(""))
    words = F.array_compact(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    rows = docs.select("doc_id", text.alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.size("words"))  # -1 or null where the text stays
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.pmod("g", F.col("n"))).cast("int"))
    rows = rows.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)) + 1).cast("int"))
    again = F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    whole = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(again)), F.lit(1), F.col("n"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document after planting. Null texts are empty; every row is judged by itself, repeated ones too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = periodic_runs(planted(docs))
    top = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"),
                      top["period"].alias("period"), F.floor(top["length"] * 1000 / top["period"]).alias("exponent_milli"),
                      F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                      F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
