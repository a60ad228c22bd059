"""Language identification: averaged hashed subword embeddings and a linear softmax, fitted by SGD in numpy.

Subwords are the 2-, 3- and 4-byte pieces of words with their borders (ASCII letters lower-cased, other ASCII
bytes are borders). A text is the mean of its pieces' embeddings over the whole text; one softmax layer
follows. For prediction both layers fold into one table of scores per piece, so a text is a gather and a mean.

Fit: ``PER_LANG`` labelled documents of each language are expected, ``MAX_ROWS`` at most in all, drawn by a hash of
the id; a fifth of them is kept out of the SGD and sets the temperature and the score below which a
prediction is rejected: the value that ``KEEP`` of their right answers reach, 0.5 at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import chunks, freeing, utf8

PER_LANG, MAX_ROWS = 800, 8_000
BUCKETS, DIM, EPOCHS, BATCH, KEEP = 1 << 13, 16, 12, 64, 0.999
STEP = 1 << 17  # bytes whose pieces are held at once
KEPT_CHUNK = 1 << 20  # bytes of text that are judged and sent on at once
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls on a fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def subwords(data: np.ndarray, offsets: np.ndarray, starts: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: bucket of every piece that starts in the first ``starts`` bytes (all by default), and where the rows begin
    among them; pieces of borders only are left out."""
    folded = _FOLD[data]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = []
    for size in (2, 3, 4):
        n = len(folded) - size + 1
        if n <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)))
            continue
        h = np.full(n, size, np.uint32)
        ink = np.zeros(n, bool)
        for i in range(size):
            h = (h ^ folded[i:i + n]) * np.uint32(0x01000193)
            ink |= folded[i:i + n] != 32
        h ^= h >> np.uint32(15)
        use = np.flatnonzero((ink & (row[:n] == row[size - 1:]))[:starts])
        out.append(((h[use] & np.uint32(BUCKETS - 1)).astype(np.int64), np.searchsorted(row[use], np.arange(len(offsets)))))
    return out


@dataclass(frozen=True)
class LanguageModel:
    """``table``: a score per bucket and language; ``reject_below``: the score that a kept prediction reaches."""

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        count = np.zeros(len(offsets) - 1)
        for at in range(0, len(data), STEP):  # a piece belongs to the step that it starts in, so no text is too long
            part = data[at:at + STEP + 3]
            for bucket, cuts in subwords(part, np.clip(offsets - at, 0, len(part)), STEP):
                full = np.flatnonzero(np.diff(cuts))
                if len(full):
                    total[full] += np.add.reduceat(self.table[bucket], cuts[full], axis=0, dtype=np.float64)
                    count[full] += np.diff(cuts)[full]
        logits = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def sgd(x: np.ndarray, y: np.ndarray, n_lang: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias by minibatch SGD; ``x`` holds the share of each bucket in a text."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (x.shape[1], DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, n_lang)).astype(np.float32)
    b = np.zeros(n_lang, np.float32)
    for epoch in range(EPOCHS):
        rate = 2.0 * (1 - epoch / EPOCHS)
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            xb = x[at] * 50  # shares are small: a fixed scale in place of a larger rate
            hidden = xb @ e
            z = hidden @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            grad = xb.T @ (p @ w.T)
            w -= rate * 0.1 * (hidden.T @ p)
            b -= rate * 0.1 * p.sum(axis=0)
            e -= rate * grad
    return e * 50, w, b


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """A model from the given labelled rows; None where there are none. Rows without a text or language are left out."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.filter("text is not null and lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count")).limit(MAX_ROWS // 8).collect()}
    if not counts:
        return None
    each = min(PER_LANG, MAX_ROWS // len(counts))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(42), F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(draw < share).select("text", "lang", draw.alias("draw")).limit(MAX_ROWS).toArrow()
    if sample.num_rows == 0:
        sample = rows.select("text", "lang", draw.alias("draw")).limit(each).toArrow()
    order = np.argsort(np.asarray(sample.column("draw")), kind="stable")
    langs = tuple(sorted(set(sample.column("lang").to_pylist())))
    y = np.array([langs.index(v) for v in sample.column("lang").to_pylist()])[order]
    x = np.zeros((sample.num_rows, BUCKETS), np.float32)
    for i, j in enumerate(order):
        found = np.concatenate([b for b, _ in subwords(*utf8(sample.column("text").combine_chunks().slice(int(j), 1)))])
        if len(found):
            x[i] = np.bincount(found, minlength=BUCKETS) / len(found)
    kept_out = np.arange(len(y)) % 5 == 4
    if kept_out.sum() < 10:
        kept_out[:] = False
    e, w, b = sgd(x[~kept_out], y[~kept_out], len(langs))
    table = (e @ w).astype(np.float32)
    test = kept_out if kept_out.any() else ~kept_out
    z = x[test] @ table + b
    losses = []
    for t in np.geomspace(0.25, 4, 17):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        losses.append((float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), y[test]])), float(t)))
    temperature = min(losses)[1]
    p = np.exp(z / temperature - (z / temperature).max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p.max(axis=1)[p.argmax(axis=1) == y[test]]
    floor = float(np.quantile(right, 1 - KEEP)) if len(right) else 0.0
    return LanguageModel(langs, table, b, temperature, min(0.5, floor))


def predict_languages(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and ``rejected`` added or replaced.

    A null text or one without a letter is ``und`` with score 0 and rejected, as is every text without a model.
    Rows are judged one by one over their whole text.
    """

    def run(batches):
        for batch in chunks(batches, "__text"):
            p = model.probabilities(*utf8(batch.column("__text")))
            best = p.argmax(axis=1)
            letter = np.asarray(batch.column("__letter").to_numpy(zero_copy_only=False), bool)
            score = np.where(letter, p[np.arange(len(best)), best], 0.0)
            names = [n for n in batch.schema.names if not n.startswith("__")]
            lang = [model.langs[i] if ok else UNKNOWN for i, ok in zip(best, letter)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(lang, pa.string()), pa.array(score),
                                              pa.array(~letter | (score < model.reject_below))], names=[*names, "lang_pred", "score", "rejected"])

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    rows = docs.select(*keep, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    if model is None:
        return rows.drop("__text").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    rows = rows.withColumn("__letter", F.col("__text").rlike(r"\p{L}"))
    fields = [f for f in rows.schema.fields if not f.name.startswith("__")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{ddl}, lang_pred string, score double, rejected boolean")


def keep_languages(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with the columns of ``docs`` and their values, however they are named. Each text goes to
    the worker once, and only kept rows come back; without a model, or rows, none are."""
    if model is None:
        return docs.limit(0)
    at = f"c{docs.columns.index(text_col)}"
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    schema = rows.schema
    rows = rows.filter(F.col(at).rlike(r"\p{L}"))  # a null text has no letter either

    def run(batches):
        for batch in chunks(batches, at, KEPT_CHUNK):
            p = model.probabilities(*utf8(batch.column(at)))
            yield batch.filter(pa.array(p.max(axis=1) >= model.reject_below))

    return rows.mapInArrow(freeing(run), schema).toDF(*docs.columns)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit_languages(docs.filter(~out))
    scored = predict_languages(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
