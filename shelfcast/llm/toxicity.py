"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters. A written lexicon of insults (``INSULTS``) votes whatever the labels say. From a bounded sample of labelled rows
   (``MAX_ROWS``; half of each class where there are enough) words and word beginnings that the toxic class favours become
   further lexicon voters; shouting, repeated marks and the lack of any lexicon hit are pattern voters. A voter votes or abstains.
2. Label model. Over the vote patterns of every row, labelled or not, counted on the executors, EM estimates the prior and, for each voter, how often it
   votes in either class; labelled rows start it off. Voters that go together within a class are correlated: the
   residuals' correlations give each voter a weight of one over the votes it shares, so that ten voters for one
   word count as one.
3. Classifier. Logistic regression on the posteriors of the sample and of about half as many unlabelled rows, over the same vocabulary and
   the patterns; its intercept is moved so that 0.7 parts the posterior classes of all rows best. Written insults
   that these rows lack get the mean weight of those they have.

Scoring needs no shuffle: the model is a small dictionary, and every row's whole text is read once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .langid import held_out
from .rows import chunks

MAX_ROWS, VOTERS, SUPPORT, FALSE, ENOUGH, CUT = 6_000, 600, 4, 0.05, 4, 0.7
WORD = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"\b[A-Z]{3,}\b")
MARKS = re.compile(r"[!?]{3,}")
PATTERNS = ("#shout", "#marks")  # the label model also has a voter for the lack of any hit
START = (4, 5)

#: Everyday insults, in their dictionary forms. Replace them by an argument for other domains and languages.
INSULTS = ("airhead bastard bigot bimbo bitch blockhead bonehead brainless buffoon bum clown contemptible coward creep cretin crybaby degenerate despicable "
           "dimwit dirtbag disgrace disgusting dolt dope dork douche dumb dumbass dummy dunce fool freak garbage halfwit hideous hypocrite idiot idiotic "
           "idiots imbecile imbecilic jackass jerk knucklehead laughable liar loathsome loser losers lowlife lunatic maggot maniac miserable moron moronic morons "
           "nitwit numbskull obnoxious parasite pathetic pig psycho punk rat repulsive rubbish scum scumbag shameful sicko simpleton skank slob sleazy slut snake "
           "spineless stupid stupidity sucker swine thug tosser trash traitor twat twit useless vermin vile weakling weasel whore wimp worthless wretch").split()


def terms(text: str) -> set[str]:
    """Words in lower case and their beginnings: ``stem*`` where one word of the text has that stem, ``stem*2`` and ``stem*4``
    where so many different ones have it, as families of inflected insults do."""
    words = set(WORD.findall(text.lower()))
    stems = Counter(w[:n] for n in START for w in words if len(w) > n)
    out = words | {s + "*" for s in stems}
    for s, k in stems.items():
        if k >= 2:
            out.add(s + "*2")
            if k >= 4:
                out.add(s + "*4")
    return out


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    stems: frozenset[str]

    def score(self, text: str) -> float:
        get, found = self.weights.get, set(WORD.findall(text.lower()))
        stems = Counter(s for w in found for n in START if len(w) > n and (s := w[:n]) in self.stems)
        hits = [v for w in found if (v := get(w)) is not None]
        for s, k in stems.items():
            hits += [v for at, tail in ((1, "*"), (2, "*2"), (4, "*4")) if k >= at and (v := get(s + tail)) is not None]
        z = self.bias + sum(sorted(hits))
        z += get("#shout", 0.0) * bool(SHOUT.search(text)) + get("#marks", 0.0) * bool(MARKS.search(text))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def likelihood_ratio(a: int, n1: int, c: int, n0: int) -> float:
    """Twice the log likelihood gained by telling the rates a of n1 and c of n0 apart."""
    whole = (a + c) / (n1 + n0)
    return 2 * (a * np.log(a / (n1 * whole)) + (c * np.log(c / (n0 * whole)) if c else 0.0))


def pick_voters(sets: list[set[str]], y: np.ndarray) -> list[str]:
    """Terms that go with class 1 beyond chance, the strongest first.

    The ratio a term must exceed grows with the number of terms tried, so that chance lets ``FALSE`` terms pass at most. Each term
    must also reach it on the rows that fewer than ``ENOUGH`` stronger terms explain: words that merely stand in copies of a toxic
    text do not.
    """
    toxic, clean = Counter(), Counter()
    for s, label in zip(sets, y):
        (toxic if label else clean).update(s)
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    ratio = {t: likelihood_ratio(a, n1, clean[t], n0) for t, a in toxic.items() if a >= SUPPORT and a * n0 > 3 * clean[t] * n1}
    strong = 2 * np.log(max(1, sum(a + clean[t] >= SUPPORT for t, a in toxic.items()) + sum(c >= SUPPORT for t, c in clean.items() if t not in toxic)) / FALSE)
    ranked = sorted((t for t, g in ratio.items() if g > strong), key=lambda t: (-ratio[t], t))
    where = {t: [] for t in ranked}
    for i, (s, label) in enumerate(zip(sets, y)):
        if label:
            for t in s & where.keys():
                where[t].append(i)
    cover, out = np.zeros(len(sets), int), []
    for t in ranked:
        rows = np.array(where[t])
        fresh = int((cover[rows] < ENOUGH).sum())
        if fresh >= SUPPORT and likelihood_ratio(fresh, n1, clean[t], n0) > strong:
            cover[rows] += 1
            out.append(t)
    return out[:VOTERS]


def outweighed(clean, toxic):
    """Whether a share of class 1 is less than three times that of class 0; two shares of zero are not."""
    return 3 * clean > toxic


def contradicted(term: str, sets: list[set[str]], y: np.ndarray) -> bool:
    """Whether labelled rows of class 1 have the term less than three times as often as those of class 0, as with a word that is
    harmless in another language. A term that no row of class 0 has is not contradicted."""
    has = np.array([term in s for s in sets])
    return bool(outweighed(has[y == 0].mean(), has[y == 1].mean()))


def voted(text: str, at: dict[str, int]) -> list[int]:
    """The voters of ``at`` that vote for a text, in ascending order; shouting and marks are the last two."""
    out = [k for t in terms(text) if (k := at.get(t)) is not None]
    return sorted(out) + [len(at)] * bool(SHOUT.search(text)) + [len(at) + 1] * bool(MARKS.search(text))


def vote_patterns(rows: DataFrame, marks: DataFrame, voters: list[str]) -> DataFrame:
    """``pattern, y, n``: how many rows of ``id, text`` have these votes and label (-1: none)."""
    at = {t: k for k, t in enumerate(voters)}

    def run(batches):
        for batch in chunks(batches, "text"):
            found = pa.array([voted(t, at) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], names=["id", "pattern"])

    marked = rows.mapInArrow(run, "id long, pattern array<int>").join(marks, "id", "left")
    return materialise(marked.groupBy("pattern", F.coalesce(F.col("y").cast("int"), F.lit(-1)).alias("y")).agg(F.count(F.lit(1)).alias("n")), "vote-patterns")


@dataclass(frozen=True)
class LabelModel:
    """Posteriors of vote patterns. ``kept`` are the voters in use; the last voter, for the lack of any lexicon hit, is implied."""

    kept: np.ndarray
    base: float = 0.0
    gain: np.ndarray | None = None

    def matrix(self, patterns: list[list[int]]) -> np.ndarray:
        v = np.zeros((len(patterns), len(self.kept) + 1))
        for i, pattern in enumerate(patterns):
            v[i, pattern] = 1.0
        v[:, :-1] *= self.kept
        v[:, -1] = 1.0 - v[:, :-3].max(axis=1, initial=0.0)
        return v

    def posterior(self, v: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.gain is None:
            return np.where(y == 1, 0.98, np.where(y == 0, 0.02, 0.1))
        z = self.base + v @ self.gain + np.where(y == 1, 2.0, np.where(y == 0, -2.0, 0.0))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sums(patterns: DataFrame, model: LabelModel, of, size: int) -> np.ndarray:
    """The sum over all patterns of ``of(v, y, q, n)``, an array of ``size`` numbers for each step of rows."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                v, y = model.matrix(part.column("pattern").to_pylist()), part.column("y").to_numpy()
                total += of(v, y, model.posterior(v, y), part.column("n").to_numpy().astype(np.float64))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.float64())], names=["k", "x"])

    out = np.zeros(size)
    for r in patterns.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow().to_pylist():
        out[r["k"]] = r["x"]
    return out


def label_model(patterns: DataFrame, kept: np.ndarray, rounds: int = 15) -> LabelModel:
    """EM over all rows; labelled rows start it off and count on as evidence."""
    m, model = len(kept) + 1, LabelModel(kept)
    weight = np.ones(m)

    def step(known):
        def of(v, y, q, n):
            n = n * (y >= 0) if known else n
            a = n * q
            return np.concatenate([[n.sum(), a.sum(), (a * q).sum()], a @ v, n @ v])
        return of

    for i in range(rounds):
        got = sums(patterns, model, step(i == 0), 3 + 2 * m)
        n, a, aa, s1, s = *got[:3], got[3:3 + m], got[3 + m:]
        rate1 = (s1 + 0.5) / (a + 1)
        rate0 = (s - s1 + 0.5) / (n - a + 1)
        prior = float(np.clip(a / n, 1e-3, 1 - 1e-3))
        if i == 1:  # correlations of what the classes do not explain
            both = sums(patterns, model, lambda v, y, q, n: (v.T @ (v * n[:, None])).ravel(), m * m).reshape(m, m)
            one, zero = np.outer(s1, rate1), np.outer(s - s1, rate0)
            mixed = np.outer(rate1, rate0)
            rest = both - one - one.T - zero - zero.T + aa * np.outer(rate1, rate1) + (a - aa) * (mixed + mixed.T) + (n - 2 * a + aa) * np.outer(rate0, rate0)
            scale = np.sqrt(np.maximum(np.diag(rest), 0) / n) + 1e-6
            corr = rest / n / np.outer(scale, scale)
            weight = 1 / np.maximum(1.0, np.where(corr > 0.3, corr, 0).sum(axis=1))
        yes, no = np.log(rate1 / rate0) * weight, np.log((1 - rate1) / (1 - rate0)) * weight
        use = np.append(kept, True)
        model = LabelModel(kept, float(np.log(prior / (1 - prior)) + no[use].sum()), np.where(use, yes - no, 0.0))
    return model


def logistic(x: np.ndarray, q: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept on soft labels, both classes weighing the same; accelerated gradient steps."""
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = np.zeros_like(w), 0.0
    share = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
    each = (q / share + (1 - q) / (1 - share)) / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ (w + 0.9 * vw) + b + 0.9 * vb, -30, 30)))
        g = (p - q) * each / len(q)
        vw = 0.9 * vw - 1.0 * (x.T @ g + ridge * w)
        vb = 0.9 * vb - 1.0 * g.sum()
        w, b = w + vw, b + vb
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 lexicon: Sequence[str] = INSULTS) -> ToxicityModel:
    """A model from a sample of labelled and unlabelled rows and the vote patterns of all. A document with several labels takes the largest; null labels count as
    none. Without a label of each class every score is 0.5 at most. Words of the lexicon vote unless the labelled rows of class 1 have
    them less than three times as often as those of class 0, as with a word that is harmless in another language."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("y")).filter("id is not null and y is not null")
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 20)) / float(1 << 20)
    half = MAX_ROWS / 2
    share = F.when(F.col("y") == 1, F.lit(min(1.0, half / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, half / max(1, counts.get(0, 0)))))
    picked = marks.filter(draw < share).limit(MAX_ROWS)
    labelled = rows.join(picked, "id").select("text", "y").limit(MAX_ROWS).toArrow().to_pylist()
    few = F.lit(min(1.0, MAX_ROWS / 2 / max(1, rows.count())))
    free = rows.filter(F.pmod(F.xxhash64(F.lit(12), "id"), F.lit(1 << 20)) / float(1 << 20) < few)
    unlabelled = free.join(marks, "id", "left_anti").select("text").limit(MAX_ROWS).toArrow().to_pylist()
    texts = [r["text"] for r in labelled] + [r["text"] for r in unlabelled]
    y = np.array([int(r["y"]) for r in labelled] + [-1] * len(unlabelled), int)
    if not ((y == 1).any() and (y == 0).any()):
        return ToxicityModel({}, -2.0, frozenset())
    pool: dict[str, str] = {}  # one string for each term
    sets = [{pool.setdefault(t, t) for t in terms(r["text"])} for r in labelled]
    written = sorted({t.lower() for t in lexicon})
    learnt = pick_voters(sets, y[y >= 0])
    del sets, pool
    voters = written + [t for t in learnt if t not in set(written)]
    size = len(voters) + 2
    patterns = vote_patterns(rows, marks, voters)
    everyone = LabelModel(np.ones(size, bool))
    has = sums(patterns, everyone, lambda v, y, q, n: np.concatenate([np.append((n * (y == k)) @ v, (n * (y == k)).sum()) for k in (0, 1)]), 2 * (size + 2)).reshape(2, -1)
    of0, of1 = has[0] / max(1, has[0, -1]), has[1] / max(1, has[1, -1])
    kept = np.ones(size, bool)
    kept[:len(written)] = ~outweighed(of0, of1)[:len(written)]
    model = label_model(patterns, kept)
    at = {t: k for k, t in enumerate(voters)}
    v = model.matrix([voted(t, at) for t in texts])
    x = v[:, :-1]
    w, b = logistic(x, model.posterior(v, y))
    seen, own = x.any(axis=0), np.arange(size) < len(written)
    if (own & kept & ~seen).any():  # no evidence of their own
        like = next((w[k] for k in (own & seen, seen & (np.arange(size) < len(voters))) if k.any()), np.array([np.log(CUT / (1 - CUT)) - b]))
        w = np.where(own & kept & ~seen, max(0.0, float(like.mean())), w)
    score = lambda v: 1 / (1 + np.exp(-np.clip(v[:, :-1] @ w + b, -30, 30)))
    cuts = np.quantile(score(v), np.linspace(0.02, 0.999, 400))

    def parted(v, y, q, n):
        place = np.searchsorted(cuts, score(v), side="right")
        return np.concatenate([np.bincount(place, n * (q >= 0.5), len(cuts) + 1), np.bincount(place, n * (q < 0.5), len(cuts) + 1)])

    hit, wrong = (np.cumsum(h[::-1])[::-1] for h in sums(patterns, model, parted, 2 * (len(cuts) + 1)).reshape(2, -1))
    f1 = 2 * hit[1:] / (hit[0] + hit[1:] + wrong[1:] + 1e-9)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    cut = float(np.clip(cuts[best[-1]], 1e-4, 1 - 1e-4))
    b += np.log(CUT / (1 - CUT)) - np.log(cut / (1 - cut))
    stems = frozenset(t.split("*")[0] for t in voters if "*" in t)
    return ToxicityModel(dict(zip([*voters, *PATTERNS], w.tolist())), float(b), stems)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: one row per row, over whole texts; null texts are empty."""

    def run(batches):
        for batch in chunks(batches, "text"):
            scores = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit_toxicity(docs.filter(~out), labels.filter(~out))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
