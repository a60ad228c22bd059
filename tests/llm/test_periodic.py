"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import sys
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from shelfcast.llm import periodic  # noqa: E402
from shelfcast.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"
SPACE = b" \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def spark():
    return build_session("llm-tests", master="local[4]", shuffle_partitions=4, driver_memory="4g")


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[:-q])


def plain_runs(words):
    """Every period in turn; a stretch counts where the period is its smallest."""
    out = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q) and smallest_period(words[i:j + q]) == q:
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating(r):
    """Words of a small alphabet with runs of periods short and long, also nested and side by side."""
    words = []
    for _ in range(r.randint(1, 6)):
        q = r.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 18, 23, 24, 25, 36, 37, 54, 55, 90])
        unit = [str(r.randint(0, r.choice([1, 3, 50]))) for _ in range(q)]
        if r.random() < 0.3:
            unit = unit[:max(1, q // 4)] * 4
        words += (unit * 6)[:r.randint(1, 5 * len(unit))] + [str(r.randint(0, 3)) for _ in range(r.randint(0, 9))]
    return words


def test_runs_equal_plain_search():
    r = random.Random(4)
    docs = [repeating(r) for _ in range(300)] + [[], ["a"], ["a"] * 24, ["a"] * 23, list("ab") * 40 + ["c"] + list("ab") * 40]
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for d in docs for w in d], np.int64)
    got = periodic.find_runs(ids, np.cumsum([0, *map(len, docs)]))
    assert got == [plain_runs(d) for d in docs]
    assert sum(map(len, got)) > 300 and max(q for d in got for _, _, q in d) >= 90


def test_wrong_hashes_do_not_matter(monkeypatch):
    monkeypatch.setattr(periodic, "_mix", lambda a, b: (a + b) & np.uint64(1))
    unit = [str(i) for i in range(30)]
    docs = [unit * 4 + ["x", "y"], ["z"] * 5]
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for d in docs for w in d], np.int64)
    out = periodic._extend(np.concatenate([ids, [1 << 62]]).astype(np.uint64), np.array([3, 4]), np.array([30, 30]))
    assert (0, 120, 30) in out


def digests(doc_id, text):
    words = [w for w in bytes(text or "", "utf-8").split() if w]
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
    sha = [hashlib.sha256(x).hexdigest() for x in ("".join("%d,%d,%d\n" % x for x in runs).encode(),
                                                   b" ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], *sha)


def test_query_equals_plain_search(spark):
    got = [tuple(r) for r in periodic.op13_periodic_runs(spark, SF).collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(got) == sorted(digests(*d) for d in docs)
    assert sum(r[1] for r in got) > 10


def test_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (None, "a b " * 30), (None, "a b " * 30), (4, "x\x1cy " * 24), (5, "  é " * 20),
             (33, "w " * 50), (60, " ".join(f"w{i % 4001}" for i in range(20_000)))]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in texts], "doc_id long, text string, n_runs int, runs string")
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    got = [tuple(r) for r in periodic.op13_periodic_runs(spark, path).collect()]

    def quick(doc):
        if doc[0] != 60:
            return digests(*doc)
        words = doc[1].split()
        line = "0,20000,4001\n"
        return (60, 1, 0, 20000, 4001, 20000 * 1000 // 4001, hashlib.sha256(line.encode()).hexdigest(),
                hashlib.sha256(" ".join(words[:4001]).encode()).hexdigest())

    assert zlib.crc32(b"60") % 10 != 0
    assert sorted(got, key=repr) == sorted(map(quick, texts), key=repr)
    rows = periodic.periodic_runs(docs).where("doc_id = 33").first()
    assert [tuple(x) for x in rows["runs"]] == [(0, 50, 1)] and rows["collapsed"] == "w"
    assert periodic.periodic_runs(docs.limit(0)).collect() == []
