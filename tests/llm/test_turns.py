"""Conversation repair against a plain shortest path over all edits."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from shelfcast.llm import turns as T  # noqa: E402
from shelfcast.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def spark():
    return build_session("llm-tests", master="local[4]", shuffle_partitions=4, driver_memory="4g")


def plain_repair(turns, start=0, ends=(0, 3)):
    """Cheapest and then least string, by the definition: from the end, over (row, state); inserts relax until nothing changes."""
    go = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    nxt = {s: (0, "") for s in ends}
    for i in range(len(turns), -1, -1):
        now = dict(nxt) if i == len(turns) else {}
        if i < len(turns):
            for s in range(4):
                ways = []
                if s in nxt:
                    ways.append((nxt[s][0] + 3, "D" + nxt[s][1]))
                if turns[i] != "d":
                    cut = turns[i].isupper()
                    for letter, cost, name in [(turns[i].lower(), 0, "K"), ("u", 2, "R"), ("a", 2, "R")]:
                        t = go.get((s, letter))
                        if t in nxt:
                            ways.append((nxt[t][0] + cost + cut, name + nxt[t][1]))
                if ways:
                    now[s] = min(ways)
        for _ in range(4):
            for s in range(4):
                for letter in "ua":
                    t = go.get((s, letter))
                    if t in now:
                        way = (now[t][0] + 2, "I" + now[t][1])
                        now[s] = min(now.get(s, way), way)
        nxt = now
    return nxt[start]


def random_turns(r, n):
    odd = r.choice([0.02, 0.2, 0.6])
    letters, out = "ua" * n, []
    for c in letters[:n]:
        c = r.choice("suaxd") if r.random() < odd else c
        out.append(c.upper() if c != "d" and r.random() < odd else c)
    return "".join(out)


def test_search_equals_plain_shortest_path():
    r = random.Random(3)
    cases = ["", "u", "a", "s", "S", "x", "X", "d", "ss", "sa", "su", "sua", "suaa", "uu", "aa", "au", "UA", "Aa"]
    cases += [random_turns(r, r.randint(1, 20)) for _ in range(1500)] + [random_turns(r, 64) for _ in range(20)]
    for t in cases:
        assert T.whole(t) == plain_repair(t), t


def test_lower_bound_never_exceeds_the_cost():
    r = random.Random(5)
    for _ in range(400):
        t = random_turns(r, r.randint(1, 12))
        assert T._bounds(t, None)[0][0] <= plain_repair(t)[0]


def test_blocks_join_exactly(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 5)
    r = random.Random(6)
    for _ in range(300):
        t = random_turns(r, r.randint(6, 60))
        assert T.repair_string(t) == plain_repair(t), t
    monkeypatch.undo()
    t = random_turns(r, 700)
    assert T.repair_string(t) == plain_repair(t)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain(rows, damaged=True):
    """The contract row by row."""
    left = damage(rows) if damaged else rows
    out = []
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in left if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        at = [t for t, _, _ in mine if t is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        seen, letters, count = set(), [], dict.fromkeys(("blank", "dup", "cut"), 0)
        for _, role, text in mine:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not ink:
                count["blank"], letter = count["blank"] + 1, "d"
            elif (role, text) in seen:
                count["dup"], letter = count["dup"] + 1, "d"
            elif ink[-1] not in ".!?":
                count["cut"], letter = count["cut"] + 1, letter.upper()
            seen.add((role, text))
            letters.append(letter)
        first = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        cost, edits = plain_repair("".join(letters))
        todo, state, text = iter(mine), "", []
        for e in edits:
            role = "assistant" if state == "u" else "user"
            if e == "I":
                text.append(f"{role}:")
            else:
                _, r, t = next(todo)
                if e == "D":
                    continue
                role = r if e == "K" else role
                text.append(f"{role}:{t}")
            state = role[0]
        out.append((conv, gaps, count["blank"], count["dup"], count["cut"], illegal, cost, edits, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query_equals_plain_repair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = T.op11_turn_repair(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def odd_rows():
    r = random.Random(9)
    rows = [(1, i, r.choice(["user", "assistant", "system", "tool", ""]), r.choice(["Yes.", "No", " ", "Maybe?\n", "é"])) for i in range(150)]
    rows += [(2, None, "user", "a."), (2, None, "user", "a."), (2, None, None, "b."), (2, 5, "assistant", None), (2, 5, "assistant", "c!"), (2, 5, "user", "c!")]
    rows += [(None, 0, "user", "n."), (None, 3, "assistant", "n"), (3, None, "s", "x.\x0b\x1c"), (4, 0, "user", ""), (5, 1, "user", "long " * 50_000)]
    rows += [(6, 2, "user", "same.")] * 400 + [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(10, 80) for t in range(c % 5)]
    gone = [(c, 7, "user", "gone.") for c in range(1000, 1400) if zlib.crc32(f"{c}:7".encode()) % 20 == 0]
    assert gone
    return rows + gone


@pytest.mark.parametrize("long_rows", [10_000, 3])
def test_nulls_ties_repeats_and_both_ways(spark, long_rows):
    """Short and long conversations give the same rows by either way; extra columns with clashing names are left out."""
    rows = odd_rows()
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], SCHEMA + ", cost int, audit string").repartition(5)
    done = T.repair_conversations(T.damaged(df), F.col("lost"), long_rows=long_rows)
    assert (done.long_keys is None) == (long_rows > 3)
    assert sorted(map(tuple, done.conversations.collect()), key=repr) == plain(rows)
    whole = T.repair_conversations(df, long_rows=long_rows)
    want = {r[0]: r[-1] for r in plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], damaged=False)}
    for conv in (1, 2, None, 3, 4, 6, 41):
        mine = sorted((r["place"], f"{r['role']}:{r['text']}") for r in whole.turns().where(F.col("conv_id").eqNullSafe(F.lit(conv))).collect())
        assert hashlib.sha256("\n".join(t for _, t in mine).encode()).hexdigest() == want[conv]
        assert [p for p, _ in mine] == list(range(len(mine)))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert T.repair_conversations(T.damaged(none), F.col("lost")).conversations.collect() == []
