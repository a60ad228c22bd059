"""Conversation structure repair by iterative-deepening A*.

A conversation is well formed if the first letters of its roles spell ``(s?(ua)+)?``. Edits, in ASCII order: Delete 3,
Insert an empty user or assistant turn 2, Keep 0, Rerole to user or assistant 2; blank turns and repeats must be deleted,
a truncated turn that stays costs 1 more. An automaton of four states reads the roles, and in each state only one
role can be inserted or reroled to, so the string of edits says all.

``search`` goes depth first in ASCII order under a cost bound that rises from a lower bound until a path accepts; a table
keeps, for each (row, state), the largest budget that failed. The first accepting path is then both cheapest and
ASCII-least. Lower bound: what every row costs at least, and 2 for each of a set of disjoint neighbours whose roles
cannot follow each other (one of them changes or something goes between).

Conversations of more than ``BLOCK`` turns are searched block by block, for each state before and after a block, and
the blocks are joined from the end: the cheapest sum, and among equal sums the least string. That is exact: a block's
string ends with the edit of its last row, so of two of them neither is the beginning of the other.

Most conversations are bounded and meet in one task, sorted. Those of more than ``LONG_ROWS`` turns or ``LONG_BYTES``
of text take another way: their rows are numbered in a range-partitioned order that splits any key, repeats are
found by aggregates with map-side combine, and blocks are searched apart. Only the joining of block results
and the digest pass a long conversation through one task, as a stream: a digest of its whole text cannot be made otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfcast.session import materialise

from .rows import chunks, numbered

BLOCK = 64
LONG_ROWS, LONG_BYTES = 10_000, 32 << 20
INK = r"[^\x20\x09-\x0D]"
SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT, JOINT = 3, 2, 2, 1, 2

# states: 0 nothing yet, 1 after s, 2 after u, 3 after a; conversations end in 0 or 3
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FILL = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
TAIL = (0, 4, 2, 0)  # what a state lacks at the end
LEGAL = ("su", "ua", "au")


def symbol(role: Column, text: Column) -> Column:
    """One letter per turn: d must go; else s, u, a or x (any other role), as a capital if the text is cut off."""
    end = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    first = F.substring(role, 1, 1)
    letter = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    return F.when(end == "", "d").otherwise(F.when(end.isin(".", "!", "?"), letter).otherwise(F.upper(letter)))


def _bounds(turns: str, goal: int | None) -> list[tuple[int, int, str]]:
    """From each row on: a lower bound, one for a state that the next lasting row cannot follow, and that row's letter."""
    n = len(turns)
    if goal in (0, 1):  # nothing, or one s, is left of a block
        return [(max(0, DELETE * (n - i) - (DELETE if goal else 0)),) * 2 + ("",) for i in range(n + 1)]
    out = [(0, 0, "")] * (n + 1)
    for i in range(n - 1, -1, -1):
        c = turns[i]
        if c == "d":
            low, off, letter = out[i + 1]
            out[i] = (low + DELETE, off + DELETE, letter)
            continue
        least = min(DELETE, (CUT if c.isupper() else 0) + (REROLE if c in "xX" else 0))
        low, off, after = out[i + 1]
        clash = c not in "xX" and (after != "" and after not in "xX" and (c + after).lower() not in LEGAL)
        if after == "" and goal is None and c not in "xXaA":
            out[i] = (least + low + JOINT, least + low + JOINT, c)
        else:
            out[i] = (least + (max(low, off) if clash else low), least + low + (0 if c in "xX" else JOINT), c)
    return out


def search(turns: str, start: int, goal: int | None) -> tuple[int, str] | None:
    """Cost and edits from state ``start``; to state ``goal`` right behind the last row, or to the end of a conversation if None."""
    n, low = len(turns), _bounds(turns, goal)
    if goal in (0, 1) and (start > 1 or start > goal or (start < goal and not any(c in "sS" for c in turns))):
        return None
    failed: dict[tuple[int, int], int] = {}

    def least(i: int, s: int) -> int:
        plain, off, letter = low[i]
        if letter:
            return off if off > plain and letter not in "xX" and (s, letter.lower()) not in STEP else plain
        return plain + (TAIL[s] if goal is None else 0)

    def walk(i: int, s: int, left: int) -> str | None:
        if i == n and (s == goal or (goal is None and s in (0, 3))):
            return ""
        if least(i, s) > left or failed.get((i, s), -1) >= left:
            return None
        if i < n and left >= DELETE and (rest := walk(i + 1, s, left - DELETE)) is not None:
            return "D" + rest
        if (i < n or goal is None) and left >= INSERT and (rest := walk(i, FILL[s], left - INSERT)) is not None:
            return "I" + rest
        if i < n and (c := turns[i]) != "d":
            cut = CUT if c.isupper() else 0
            to = STEP.get((s, c.lower()))
            if to is not None and left >= cut and (rest := walk(i + 1, to, left - cut)) is not None:
                return "K" + rest
            if left >= cut + REROLE and (rest := walk(i + 1, FILL[s], left - cut - REROLE)) is not None:
                return "R" + rest
        failed[i, s] = left
        return None

    bound = least(0, start)
    while (found := walk(0, start, bound)) is None:
        bound += 1
    return bound, found


@lru_cache(maxsize=20_000)
def whole(turns: str) -> tuple[int, str]:
    """A conversation of up to ``BLOCK`` turns."""
    return search(turns, 0, None)


@lru_cache(maxsize=2_000)
def block_table(turns: str, last: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, edits) of a block; the last one runs to the end, which counts as state 0."""
    ways = [(s, e, search(turns, s, None if last else e)) for s in range(4) for e in ((0,) if last else range(4))]
    return tuple((s, e, *found) for s, e, found in ways if found is not None)


def join_blocks(tables) -> tuple[int, list[tuple[int, str]]]:
    """Cheapest cost from state 0, and (state before, edits) of each block in order; ``tables`` come last block first."""
    best: dict[int, tuple] = {0: (0, None)}  # state -> cost from here on, chain of (state before, edits, chain)
    for table in tables:
        now: dict[int, tuple] = {}
        for s, e, cost, edits in table:
            if e in best:
                way = (cost + best[e][0], edits)
                if s not in now or way < now[s][0]:
                    now[s] = (way, (s, edits, best[e][1]))
        best = {s: (way[0], chain) for s, (way, chain) in now.items()}
    cost, chain = best[0]
    parts = []
    while chain is not None:
        parts.append((chain[0], chain[1]))
        chain = chain[2]
    return cost, parts


def repair_string(turns: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation, given a letter per turn."""
    if len(turns) <= BLOCK:
        return whole(turns)
    cuts = range(0, len(turns), BLOCK)
    cost, parts = join_blocks(block_table(turns[i:i + BLOCK], i + BLOCK >= len(turns)) for i in reversed(cuts))
    return cost, "".join(edits for _, edits in parts)


def apply_edits(rows, edits: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every turn that stays or is new; ``rows`` yields (role, text), ``state`` is the one before."""
    rows = iter(rows)
    for e in edits:
        if e == "I":
            state = FILL[state]
            yield e, ROLE[state], ""
            continue
        role, text = next(rows)
        if e == "K":
            state = STEP[state, role[0]]
            yield e, role, text
        elif e == "R":
            state = FILL[state]
            yield e, ROLE[state], text


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, edit string, role string, text string"


def _grouped(batches, key: str, text: str):
    """Rows of sorted batches, one group at a time, as (key, iterator); the iterator must be used up first."""
    rows = (r for b in batches for part in chunks([b], text) for r in part.to_pylist())
    row = next(rows, None)
    while row is not None:
        now, held = row[key], [row]

        def group():
            nonlocal row
            while held:
                yield held.pop()
                nxt = next(rows, None)
                if nxt is not None and nxt[key] == now:
                    held.append(nxt)
                else:
                    row = nxt

        yield now, group()


def _shape(conv_type, rest: str) -> tuple[str, list[str], list[pa.DataType]]:
    """DDL, names and Arrow types of result rows that begin with the conversation id."""
    fields = [x.strip().split(" ") for x in rest.split(",")]
    kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in fields]
    return f"conv_id {conv_type.simpleString()}, {rest}", ["conv_id", *[n for n, _ in fields]], [to_arrow_type(conv_type), *kinds]


def _batches(rows, names: list[str], types: list[pa.DataType], most: int = 4 << 20):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 100 + sum(len(x) for x in r if isinstance(x, str))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _repair_group(conv, rows, want_turns: bool):
    """All of one bounded conversation."""
    turns, kept, seen, at, firsts = [], [], set(), [], []
    blank = duplicate = truncated = 0
    for r in rows:
        if r["lost"]:
            continue
        letter = r["letter"]
        if letter == "d":
            blank += 1
        elif r["tie"] in seen:
            duplicate, letter = duplicate + 1, "d"
        elif letter.isupper():
            truncated += 1
        seen.add(r["tie"])
        turns.append(letter)
        kept.append((r["role"], r["text"]))
        firsts.append(r["role"][:1])
        if r["turn"] is not None:
            at.append(r["turn"])
    cost, edits = repair_string("".join(turns))
    done = list(apply_edits(kept, edits, 0))
    if want_turns:
        return [(conv, i, *x) for i, x in enumerate(done)]
    gaps = at[-1] - at[0] + 1 - len(set(at)) if at else 0
    illegal = sum(a + b not in LEGAL for a, b in zip(firsts, firsts[1:]))
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in done).encode()).hexdigest()
    return [(conv, gaps, blank, duplicate, truncated, illegal, cost, edits, digest)]


def _bounded(rows: DataFrame, conv_type, want_turns: bool) -> DataFrame:
    ddl, names, kinds = _shape(conv_type, TURNS if want_turns else COUNTS)

    def run(batches):
        found = (x for conv, group in _grouped(batches, "conv_id", "text") for x in _repair_group(conv, group, want_turns))
        yield from _batches(found, names, kinds)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "tie")
    return dealt.mapInArrow(run, ddl)


def _long(rows: DataFrame, conv_type, want_turns: bool) -> DataFrame:
    """Conversations of any length; see the head of this module."""
    key = conv_type.simpleString()
    salted = materialise(rows.where("not lost").withColumn("salt", F.monotonically_increasing_id()), "long-turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tie"), F.col("salt")]
    placed = materialise(numbered(salted, order, "at").withColumn("block", F.floor(F.col("at") / BLOCK)), "long-placed")
    narrow = placed.select("conv_id", "at", "block", "turn", "letter", F.substring("role", 1, 1).alias("first"))
    once = placed.groupBy("conv_id", "tie").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    after = narrow.select((F.col("at") - 1).alias("at"), F.col("conv_id").alias("next_conv"), F.col("first").alias("next"))
    marked = narrow.join(once, "at", "left").join(after, "at", "left")
    follows = F.col("next").isNotNull() & F.col("conv_id").eqNullSafe(F.col("next_conv"))
    new = F.col("new").isNotNull()
    marked = materialise(marked.select(
        "conv_id", "at", "block", "turn", (F.col("letter") == "d").alias("blank"), ((F.col("letter") != "d") & ~new).alias("duplicate"),
        F.when(new, F.col("letter")).otherwise("d").alias("letter"), (~follows).alias("last"),
        (follows & ~F.concat("first", "next").isin(*LEGAL)).alias("illegal")), "long-marked")
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = marked.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"), F.count_if("blank").alias("blank"), F.count_if("duplicate").alias("duplicate"),
        F.count_if(F.col("letter").rlike("[A-Z]")).alias("truncated"), F.count_if("illegal").alias("illegal"))
    blocks = marked.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("at", "letter"))).alias("rows"), F.max("last").alias("last"))
    blocks = blocks.select("conv_id", "block", F.array_join(F.col("rows.letter"), "").alias("turns"), "last")
    way = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])

    def solve(batches):
        for b in batches:
            tables = [[dict(zip(("before", "after", "cost", "edits"), w)) for w in block_table(t, last)]
                      for t, last in zip(b.column("turns").to_pylist(), b.column("last").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(tables, pa.list_(way)), pa.array([""] * b.num_rows)],
                                             names=["conv_id", "block", "ways", "text"])

    ways = blocks.mapInArrow(solve, f"conv_id {key}, block long, ways array<struct<before: int, after: int, cost: bigint, edits: string>>, text string")
    backwards = ways.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))

    part_ddl, part_names, part_kinds = _shape(conv_type, "block long, state long, cost long, edits string")

    def fold(batches):
        def parts():
            for conv, group in _grouped(batches, "conv_id", "text"):
                numbers = []

                def tables():
                    for r in group:
                        numbers.append(r["block"])
                        yield [(w["before"], w["after"], w["cost"], w["edits"]) for w in r["ways"]]

                cost, found = join_blocks(tables())
                for n, (state, edits) in zip(reversed(numbers), found):
                    yield conv, n, state, cost, edits

        yield from _batches(parts(), part_names, part_kinds)

    chosen = materialise(backwards.mapInArrow(fold, part_ddl), "long-edits")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    edited = placed.select("conv_id", "block", "at", "role", "text").join(
        chosen.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "state", "cost", "edits"), same).drop("c", "b")
    ordered = edited.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    ddl, names, kinds = _shape(conv_type, TURNS if want_turns else "cost long, audit string, repaired_sha256 string")

    def finish(batches):
        def out():
            for conv, group in _grouped(batches, "conv_id", "text"):
                digest, audit, place, cost, block, held = hashlib.sha256(), [], 0, 0, None, []

                def close():
                    for edit, role, text in apply_edits([(h["role"], h["text"]) for h in held], held[0]["edits"], held[0]["state"]):
                        yield place, edit, role, text

                for r in (x for part in (group, [None]) for x in part):
                    if r is None or r["block"] != block:
                        for _, edit, role, text in close() if held else ():
                            digest.update((b"\n" if place else b"") + f"{role}:{text}".encode())
                            if want_turns:
                                yield conv, place, edit, role, text
                            place += 1
                        held = []
                        if r is None:
                            break
                        block, cost = r["block"], r["cost"]
                        audit.append(r["edits"])
                    held.append(r)
                if not want_turns:
                    yield conv, cost, "".join(audit), digest.hexdigest()

        yield from _batches(out(), names, kinds)

    done = ordered.mapInArrow(finish, ddl)
    if want_turns:
        return done
    both = counts.join(done.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return both.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@dataclass(frozen=True)
class Repaired:
    """``conversations``: one row each, with counts, cost, edits and a digest; ``turns()``: the repaired turns themselves."""

    rows: DataFrame
    long_keys: DataFrame | None

    def _run(self, want_turns: bool) -> DataFrame:
        conv_type = self.rows.schema["conv_id"].dataType
        if self.long_keys is None:
            return _bounded(self.rows, conv_type, want_turns)
        is_long = F.col("conv_id").eqNullSafe(F.col("long_conv"))
        short = self.rows.join(self.long_keys, is_long, "left_anti")
        long = self.rows.join(self.long_keys, is_long, "left_semi")
        return _bounded(short, conv_type, want_turns).unionByName(_long(long, conv_type, want_turns))

    @property
    def conversations(self) -> DataFrame:
        return self._run(False)

    def turns(self) -> DataFrame:
        return self._run(True)


def repair_conversations(turns: DataFrame, lost: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> Repaired:
    """Judge and repair every conversation.

    Turns stand in the order of ``turn``, nulls first; turns with the same number in that of a hash of role and text,
    so that the order of rows does not matter. A null role or text is one space, hence a turn without text is blank;
    rows without a conversation id are one conversation. Rows for which ``lost`` holds are not looked at, but their
    conversation is listed: with zeros, no edits and the digest of nothing if it has no other. Other columns are left
    out, whatever their names. An empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (role_col, text_col))
    gone = F.coalesce(lost, F.lit(False)) if lost is not None else F.lit(False)
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("lost"))
    tie = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text").cast("binary"), 256)
    rows = rows.select("conv_id", "turn", "lost", *[F.when(~F.col("lost"), x).otherwise("").alias(n) for n, x in (
        ("role", F.col("role")), ("text", F.col("text")), ("letter", symbol(F.col("role"), F.col("text"))), ("tie", tie))])
    sizes = rows.where("not lost").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = sizes.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("long_conv"))
    return Repaired(rows, None if long.isEmpty() else materialise(long, "long-conversations"))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after damage, ``lost`` marking those that are dropped; null keys count as one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("k"))
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       (F.col("k") == 0).alias("lost"), F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def op11_turn_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation after damage, judged and repaired; nulls, ties, lost and empty conversations as ``repair_conversations`` says."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_conversations(damaged(turns), F.col("lost")).conversations
