"""Least-cost repair of a conversation's turns, by cost layers of reachable grammar states.

The grammar of the roles' initials is `(s?(ua)+)?`, an automaton of four states: 0 at the start, 1 after s, 2 after u,
3 after a; 0 and 3 accept. For each turn, from the last to the first, a layer for each cost holds the bitset of states
from which what remains can be accepted at that cost. All layers of a turn are one machine word of 16 nibbles, counted
from the turn's least cost, so an edit is a shift by its cost and a step of the automaton is a mask. 16 layers hold all:
from one state the rest never costs 13 more than from another, as two inserted turns and a deleted one lead from any
state to what any other can read. The first layer that has state 0 at the first turn gives the cost; reading the bits
forward from there, with the smallest letter that stays on the cost, gives the least audit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The state after user or assistant from each state; where each initial leads.
NEXT = (2, 2, 3, 2)
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
LAYERS = 16
ONES, FULL = int("1" * LAYERS, 16), (1 << 4 * LAYERS) - 1
BLANKS = " \t\n\x0b\x0c\r"
MADE = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def _before(layers: int, initial: str) -> int:
    """States from which a turn with this initial leads into the layers' states, in all layers at once."""
    if initial == "u":
        return (layers >> 2 & ONES) * 0b1011
    if initial == "a":
        return (layers >> 3 & ONES) << 2
    return layers >> 1 & ONES if initial == "s" else 0


def _spoken(layers: int) -> int:
    return _before(layers, "u") | _before(layers, "a")


def _inserted(layers: int) -> int:
    """With turns inserted here; a third would lead back to where the first led."""
    for _ in range(2):
        layers |= _spoken(layers) << 4 * INSERT & FULL
    return layers


def audit(turns: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and edits (D, I, K, R) of the least repair of turns (initial of the role, must go, truncated)."""
    layers, base = _inserted(0b1001 * ONES), 0
    words, bases = [layers], [0]
    for initial, must_go, cut in reversed(turns):
        new = layers << 4 * DELETE
        if not must_go:
            more = TRUNCATED if cut else 0
            new |= _before(layers, initial) << 4 * (KEEP + more) | _spoken(layers) << 4 * (REROLE + more)
        layers = _inserted(new & FULL)
        if layers >> 4 * (LAYERS - 1) != 0b1111:
            raise ValueError("a cost lies beyond the layers")
        while not layers & 0b1111:
            layers, base = layers >> 4 | 0b1111 << 4 * (LAYERS - 1), base + 1
        words.append(layers)
        bases.append(base)
    words.reverse()
    bases.reverse()

    def on(i: int, state: int, left: int) -> bool:
        k = left - bases[i]
        return k >= LAYERS or k >= 0 and bool(words[i] >> 4 * k + state & 1)

    cost = bases[0]
    while not on(0, 0, cost):
        cost += 1
    edits, i, state, left = [], 0, 0, cost
    while i < len(turns) or left:
        initial, must_go, cut = turns[i] if i < len(turns) else ("", True, False)
        more = TRUNCATED if cut else 0
        if i < len(turns) and on(i + 1, state, left - DELETE):
            edits.append("D")
            i, left = i + 1, left - DELETE
        elif on(i, NEXT[state], left - INSERT):
            edits.append("I")
            state, left = NEXT[state], left - INSERT
        elif not must_go and (to := STEPS.get(initial, {}).get(state)) is not None and on(i + 1, to, left - KEEP - more):
            edits.append("K")
            i, state, left = i + 1, to, left - KEEP - more
        else:
            edits.append("R")
            i, state, left = i + 1, NEXT[state], left - REROLE - more
    return cost, "".join(edits)


def repaired_turns(rows: list[tuple[str, str]], edits: str) -> list[dict]:
    """Turns (role, text) after the edits; their places say which role a new or changed one has."""
    out, i, state = [], 0, 0
    for e in edits:
        role, text = rows[i] if e != "I" else ("", "")
        i += e != "I"
        if e == "D":
            continue
        state = STEPS[role[:1]][state] if e == "K" else NEXT[state]
        out.append({"role": role if e == "K" else "user" if state == 2 else "assistant", "text": text})
    return out


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each turn (role, text): blank, duplicate, truncated, or none."""
    out, seen = [], set()
    for row in rows:
        text = row[1].strip(BLANKS)
        out.append("blank" if not text else "duplicate" if row in seen else "truncated" if text[-1] not in ".!?" else "")
        seen.add(row)
    return out


def repair(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and repaired turns of a conversation in order."""
    numbers = {t for t in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    found = faults(rows)
    initials = [r[0][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, edits = audit([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, found, strict=True)])
    return gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, repaired_turns(rows, edits)


def damage(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text) with the faults that crc32(`conv_id:turn`) % 20 deals; there is false where a
    turn is dropped. Nulls of role and text, and in the hashed string, are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("h"))
    h = F.col("h")
    text = F.when(h == 1, F.lit("")).when(h == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(h == 4, F.lit("user")).otherwise(F.col("role"))
    return dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), (h != 0).alias("there"), F.explode(F.array_repeat(F.lit(0), F.when(h == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation of `turns` (conv_id, turn, role, text, optionally there): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired (array of role, text).

    Turns are taken by turn, nulls first, then role and text, so rows in any order give one result. Null roles and texts
    are one space. Rows with `there` false only keep their conversation in the result; one without other rows has zeros,
    an empty audit and no turns. Rows without conv_id make one conversation. Other columns are ignored. Rows are dealt by
    conversation and sorted, and a task reads them as a stream: it holds one conversation at a time, takes time in
    proportion to it, and 24 bytes a turn for the layers. The repaired turns are one row, so they meet in one task; that
    is the result asked for.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    there = F.coalesce(F.col("there"), F.lit(True)) if "there" in turns.columns else F.lit(True)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), there.alias("there"))
    made = StructType.fromDDL(MADE.format(kind))
    arrow = to_arrow_schema(made)

    def run(batches):
        ids, out = [], []
        now, open_, numbers, said = None, False, [], []

        def give():
            columns = [pa.array(ids, arrow.field(0).type), *(pa.array([x[k] for x in out], f.type) for k, f in enumerate([*arrow][1:]))]
            batch = pa.RecordBatch.from_arrays(columns, schema=arrow)
            ids.clear()
            out.clear()
            return batch

        for batch in batches:
            for conv, turn, role, text, is_there in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ and conv != now:
                    ids.append(now)
                    out.append(repair(numbers, said))
                    numbers, said = [], []
                    if len(out) >= 2_000:
                        yield give()
                now, open_ = conv, True
                if is_there:
                    numbers.append(turn)
                    said.append((role, text))
        if open_:
            ids.append(now)
            out.append(repair(numbers, said))
        yield give()

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(run, made)
