"""Minimum-cost repair of chat roles, and rendering.

A legal chat has at most one system turn, first; then user and assistant take
turns, user first and assistant last. The repair reads the turns in order and
keeps each, gives it another role, merges it into the turn before, or first
inserts empty turns; a dynamic program over the states of the automaton finds the
cheapest way. Among equal costs the earlier entry of ``moves`` wins.

Costs are sums, so a block of turns acts as a small (min, +) matrix over states.
Blocks of at most ``BLOCK`` turns are cut from a range partitioning by
conversation and turn, so one conversation may span many tasks; their matrices
are chained per conversation in two streaming passes, and each block is then
repaired on its own between known states. Each turn becomes a fragment of the
rendered chat: fragments of a conversation in order of ``position`` are the chat.

Defined results: a null or unknown role fits any role at half the relabel cost; a
null text is an empty one; turns with equal numbers are ordered by role and text;
a null turn number comes first; rows without a conversation id form one
conversation; repeated rows are turns of their own; an empty table gives an empty
table.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import map_columns, written

BLOCK = 256
NO_ID = -(2**63)
# States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ("", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
KEEP, GUESS, MERGE_SAME, RELABEL, INSERT, MERGE_OTHER = 0, 1, 1, 2, 3, 4
NEVER = 10**12
# What closing the chat costs in each state, and the empty turns it takes.
ENDED = (NEVER, 2 * INSERT, INSERT, 0)
CLOSING = ((), (USER, ASSISTANT), (ASSISTANT,), ())


def role_of(role: str | None) -> int:
    """State after a turn of that role; 0 for an unknown one."""
    return ROLES.get((role or "").strip().lower(), 0)


def _moves() -> dict[int, list[tuple[int, int, int, str, tuple[int, ...]]]]:
    """Per role: (from, to, cost, action, inserted roles), cheapest first."""
    out = {}
    for role in range(4):
        found = []
        for start in range(4):
            # Up to two empty turns bring any later state about.
            paths = [((), start)]
            for path, at in paths:
                if len(path) < 2:
                    paths += [((*path, n), n) for n in NEXT[at]]
            for path, at in paths:
                paid = INSERT * len(path)
                for to in NEXT[at]:
                    cost = KEEP if to == role else GUESS if role == 0 else RELABEL
                    found.append((start, to, paid + cost, "keep" if to == role else "relabel", path))
                if not path and at != START:
                    found.append((start, at, MERGE_SAME if at == role or role == 0 else MERGE_OTHER, "merge", path))
        best: dict[tuple[int, int], tuple] = {}
        for m in sorted(found, key=lambda m: (m[2], len(m[4]), m[3], m[4])):
            best.setdefault(m[:2], m)
        out[role] = list(best.values())
    return out


def transfer(roles: list[int], moves) -> np.ndarray:
    """Least cost from each state to each state over a block of turns."""
    cost = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for role in roles:
        new = np.full((4, 4), NEVER)
        for start, to, c, _, _ in moves[role]:
            new[:, to] = np.minimum(new[:, to], cost[:, start] + c)
        cost = np.minimum(new, NEVER)
    return cost


def path(roles: list[int], entry: int, leave: int, moves) -> list[tuple]:
    """The cheapest moves from one state to another."""
    value, back = [NEVER] * 4, []
    value[entry] = 0
    for role in roles:
        new, step = [NEVER] * 4, [None] * 4
        for m in moves[role]:
            if value[m[0]] + m[2] < new[m[1]]:
                new[m[1]], step[m[1]] = value[m[0]] + m[2], m
        value, at = new, step
        back.append(at)
    out, state = [], leave
    for at in reversed(back):
        out.append(at[state])
        state = at[state][0]
    return out[::-1]


def fragment(text: str, move: tuple, last: bool) -> str:
    """What a turn adds to the rendered chat."""
    start, to, _, action, inserted = move
    out, open_turn = [], start != START
    if action == "merge":
        out.append("\n\n" + text)
    else:
        for role in (*inserted, to):
            if open_turn:
                out.append("<|end|>\n")
            out.append(f"<|{NAMES[role]}|>\n")
            open_turn = True
        out.append(text)
    if last:
        out.append("<|end|>\n")
        out += [f"<|{NAMES[role]}|>\n<|end|>\n" for role in CLOSING[to]]
    return "".join(out)


REPAIRED = (
    "conv_id long, position long, turn long, role string, repaired_role string, action string, "
    "inserted string, cost long, fragment string"
)


def repaired(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per turn: its place, the repair and the rendered fragment."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv", "turn", "role", "text", "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")

    def number(batches):
        part = TaskContext.get().partitionId()
        conv, run, place = None, 0, 0
        for b in batches:
            out = b | {"part": [part] * len(b["conv"]), "run": [], "place": []}
            for c in b["conv"]:
                if c != conv or place == block:
                    conv, run, place = c, run + 1, 0
                out["run"].append(run)
                out["place"].append(place)
                place += 1
            yield out

    kept = "conv long, conv_id long, turn long, role string, text string, part int, run long, place int"
    placed = written(map_columns(rows, number, kept), "turns")
    key = ["conv", "part", "run"]

    def blocks_of(batches, names):
        """Rows of one block after the other; the input is sorted by block."""
        held, now = [], None
        for b in batches:
            for row in zip(*(b[n] for n in names)):
                if row[:3] != now:
                    if held:
                        yield held
                    held, now = [], row[:3]
                held.append(row)
        if held:
            yield held

    def weigh(batches):
        moves = _moves()
        for rows in blocks_of(batches, [*key, "place", "role"]):
            m = transfer([role_of(r[4]) for r in rows], moves)
            yield dict(zip(key, ([v] for v in rows[0][:3]))) | {"n": [len(rows)], "costs": [m.ravel().tolist()]}

    weighed = map_columns(
        placed.select(*key, "place", "role").repartition(*key).sortWithinPartitions(*key, "place"),
        weigh,
        "conv long, part int, run long, n long, costs array<long>",
    )

    def forward(batches):
        conv, cost, seen = None, None, 0
        for b in batches:
            ahead, first = [], []
            for c, n, m in zip(b["conv"], b["n"], b["costs"]):
                if c != conv:
                    conv, cost, seen = c, np.array([0, NEVER, NEVER, NEVER]), 0
                ahead.append(cost.tolist())
                first.append(seen)
                cost = np.minimum((cost[:, None] + np.array(m).reshape(4, 4)).min(axis=0), NEVER)
                seen += n
            yield b | {"ahead": ahead, "first": first}

    chained = written(
        map_columns(
            weighed.repartition("conv").sortWithinPartitions(*key),
            forward,
            "conv long, part int, run long, n long, costs array<long>, ahead array<long>, first long",
        ),
        "blocks",
    )

    def backward(batches):
        conv, leave = None, 0
        for b in batches:
            out = {k: [] for k in (*key, "first", "entry", "leave", "final")}
            for c, p, r, f, m, v in zip(*(b[k] for k in (*key, "first", "costs", "ahead"))):
                total = np.array(v)[:, None] + np.array(m).reshape(4, 4)
                final = c != conv
                if final:
                    conv, leave = c, int((total.min(axis=0) + np.array(ENDED)).argmin())
                entry = int(total[:, leave].argmin())
                for k, x in zip(out, (c, p, r, f, entry, leave, final)):
                    out[k].append(x)
                leave = entry
            yield out

    states = map_columns(
        chained.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("run")),
        backward,
        "conv long, part int, run long, first long, entry int, leave int, final boolean",
    )

    names = [*key, "place", "conv_id", "turn", "role", "text", "first", "entry", "leave", "final"]

    def mend(batches):
        moves = _moves()
        for rows in blocks_of(batches, names):
            first, entry, leave, final = rows[0][8:]
            found = path([role_of(r[6]) for r in rows], entry, leave, moves)
            out = {f.split()[0]: [] for f in REPAIRED.split(", ")}
            for k, (row, move) in enumerate(zip(rows, found)):
                last = final and k == len(rows) - 1
                out["conv_id"].append(row[4])
                out["position"].append(first + k)
                out["turn"].append(row[5])
                out["role"].append(row[6])
                out["repaired_role"].append(NAMES[move[1]])
                out["action"].append(move[3])
                out["inserted"].append(",".join(NAMES[i] for i in move[4]))
                out["cost"].append(move[2] + (ENDED[move[1]] if last else 0))
                out["fragment"].append(fragment(row[7], move, last))
            yield out

    joined = placed.join(states, key).repartition(*key).sortWithinPartitions(*key, "place")
    return map_columns(joined.select(*names), mend, REPAIRED)
