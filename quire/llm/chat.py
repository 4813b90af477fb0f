"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation from user on,
the last one an assistant's. A turn may keep its role or take another (RELABEL), join the turn before if it has
the same role (MERGE), and empty turns may be put before it or at the end (INSERT each). The cheapest repair is
a shortest path over the automaton's states. A path's costs over a run of turns are a matrix in (min, +), so
conversations are cut into chunks of CHUNK turn numbers: chunks become matrices, a conversation's matrices
choose the states at the cuts, and chunks are repaired between their states. No task holds the texts of a whole
conversation.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import in_order, session

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
KEEP, MERGE, RELABEL, INSERT = 0, 1, 2, 3
CHUNK = 256
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"

#: The shortest empty turns between two legal neighbours, by (state, role of the next turn).
BRIDGE = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Empty turns that end a conversation.
FINISH = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
_INF = 1 << 40


def _moves():
    """(role of the turn or 0 if unknown) -> list of (from, to, cost, merged). The cheaper of a merge and a
    bridge stays for each pair; a merge if they cost the same."""
    out = {}
    for role in range(4):
        best = {}
        for to in (SYSTEM, USER, ASSISTANT):
            label = KEEP if to == role else RELABEL
            for a in range(4):
                ways = [(label + MERGE, 0)] if a == to else []
                if (a, to) in BRIDGE:
                    ways.append((label + INSERT * len(BRIDGE[a, to]), 1))
                if ways:
                    c, bridge = min(ways)
                    best[a, to] = (c, not bridge)
        out[role] = [(a, to, c, m) for (a, to), (c, m) in sorted(best.items())]
    return out


MOVES = _moves()


def role_number(role) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES else 0


def matrix(roles: list[int]) -> list[list[int]]:
    """Least cost from each state to each over these turns."""
    m = [[0 if a == b else _INF for b in range(4)] for a in range(4)]
    for r in roles:
        n = [[_INF] * 4 for _ in range(4)]
        for a, to, c, _ in MOVES[r]:
            for s in range(4):
                if m[s][a] + c < n[s][to]:
                    n[s][to] = m[s][a] + c
        m = n
    return m


def cuts(matrices: list[list[list[int]]]) -> tuple[list[int], int]:
    """States before, between and after the chunks of the cheapest repair, and its cost with the finish."""
    cost, back = [0, _INF, _INF, _INF], []
    for m in matrices:
        step = [min((cost[a] + m[a][b], a) for a in range(4)) for b in range(4)]
        back.append([a for _, a in step])
        cost = [c for c, _ in step]
    total, state = min((c + INSERT * len(FINISH[s]), s) for s, c in enumerate(cost))
    states = [state]
    for b in reversed(back):
        states.append(b[states[-1]])
    return states[::-1], total


def repair(roles: list[int], entry: int, exit_: int) -> list[tuple[int, int, int, bool]]:
    """Of each turn (state before, new role, cost, merged) on the cheapest path from entry to exit_."""
    cost, back = [0 if s == entry else _INF for s in range(4)], []
    for r in roles:
        n, b = [_INF] * 4, [None] * 4
        for a, to, c, merged in MOVES[r]:
            if cost[a] + c < n[to]:
                n[to], b[to] = cost[a] + c, (a, to, c, merged)
        cost = n
        back.append(b)
    out, s = [], exit_
    for b in reversed(back):
        out.append(b[s])
        s = b[s][0]
    return out[::-1]


#: Rows that a scan holds before it passes them on, and the columns of these.
ROWS = 2000
MEASURED = {"conv_id": pa.int64(), "chunk": pa.int64(), "m": pa.list_(pa.int64())}
CHOSEN = {"c": pa.int64(), "k": pa.int64(), "entry": pa.int32(), "exit": pa.int32(), "last": pa.bool_()}
REPAIRED = {k: pa.int64() if k in ("conv_id", "turn", "cost") else pa.string() for k in ("conv_id", "turn", "role", "new_role", "action", "inserted", "finish", "cost", "piece")}


def _record(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def _groups(batches, key, row):
    """Runs of rows of one key in sorted batches."""
    now, rows = None, []
    for b in batches:
        for x in zip(*[b.column(c).to_pylist() for c in (*key, *row)]):
            k = x[: len(key)]
            if k != now:
                if rows:
                    yield now, rows
                now, rows = k, []
            rows.append(x[len(key) :])
    if rows:
        yield now, rows


def repaired(turns: DataFrame) -> DataFrame:
    """Of each turn: conv_id, turn, role, new_role, action, inserted (roles of empty turns put before it),
    finish (those put after the last), cost, and piece: the turn's part of the rendered conversation, whose
    pieces in order of turn make it whole.

    Roles are compared without case and outer space; others and null are unknown and must be relabelled. A null
    text is empty, a null turn the first. Equal turn numbers are ordered by role, then a hash of the text, and lie in one
    chunk, which a task holds; rows with a null conv_id are left out. Further columns are ignored. An empty table gives an empty result."""
    session(turns.sparkSession)
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"), "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    t = t.withColumn("chunk", F.floor(F.col("turn") / CHUNK).cast("long")).withColumn("tie", F.xxhash64("text"))

    def measure(batches):
        out = []
        for k, g in _groups(batches, ("conv_id", "chunk"), ("role",)):
            out.append((*k, [c for line in matrix([role_number(r) for r, in g]) for c in line]))
            if len(out) >= ROWS:
                yield _record(out, MEASURED)
                out = []
        yield _record(out, MEASURED)

    # only roles and a hash of the text, for ties, are dealt out here
    order = ["conv_id", "chunk", "turn", "role", "tie"]
    sizes = in_order(t.select(*order), ["conv_id", "chunk"], order, measure, "conv_id long, chunk long, m array<long>")

    def choose(batches):
        out = []
        for (conv,), g in _groups(batches, ("conv_id",), ("chunk", "m")):
            states, _ = cuts([[m[4 * a : 4 * a + 4] for a in range(4)] for _, m in g])
            for i, (c, _) in enumerate(g):
                out.append((conv, c, states[i], states[i + 1], i + 1 == len(g)))
            if len(out) >= ROWS:
                yield _record(out, CHOSEN)
                out = []
        yield _record(out, CHOSEN)

    states = in_order(sizes, ["conv_id"], ["conv_id", "chunk"], choose, "c long, k long, entry int, exit int, last boolean")
    both = t.join(states, (F.col("conv_id") == F.col("c")) & (F.col("chunk") == F.col("k")))
    both = both.select("conv_id", "chunk", "entry", "exit", "last", "turn", "role", "text", "tie")

    def apply(batches):
        out = []
        for (conv, _, entry, exit_, last), g in _groups(batches, ("conv_id", "chunk", "entry", "exit", "last"), ("turn", "role", "text")):
            path = repair([role_number(r) for _, r, _ in g], entry, exit_)
            for i, ((turn, role, text), (a, to, c, merged)) in enumerate(zip(g, path)):
                put = () if merged else BRIDGE[a, to]
                end = FINISH[exit_] if last and i + 1 == len(g) else ()
                piece = "\n" + text if merged else (CLOSE if a != START else "") + "".join(OPEN.format(ROLES[x]) + CLOSE for x in put) + OPEN.format(ROLES[to]) + text
                if last and i + 1 == len(g):
                    piece += CLOSE + "".join(OPEN.format(ROLES[x]) + CLOSE for x in end)
                relabel = role_number(role) != to
                action = ("relabel+merge" if relabel else "merge") if merged else ("relabel" if relabel else "keep")
                out.append((conv, turn, role, ROLES[to], action, ",".join(ROLES[x] for x in put), ",".join(ROLES[x] for x in end), c + INSERT * len(end), piece))
                if len(out) >= ROWS:
                    yield _record(out, REPAIRED)
                    out = []
        yield _record(out, REPAIRED)

    order = ["conv_id", "chunk", "turn", "role", "tie"]
    return in_order(both, ["conv_id", "chunk"], order, apply, "conv_id long, turn long, role string, new_role string, action string, inserted string, finish string, cost long, piece string")
