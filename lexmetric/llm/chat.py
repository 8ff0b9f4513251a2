"""Chat formatting by minimum-cost role repair.

A legal chat is an optional system turn, then user and assistant turns in
alternation, the assistant last.  For every turn a dynamic program over that
automaton chooses to keep it, to relabel it, to merge it into the turn before,
and to put empty turns in front, at least total cost; the pieces of the
repaired sequence are then rendered.

The costs of a run of turns between any two states form a small min-plus
matrix, and matrices of neighbouring runs multiply.  Turns are range
partitioned by (conversation, turn), so a conversation of any length spreads
over tasks: the few conversations that cross a partition border send one
matrix per partition, which fixes the states at the borders, and every
partition then solves its own part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmetric.llm.common import cut, partitions

ROLES = ("system", "user", "assistant")
#: Costs of the repairs.
MERGE, INSERT, RELABEL, MERGE_OTHER = 1, 2, 3, 4
START, STATES, FAR = 3, 4, 10 ** 15
_NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
_FINAL = 2


def _inserts() -> dict[tuple[int, int], list[int]]:
    """Shortest chain of empty turns from one state to another (none: the empty chain)."""
    out = {}
    for s in range(STATES):
        ways, queue = {s: []}, [s]
        while queue:
            x = queue.pop(0)
            for y in _NEXT[x]:
                if y not in ways:
                    ways[y] = [*ways[x], y]
                    queue.append(y)
        out.update({(s, t): w for t, w in ways.items()})
    return out


INSERTS = _inserts()


def moves(role: int) -> list[tuple[int, int, int, tuple[int, ...], str]]:
    """(from, to, cost, empty turns before, action) of one turn, best first for each from and to."""
    best: dict[tuple[int, int], tuple] = {}
    for (s, mid), chain in INSERTS.items():
        cost = INSERT * len(chain)
        options = [(q, 0 if q == role else RELABEL, "keep" if q == role else "relabel") for q in _NEXT[mid]]
        if mid != START and not chain:
            options.append((mid, MERGE if mid == role else MERGE_OTHER, "merge"))
        for to, extra, action in options:
            entry = (cost + extra, len(chain), ("keep", "merge", "relabel").index(action), tuple(chain), action)
            if (s, to) not in best or entry < best[s, to]:
                best[s, to] = entry
    return sorted((s, t, e[0], e[3], e[4]) for (s, t), e in best.items())


MOVES = {r: moves(r) for r in (-1, 0, 1, 2)}
_CODE = {r: i for i, r in enumerate(ROLES)}


def code(role) -> int:
    """Number of a role name (any case, blanks around it); -1 if unknown or null."""
    return _CODE.get(role.strip().lower(), -1) if isinstance(role, str) else -1


def step(costs: list[int], role: int) -> tuple[list[int], list[tuple]]:
    new, back = [FAR] * STATES, [()] * STATES
    for m in MOVES[role]:
        c = costs[m[0]] + m[2]
        if c < new[m[1]]:
            new[m[1]], back[m[1]] = c, m
    return new, back


def matrix(roles: list[int]) -> list[list[int]]:
    """Least costs from every state to every state over a run of turns."""
    rows = []
    for s in range(STATES):
        costs = [FAR] * STATES
        costs[s] = 0
        for r in roles:
            costs, _ = step(costs, r)
        rows.append(costs)
    return rows


def closing(state: int) -> list[int]:
    """Empty turns that end a chat legally."""
    return INSERTS[state, _FINAL]


def borders(runs: list[list[list[int]]]) -> list[tuple[int, int]]:
    """(entry, exit) state of each run of one conversation, at least total cost."""
    costs, backs = [FAR] * STATES, []
    costs[START] = 0
    for m in runs:
        new = [min((costs[s] + m[s][t], s) for s in range(STATES)) for t in range(STATES)]
        costs, back = [c for c, _ in new], [s for _, s in new]
        backs.append(back)
    state = min((costs[t] + INSERT * len(closing(t)), t) for t in range(STATES) if t != START)[1]
    out = []
    for back in reversed(backs):
        out.append((back[state], state))
        state = back[state]
    return out[::-1]


def solve(roles: list[int], entry: int = START, leave: int | None = None) -> list[tuple]:
    """The chosen move of each turn, from a state (to a state, or to the cheapest legal end)."""
    costs, backs = [FAR] * STATES, []
    costs[entry] = 0
    for r in roles:
        costs, back = step(costs, r)
        backs.append(back)
    if leave is None:
        leave = min((costs[t] + INSERT * len(closing(t)), t) for t in range(STATES) if t != START)[1]
    out = []
    for back in reversed(backs):
        out.append(back[leave])
        leave = back[leave][0]
    return out[::-1]


def _empty(states) -> str:
    return "".join(f"<|{ROLES[s]}|>\n<|end|>\n" for s in states)


def pieces(texts: list[str], chosen: list[tuple], last: bool) -> list[str]:
    """Rendered text of each turn; the pieces of a chat in order are the whole chat."""
    out = []
    for i, (text, (s, t, _, chain, action)) in enumerate(zip(texts, chosen, strict=True)):
        if action == "merge":
            piece = "\n" + text
        else:
            piece = ("" if s == START else "<|end|>\n") + _empty(chain) + f"<|{ROLES[t]}|>\n" + text
        if last and i == len(texts) - 1:
            piece += "<|end|>\n" + _empty(closing(t))
        out.append(piece)
    return out


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one conversation in this partition at a time."""
    rest = None
    for frame in frames:
        rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        cuts = [0, *(rest["key"].ne(rest["key"].shift()).to_numpy().nonzero()[0][1:].tolist())]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield rest.iloc[a:b]
        rest = rest.iloc[cuts[-1]:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, role, new_role, action (keep, relabel,
    merge), n_inserted (empty turns before it), n_closing (after it, at the end
    of the chat), cost, piece (its part of the rendered chat).

    Turns are ordered by turn (nulls first), then role and text; repeated rows
    are turns of their own; unknown or null roles can be relabelled at the cost
    of any other; null texts render empty; null conversation ids are one
    conversation; an empty table gives no rows; other columns are not read.
    """
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("n")).alias("key"),
        F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = ["key", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = cut(rows.repartitionByRange(partitions(turns), *order, F.rand(5)).sortWithinPartitions(*order)
                .withColumn("pid", F.spark_partition_id()))

    def edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for run in _runs(frames):
            last = (run["key"].iloc[0], int(run["pid"].iloc[0]), [code(r) for r in run["role"]])
            first = first or last
        ends = [] if first is None else [first] if first[0] == last[0] else [first, last]
        yield pd.DataFrame([(k, p, [c for row in matrix(r) for c in row]) for k, p, r in ends],
                           columns=["key", "pid", "m"])
    # Two rows a partition at most.
    by_key: dict[str, list] = {}
    for r in dealt.mapInPandas(edges, "key string, pid long, m array<long>").collect():
        by_key.setdefault(r["key"], []).append((r["pid"], [r["m"][i:i + STATES] for i in range(0, STATES * STATES, STATES)]))
    known = {}
    for key, runs in by_key.items():
        if len(runs) > 1:
            runs.sort()
            for (pid, _), ends in zip(runs, borders([m for _, m in runs]), strict=True):
                known[key, pid] = (*ends, pid == runs[-1][0])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(frames):
            entry, leave, last = known.get((run["key"].iloc[0], int(run["pid"].iloc[0])), (START, None, True))
            chosen = solve([code(r) for r in run["role"]], entry, leave)
            texts = [t if isinstance(t, str) else "" for t in run["text"]]
            end = [0] * (len(chosen) - 1) + [len(closing(chosen[-1][1])) if last else 0]
            yield pd.DataFrame({
                "key": run["key"].to_numpy(), "turn": run["turn"].astype("Int64").to_numpy(), "role": run["role"].to_numpy(),
                "new_role": [ROLES[c[1]] for c in chosen], "action": [c[4] for c in chosen],
                "n_inserted": [len(c[3]) for c in chosen], "n_closing": end,
                "cost": [c[2] + INSERT * e for c, e in zip(chosen, end, strict=True)],
                "piece": pieces(texts, chosen, last)})
    out = dealt.mapInPandas(work, "key string, turn long, role string, new_role string, action string, "
                                  "n_inserted long, n_closing long, cost long, piece string")
    kind = turns.schema[conv_col].dataType
    conv = F.when(F.col("key") != "n", F.expr("substr(key, 2)")).cast(kind)
    return out.select(conv.alias("conv_id"), *[c for c in out.columns if c != "key"])
