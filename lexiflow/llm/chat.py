"""Operator 2: chat formatting with minimum-cost role repair.

A legal conversation is: an optional system turn, then user and assistant turns by turns, ending with the assistant. For a
conversation's turns a dynamic program over that automaton, whose state is the role of the last turn placed, finds the cheapest
repair: a turn may be relabelled (RELABEL; UNKNOWN if its role is none of the three), merged into the turn before it where both have one role (MERGE), and empty turns
may be put in where the automaton asks for them (INSERT each). The repaired turns are then rendered as a template.

Cost at scale. The program is linear in a conversation's turns, with a pointer back for each turn and state. It depends on the roles
alone, so the results of short conversations are kept by their roles; texts only pass through the rendering.

Defined results: turns are ordered by turn, role and text, nulls first; repeated rows are turns of their own. Roles are compared
trimmed and in lower case; a null or unknown role fits nothing and has to be relabelled. A null text counts as empty. A row of
null conv_id is a conversation of its own. Of repairs of equal cost the one whose operations come first in the alphabet is taken.
'<|' within a text is rendered as '< |', so that texts cannot forge turns. Further columns of any name are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table

#: Prices; UNKNOWN is that of giving a turn of no known role one.
MERGE, UNKNOWN, INSERT, RELABEL = 1, 1, 2, 4
ROLES = ("system", "user", "assistant")
#: Legal successors of each state; None: the start.
NEXT = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


#: Longer conversations are repaired anew each time, so that the memory stays small.
KEPT = 64


def repair(roles: tuple[str | None, ...]) -> tuple[int, str, tuple[str, ...]]:
    """(cost, operations, role of each turn). Operations, a letter a turn: k keep, m merge, and r relabel, s relabel and merge,
    each after an i for every empty turn put in before it; the last ones may end the conversation."""
    return _kept(roles) if len(roles) <= KEPT else _repaired(roles)


def _moves(state: str | None, role: str | None) -> Iterator[tuple[int, str, str]]:
    """(price, operations, new state) of placing a turn of this role after a state."""
    for label in ROLES:
        other = label != role
        price = (RELABEL if role in ROLES else UNKNOWN) if other else 0
        if label == state:
            yield price + MERGE, "s" if other else "m", label
        gap = _gap(state, label)
        if gap is not None:
            yield price + INSERT * gap, "i" * gap + ("r" if other else "k"), label


def _repaired(roles: tuple[str | None, ...]) -> tuple[int, str, tuple[str, ...]]:
    """Costs to go from the end to the start, then forward along the cheapest moves whose operations come first. A move's
    operations end with its only letter but i, so none begins another's, and the first difference decides."""
    if not roles:
        return 0, "", ()
    n = len(roles)
    closing = {None: 0, "system": 2, "user": 1, "assistant": 0}
    moves = {(s, r): tuple(_moves(s, r)) for s in (None, *ROLES) for r in set(roles)}
    after = {s: INSERT * g for s, g in closing.items()}
    togo = [after]
    for role in reversed(roles):
        after = {s: min((p + after[t] for p, _, t in moves[s, role]), default=0) for s in after}
        togo.append(after)
    togo.reverse()
    here: list[str | None] = [None]  # the states that the same operations lead to, by the roles given so far
    ops: list[str] = []
    back: list[dict[str, str | None]] = []
    for i, role in enumerate(roles):
        best = min(op for s in here for p, op, t in moves[s, role] if p + togo[i + 1][t] == togo[i][s])
        came: dict[str, tuple[int, str, str | None]] = {}
        for rank, s in enumerate(here):
            for p, op, t in moves[s, role]:
                if op == best and p + togo[i + 1][t] == togo[i][s] and t not in came:
                    came[t] = (rank, t, s)
        here = sorted(came, key=came.__getitem__)
        ops.append(best)
        back.append({t: s for t, (_, _, s) in came.items()})
    state = min(here, key=lambda s: closing[s])  # the first of the shortest endings
    ops.append("i" * closing[state])
    given: list[str] = []
    for step in reversed(back):
        given.append(state)
        state = step[state]
    return togo[0][None], "".join(ops), tuple(reversed(given))


_kept = functools.lru_cache(maxsize=50_000)(_repaired)


def _gap(state: str | None, label: str) -> int | None:
    """How many empty turns make `label` legal after `state`; None where nothing does."""
    if label in NEXT[state]:
        return 0
    if label == "system":
        return None
    return 1  # user and user, assistant and assistant, or an assistant at the start or after system


def render(roles: tuple[str, ...], ops: str, texts: list[str | None]) -> tuple[str, int]:
    """The repaired conversation and its number of turns."""
    turns: list[list[str]] = []

    def put(role: str, text: str) -> None:
        turns.append([role, text])

    def missing() -> str:
        return "user" if not turns or turns[-1][0] != "user" else "assistant"

    i = 0
    for op in ops:
        if op == "i":
            put(missing(), "")
            continue
        text = (texts[i] or "").replace("<|", "< |")
        if op in "ms":
            turns[-1] += ["\n", text]
        else:
            put(roles[i], text)
        i += 1
    return "".join(f"<|{r}|>\n{''.join(t)}<|end|>\n" for r, *t in turns), len(turns)


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            out: dict[str, list] = {k: [] for k in ("cost", "operations", "turns", "rendered")}
            for turns in part.column("turns").to_pylist():
                cost, ops, given = repair(tuple(t["r"] for t in turns))
                text, n = render(given, ops, [t["text"] for t in turns])
                for k, v in zip(out, (cost, ops, n, text)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array(out["cost"], pa.int32()), pa.array(out["operations"], pa.string()), pa.array(out["turns"], pa.int32()), pa.array(out["rendered"], pa.string())], names=["conv_id", *out])


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, cost, operations, turns (after repair), rendered: a row for each conversation."""
    kind = dict(conversations.dtypes)["conv_id"]
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    rows = conversations.select("conv_id", alone, F.struct("turn", "role", "text", F.lower(F.trim("role")).alias("r")).alias("t"))
    turns = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", "turns")
    return turns.mapInArrow(_formatted, f"conv_id {kind}, cost int, operations string, turns int, rendered string")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations repaired and rendered."""
    return formatted(table(spark, sf_dir, "conversations"))
