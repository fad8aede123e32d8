"""Chat formatting: minimum-cost role repair.

Legal conversations are a system turn or none, then user and assistant in turn, the assistant last. Dynamic programming over that automaton
finds the cheapest repair of a sequence of turns: keeping a turn costs nothing, merging it into the one before MERGE, giving it another role
RELABEL, putting an empty turn in between INSERT. The repaired sequence is then rendered.

A conversation is cut into blocks of BLOCK rows, by their places in its order, whatever their turn numbers. The first pass reduces each block to a
matrix of costs between the automaton's states, by min-plus products of neighbours and without reading texts; matrices of a conversation are
combined in the same way to the states at the cuts; the second pass repairs each block between its two states. So a conversation that holds a third
of all rows is dealt over many tasks, and its cost is the same as in one.

Defined results: turns are ordered by number (null last), then role (null first), then a hash of the text; roles count without case and outer
spaces, any other or null role must be relabelled; null text is empty; repeated rows are turns of their own; null is a conversation of its own;
of repairs of equal cost, going back from the end of a block, the one that does not merge is taken, then the one whose turn before comes first in
the order none, system, user, assistant, which also decides at a cut; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomline.llm.ranks import ranked

BLOCK = 4096
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
ROLES = ("system", "user", "assistant")
#: States: 0 nothing yet, then the role of the last turn.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FAR = 1e12


def _fill() -> list[list[tuple[int, ...] | None]]:
    """fill[p][q]: the states of the fewest empty turns between state p and a turn of state q; None if there is no way."""
    out: list[list[tuple[int, ...] | None]] = [[None] * 4 for _ in range(4)]
    for p in range(4):
        front, seen = [(p, ())], set()
        while front:
            at, way = front.pop(0)
            for q in NEXT[at]:
                if out[p][q] is None:
                    out[p][q] = way
                if q not in seen:
                    seen.add(q)
                    front.append((q, (*way, q)))
    return out


FILL = _fill()
#: STEP[r][p][q]: cost of a turn of role r (0: none of ROLES) from state p to state q.
STEP = np.full((4, 4, 4), FAR)
MERGED = np.zeros((4, 4, 4), bool)
for _r in range(4):
    for _p in range(4):
        for _q in range(1, 4):
            _ways = [INSERT * len(FILL[_p][_q])] if FILL[_p][_q] is not None else []
            if _p == _q:
                _ways.append(MERGE)
            if _ways:
                STEP[_r, _p, _q] = min(_ways) + RELABEL * (_r != _q)
                MERGED[_r, _p, _q] = _p == _q and MERGE <= min(_ways)
#: Cost of ending from each state: the turns missing up to an assistant's.
END = np.array([0.0, 2 * INSERT, INSERT, 0.0])
CLOSING = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def path(roles: list[int], start: int, end: int) -> list[int]:
    """States after each turn of the cheapest way from start to end."""
    cost = np.full(4, FAR)
    cost[start] = 0
    back = np.empty((len(roles), 4), np.int8)
    for k, r in enumerate(roles):
        ways = cost[:, None] + STEP[r]
        # of equal ways: keep before merge before relabel before insert
        rank = ways * 16 + np.where(MERGED[r], 1, 0)
        back[k] = rank.argmin(0)
        cost = ways[back[k], range(4)]
    out = [end]
    for k in range(len(roles) - 1, 0, -1):
        out.append(int(back[k][out[-1]]))
    return out[::-1] if roles else []


def repaired(roles: list[int], texts: list[str], start: int, end: int, last: bool) -> Iterator[tuple[int, str, bool, bool]]:
    """(state, text, joins the turn before, was in the input) of a block's turns after repair."""
    before = start
    for r, text, q in zip(roles, texts, path(roles, start, end)):
        if MERGED[r, before, q]:
            yield q, text, True, True
        else:
            for s in FILL[before][q]:
                yield s, "", False, False
            yield q, text, False, True
        before = q
    if last:
        for s in CLOSING[before]:
            yield s, "", False, False


def piece(state: int, text: str, joins: bool, first: bool) -> str:
    """A turn as rendered; markers within a text are broken up."""
    text = text.replace("<|", "< |")
    return f"\n\n{text}" if joins else ("" if first else "<|end|>\n") + f"<|{ROLES[state - 1]}|>\n{text}"


def folded(codes: list[int]) -> np.ndarray:
    """The matrix of a run of turns: products of neighbouring pairs, then of these, so that the passes are as many as the logarithm of the run."""
    m = STEP[np.array(codes)]
    while len(m) > 1:
        pairs = (m[: len(m) // 2 * 2 : 2, :, :, None] + m[1 : len(m) // 2 * 2 : 2, None, :, :]).min(2)
        m = np.concatenate([pairs, m[-1:]]) if len(m) % 2 else pairs
    return m[0]


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, block, pos (place in the conversation), code, text, stored: both passes read the same blocks."""
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    code = F.when(role == "system", 1).when(role == "user", 2).when(role == "assistant", 3).otherwise(0)
    rows = turns.select("conv_id", "turn", "role", code.alias("code"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    group = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    placed = ranked(rows, group, [F.col("turn").isNull(), F.col("turn"), F.col("role").asc_nulls_first(), F.col("tie")], "turns")
    return placed.select("conv_id", F.floor((F.col("__pos") - 1) / BLOCK).cast("long").alias("block"), F.col("__pos").alias("pos"), "code", "text")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows with equal keys, over batch borders: one block of a conversation at a time is held."""
    now, held = None, [[] for _ in columns]
    for batch in batches:
        at = list(zip(*(batch[k].to_pylist() for k in keys)))
        cols = [batch[c].to_pylist() for c in columns]
        for k, key in enumerate(at):
            if key != now:
                if now is not None:
                    yield now, held
                now, held = key, [[] for _ in columns]
            for h, c in zip(held, cols):
                h.append(c[k])
    if now is not None:
        yield now, held


def plan(rows: DataFrame) -> DataFrame:
    """Numbered rows -> conv_id, block, entry, leave, last, cost: the states between which each block is repaired, and the conversation's cost."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def matrices(batches):
        out = []
        for (conv, block), (codes,) in _runs(batches, ["conv_id", "block"], ["code"]):
            out.append((conv, block, folded(codes).ravel().tolist(), len(codes)))
            if len(out) >= 2000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    schema = pa.schema([("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)), ("block", pa.int64()), ("m", pa.list_(pa.float64())), ("n", pa.int64())])
    dealt = rows.select("conv_id", "block", "pos", "code").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    blocks = dealt.mapInArrow(matrices, f"conv_id {kind}, block long, m array<double>, n long")

    def join(batches):
        out = []
        for (conv,), (block, m, n) in _runs(batches, ["conv_id"], ["block", "m", "n"]):
            order = sorted(range(len(block)), key=lambda k: block[k])
            m = [np.array(m[k]).reshape(4, 4) for k in order]
            cost = np.array([0.0, FAR, FAR, FAR])
            back = []
            for x in m:
                back.append((cost[:, None] + x).argmin(0))
                cost = (cost[:, None] + x).min(0)
            state = int((cost + END).argmin())
            total = float((cost + END).min())
            for j in range(len(m) - 1, -1, -1):
                entry = int(back[j][state])
                out.append((conv, block[order[j]], entry, state, j == len(m) - 1, total, n[order[j]]))
                state = entry
            if len(out) >= 5000:
                yield _batch(out, final)
                out = []
        if out:
            yield _batch(out, final)

    final = pa.schema([schema.field("conv_id"), ("block", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()), ("cost", pa.float64()), ("n", pa.int64())])
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(join, f"conv_id {kind}, block long, entry int, leave int, last boolean, cost double, n long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema.names)


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, block, n_turns, n_repaired, cost, rendered: a conversation's text is that of its blocks in order."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    # a block's states travel as its first row, so texts are shuffled once and a block is whole in its task, whatever Spark makes of joins
    numbers = numbered(turns)
    states = plan(numbers).select("conv_id", "block", F.lit(0).cast("long").alias("pos"), "entry", "leave", "last", "cost")
    rows = numbers.unionByName(states, allowMissingColumns=True).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")

    def render(batches):
        out = []
        size = 0
        for (conv, block), (codes, texts, entry, leave, last, cost) in _runs(batches, ["conv_id", "block"], ["code", "text", "entry", "leave", "last", "cost"]):
            turns = list(repaired(codes[1:], texts[1:], entry[0], leave[0], last[0]))
            text = "".join(piece(s, t, joins, entry[0] == 0 and k == 0) for k, (s, t, joins, _) in enumerate(turns)) + ("<|end|>\n" if last[0] else "")
            out.append((conv, block, len(codes) - 1, sum(not joins for _, _, joins, _ in turns), cost[0], text))
            size += len(text)
            if size >= 1 << 22:
                yield _batch(out, schema)
                out, size = [], 0
        if out:
            yield _batch(out, schema)

    schema = pa.schema([("conv_id", to_arrow_type(turns.schema["conv_id"].dataType)), ("block", pa.int64()), ("n_turns", pa.int64()), ("n_repaired", pa.int64()), ("cost", pa.float64()), ("rendered", pa.string())])
    return rows.select("conv_id", "block", "code", "text", "entry", "leave", "last", "cost").mapInArrow(render, f"conv_id {kind}, block long, n_turns long, n_repaired long, cost double, rendered string")


def summary(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_repaired, cost, rendered_sha256: of one block its SHA-256, of several that of their digests in order, joined."""
    blocks = rendered(turns).select("conv_id", "block", "n_turns", "n_repaired", "cost", F.sha2(F.col("rendered").cast("binary"), 256).alias("d"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("block", "d"))), lambda x: x["d"])
    out = blocks.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_repaired").alias("n_repaired"), F.max("cost").alias("cost"), every.alias("ds"))
    return out.select("conv_id", "n_turns", "n_repaired", "cost", F.when(F.size("ds") == 1, F.col("ds")[0]).otherwise(F.sha2(F.array_join("ds", "").cast("binary"), 256)).alias("rendered_sha256"))
