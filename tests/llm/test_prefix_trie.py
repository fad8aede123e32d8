"""The trie of conversation prefixes against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from loomline.llm import prefix_trie, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, c long, k string, m string, n_convs int, parent string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    turns = {c: [(r[3], r[4]) for r in sorted(x)] for c, x in own.items()}
    nodes, length = defaultdict(list), {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + x[h:])
        length[c] = len(whole)
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append(c)
    kids = defaultdict(list)
    for x in nodes:
        if x:
            kids[x[:-1]].append(x)
    leaves, saved = {}, {}
    for x in sorted(nodes, key=len, reverse=True):
        leaves[x] = sum(leaves[y] for y in kids[x]) if kids[x] else 1
        saved[x] = (len(nodes[x]) - 1) * (len(x[-1][1]) if x else 0) + sum(saved[y] for y in kids[x])
    digest = lambda x: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[x] if length[c] == len(x)))).encode()).hexdigest()
    return sorted((min(nodes[x]), len(x), min(nodes[x[:-1]]) if x else -(1 << 62), len(nodes[x]), len(kids[x]), leaves[x], saved[x], digest(x)) for x in nodes)


def got(df) -> list[tuple]:
    assert df.columns == COLUMNS and {t for c, t in df.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted(tuple(-(1 << 62) if v is None else v for v in r) for r in df.collect())


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame([(*r, 1, "x", None, 2, "y", 3) for r in rows], SCHEMA).repartition(parts)


def talks(seed: int) -> list[tuple]:
    """Conversations of three blocks that open in few ways: copies, prefixes of others, missing openers, null and equal turn numbers."""
    rng = random.Random(seed)
    out = []
    for c in [*range(0, 40), *range(100, 130), *range(215, 240), *range(-120, -90)]:
        for t in range(rng.choice([1, 2, 4, 7, 9])):
            out.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", "user", None]), rng.choice(["a", "a", "a", "bé", "", None, f"own {c}"])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_dictionary_of_prefixes(spark, seed):
    rows = talks(seed)
    assert got(prefix_trie.trie(frame(spark, rows))) == plain(rows)


def test_repeats_nulls_and_empty_tables(spark):
    rows = talks(7)[:80]
    rows += rows[:40] + [(None, 0, "user", "a"), (None, None, None, None), (5, None, None, None), (5, None, None, None)]
    assert got(prefix_trie.trie(frame(spark, rows))) == plain(rows)
    assert got(prefix_trie.trie(frame(spark, rows[:1]).limit(0))) == []
    assert got(prefix_trie.trie(frame(spark, [(None,) * 4] * 3))) == []


def test_shared_beyond_the_turns_at_hand(spark):
    """Two long conversations part only at turn 36, so their turns are fetched again twice."""
    long = [(c, t, "user", f"t{t}") for c in (301, 302) for t in range(36)] + [(301, 36, "user", "x"), (302, 36, "user", "y"), (302, 37, "user", "z")]
    rows = talks(3)[:60] + long
    assert got(prefix_trie.trie(frame(spark, rows))) == plain(rows)


def test_a_conversation_over_many_ranges(spark):
    """One conversation holds most rows and lies in several ranges; its chain needs no level of its own."""
    rows = talks(4)[:60] + [(77, t, "user", f"t{t}") for t in range(9000)] + [(78, 0, "user", "t0")]
    assert prefix_trie.numbered(frame(spark, rows, 4)).filter("c = 77").selectExpr("count(distinct pos) n", "min(pos) a", "max(pos) z").first() == (9000, 1, 9000)
    assert got(prefix_trie.trie(frame(spark, rows, 4))) == plain(rows)


def test_a_node_that_holds_nearly_all(spark):
    rows = [(c, t, "user", "same") for c in range(1000, 4000) for t in range(3)] + talks(5)[:50]
    out = prefix_trie.trie(frame(spark, rows))
    assert got(out) == plain(rows)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    cur = con.execute(queries.oracle_sql()["op13_prefix_trie"])
    at = [[x[0] for x in cur.description].index(c) for c in COLUMNS]
    want = sorted(tuple(-(1 << 62) if r[k] is None else r[k] for k in at) for r in cur.fetchall())
    assert got(queries.op13_prefix_trie(spark, SMALL)) == want
