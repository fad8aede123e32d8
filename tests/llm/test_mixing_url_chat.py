"""Mixing sources, URL filters and chat repair."""

from __future__ import annotations

import itertools
import math
import random

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from loomline.llm import chat_repair, mixing, queries, url_filter

SMALL = "/root/testdata/sf0.001"


def mixed(df) -> dict:
    return {r["doc_id"]: (r["__size"], r["__source_size"], r["__target"], r["__times"]) for r in mixing.mixed(df).collect()}


def test_mix_equals_brute_force(docs, rows):
    got, want = mixed(docs), brute.mixed(rows)
    assert got.keys() == want.keys()
    for i, (size, of, target, times) in want.items():
        assert got[i][:2] == (size, of) and math.isclose(got[i][2], target, rel_tol=1e-9) and got[i][3] == times, i


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_water_filling(spark, seed):
    rng = random.Random(seed)
    names = sorted(f"s{k}" for k in range(rng.randint(1, 9)))
    rows, i = [], 0
    for k, s in enumerate(names):
        for _ in range(rng.choice([1, 3, 40, 200])):
            rows.append((i, "w " * rng.randint(0, 20), s))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, want = mixed(df), brute.mixed(rows)
    assert all(math.isclose(got[k][2], want[k][2], rel_tol=1e-9, abs_tol=1e-9) for k in want)
    assert all(g[3] <= 3 for g in got.values())
    for s in names:
        own = [k for k, _, x in rows if x == s]
        taken, longest = sum(got[k][0] * got[k][3] for k in own), max(got[k][0] for k in own)
        assert abs(taken - got[own[0]][2]) <= longest / 2 + 1e-6


def test_mixture_and_edges(docs, rows, nulls, empty):
    out = mixing.mixture(docs)
    want = {i: w[3] for i, w in brute.mixed(rows).items() if w[3]}
    assert out.columns == docs.columns and {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
    assert mixing.mixture(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert {r[-4:] for r in map(tuple, mixing.mixed(nulls).collect())} == {(0, 0, 0.0, 0)} and mixing.mixture(nulls).count() == 0
    assert {r["__times"] for r in mixing.mixed(docs.unionByName(docs)).collect()} <= {0, 1, 2, 3}


def test_mix_stays_on_the_jvm(spark):
    plan = queries.op2_mix_sources(spark, SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    plan = queries.op3_url_filter(spark, SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).to_arrow_table()
    got = queries.queries()[name](spark, SMALL).select(*want.column_names).toArrow()
    norm = lambda t: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r.values()) for r in t.to_pylist()), key=repr)
    assert norm(got) == norm(want) and len(got)


ENTRIES = [
    ("ex.org", "block", "add", 10), ("ex.org", "block", "remove", 20), ("ex.org", "block", "add", 30), ("a.ex.org", "allow", "add", 15), ("ex.org/p", "allow", "add", 12),
    ("ex.org/p/q", "block", "add", 14), (None, "block", "add", 1), ("no.time", "block", "add", None), ("ex.org/p/q", "block", "remove", 18),
]


@pytest.mark.parametrize(("url", "at", "verdict", "rule"), [
    ("http://ex.org/", 9, "none", None), ("http://ex.org/", 10, "block", "ex.org"), ("http://EX.org.:80/x", 19, "block", "ex.org"), ("http://ex.org/", 20, "none", None),
    ("https://u:p@ex.org?x", 30, "block", "ex.org"), ("http://b.a.ex.org/", 14, "block", "ex.org"), ("http://b.a.ex.org/", 15, "allow", "a.ex.org"), ("http://ex.org/p/x", 13, "allow", "ex.org/p"),
    ("http://ex.org/p/q/r#f", 14, "block", "ex.org/p/q"), ("http://ex.org//p//q", 18, "allow", "ex.org/p"), ("http://notex.org/", 30, "none", None), (None, 15, "none", None), ("http://ex.org/", None, "none", None), ("", 15, "none", None), ("mailto:a@ex.org", 15, "none", None),
])
def test_verdict_at_fetch_time(spark, url, at, verdict, rule):
    entries = spark.createDataFrame(ENTRIES, "rule string, verdict string, action string, at long")
    got = url_filter.judge(spark.createDataFrame([(url, at, "x", 1)] * 2, "url string, fetched long, rule string, verdict int"), entries).collect()
    assert [(r["__verdict"], r["__rule"]) for r in got] == [(verdict, rule)] * 2


@pytest.mark.parametrize("most", [100_000, 0])
def test_filter_equals_brute_force(spark, monkeypatch, most):
    """Broadcast and shuffled interval tables give the same."""
    monkeypatch.setattr(url_filter, "MAX_BROADCAST", most)
    rng = random.Random(5)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.net", "x.d.net"]
    rules = hosts + [f"{h}/{p}" for h in hosts for p in ("p", "p/q")]
    log = [(rng.choice(rules), rng.choice(["block", "allow"]), rng.choice(["add", "add", "remove"]), t) for t in range(0, 400, 4)]
    caps = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['', 'p', 'p/q', 'p/q/r', 'z'])}", rng.randrange(450)) for i in range(300)]
    got = url_filter.judge(spark.createDataFrame(caps, "id long, url string, fetched long"), spark.createDataFrame(log, "rule string, verdict string, action string, at long")).collect()
    for r in got:
        host, path = r["url"][7:].split("/", 1)
        labels, segments = host.split("."), [s for s in path.split("/") if s]
        mine = [".".join(labels[k:]) for k in range(len(labels))] + [f"{host}/{'/'.join(segments[:k])}" for k in range(1, len(segments) + 1)]
        active = {}
        for rule, verdict, action, at in log:
            if at <= r["fetched"] and rule in mine:
                active[rule] = verdict if action == "add" else None
        active = {k: v for k, v in active.items() if v}
        best = min(active, key=lambda k: (-len(k.replace("/", ".").split(".")), active[k] != "block", k), default=None)
        assert (r["__verdict"], r["__rule"], r["__active"]) == (active.get(best, "none"), best, len(active))


def test_filter_of_empty_tables(spark):
    none = spark.createDataFrame([], "rule string, verdict string, action string, at long")
    caps = spark.createDataFrame([("http://a.b/", 1)], "url string, fetched long")
    assert url_filter.judge(caps, none).first()["__verdict"] == "none" and url_filter.judge(caps.limit(0), none).count() == 0


def chats(spark, sequences: dict) -> object:
    rows = [(c, k, role, f"t{k}") for c, roles in sequences.items() for k, role in enumerate(roles)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)


def test_repair_costs_equal_brute_force(spark):
    roles = ("system", "user", "assistant", "tool")
    sequences = dict(enumerate(s for n in range(1, 6) for s in itertools.product(roles, repeat=n)))
    got = {r["conv_id"]: r["cost"] for r in chat_repair.summary(chats(spark, sequences)).collect()}
    assert got == {c: brute.repair_cost(list(s)) for c, s in sequences.items()}


def test_rendered_conversations_are_legal_and_whole(spark, monkeypatch):
    rng = random.Random(4)
    sequences = {c: [rng.choice(["system", "user", "assistant", " User ", None, "bot"]) for _ in range(rng.randint(1, 30))] for c in range(60)}
    df = chats(spark, sequences)
    cost = {r["conv_id"]: r["cost"] for r in chat_repair.rendered(df).collect()}
    for block in (4096, 4):
        monkeypatch.setattr(chat_repair, "BLOCK", block)
        parts, n = {}, {}
        for r in sorted(chat_repair.rendered(df).collect(), key=lambda r: r["block"]):
            c = r["conv_id"]
            parts[c], n[c] = parts.get(c, "") + r["rendered"], [x + y for x, y in zip(n.get(c, (0, 0)), (r["n_turns"], r["n_repaired"]))]
            assert r["cost"] == cost[c]
        for c, text in parts.items():
            turns = [x.split("|>\n", 1) for x in text.removesuffix("<|end|>\n").removeprefix("<|").split("<|end|>\n<|")]
            assert all(b in brute.LEGAL[a] for a, b in zip(["start", *(r for r, _ in turns)], (r for r, _ in turns))) and turns[-1][0] == "assistant"
            assert [t for _, x in turns for t in x.split("\n\n") if t] == [f"t{k}" for k in range(len(sequences[c]))]
            assert n[c] == [len(sequences[c]), len(turns)]


def test_chat_edges(spark):
    kind = "conv_id long, turn long, role string, text string, code int, block long, cost double, tie long, raw string"
    extra = (7, 7, 7.0, 7, "x")
    rows = [(None, None, None, None, *extra), (None, None, None, None, *extra), (1, 0, "USER", "a <|x", *extra), (1, 0, "USER", "a <|x", *extra), (1, 1, "assistant", None, *extra), (2, -5, "assistant", "", *extra)]
    df = spark.createDataFrame(rows, kind)
    got = {r["conv_id"]: r for r in chat_repair.rendered(df).collect()}
    assert got[1]["rendered"] == "<|user|>\na < |x\n\na < |x<|end|>\n<|assistant|>\n<|end|>\n" and got[1]["cost"] == 1
    assert got[None]["n_turns"] == 2 and got[2]["cost"] == brute.repair_cost(["assistant"])
    assert chat_repair.summary(df.limit(0)).count() == 0 and chat_repair.summary(df).count() == 3
    assert [r["cost"] for r in chat_repair.rendered(df.filter("conv_id = 1").unionByName(df.filter("conv_id = 1"))).collect()] == [4.0]


def test_long_conversation_is_dealt_over_tasks(spark):
    df = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("t").alias("text"))
    got = chat_repair.rendered(df).collect()
    assert len(got) == 8 and {r["cost"] for r in got} == {0.0} and chat_repair.summary(df).first()["n_repaired"] == 30_000


def test_many_rows_at_few_turn_numbers_are_dealt_over_tasks(spark, monkeypatch):
    """A conversation without id whose turns all have one of four numbers, or none: its blocks are cut by rows."""
    n = 600
    monkeypatch.setattr(chat_repair, "BLOCK", 64)
    df = spark.range(n).select(F.lit(None).cast("long").alias("conv_id"), F.expr("CASE WHEN id % 5 < 4 THEN id % 5 END").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant"), F.lit("bot")), (F.col("id") % 3 + 1).cast("int")).alias("role"), F.col("id").cast("string").alias("text"))
    got = chat_repair.rendered(df.repartition(6)).collect()
    assert len(got) == -(-n // chat_repair.BLOCK) and max(r["n_turns"] for r in got) == chat_repair.BLOCK and sum(r["n_turns"] for r in got) == n
    order = sorted((i % 5, ("user", "assistant", "bot")[i % 3]) for i in range(n))
    assert {r["cost"] for r in got} == {brute.repair_cost([r for _, r in order])}


def test_blocks_fold_as_turn_by_turn():
    rng = random.Random(8)
    for n in (1, 2, 3, 7, 64, 501):
        codes = [rng.randrange(4) for _ in range(n)]
        one = chat_repair.STEP[codes[0]]
        for c in codes[1:]:
            one = (one[:, :, None] + chat_repair.STEP[c][None]).min(1)
        assert (one == chat_repair.folded(codes)).all()
