from __future__ import annotations

import gzip
import json
import sqlite3
import zlib

import pytest
from pyspark.sql import functions as F

from loomline.operators import counting, forest, guard, integrity, setlike, versions
from loomline.plans import model
from loomline.sources import raw, sinks
from loomline.streaming import history

OWNER, T0 = 777, 1_790_000_000


def comment(i, reply=0, author=1, text="hello", **more):
    return {"id": i, "replyTo": reply, "level": 1 if reply else 0, "author": {"id": author, "name": f"n{author}", "nickname": "", "uri": ""}, "date": T0 + i, "text": text, "media": [], "replyCount": 0} | more


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    dump = lambda path, obj: (path.parent.mkdir(exist_ok=True), path.write_bytes(gzip.compress(json.dumps(obj).encode())))
    post = {"id": 5000001, "date": T0, "title": "T", "url": "https://x.org/5000001-t", "counters": {"comments": 2}, "reactions": {"counters": [{"id": 1, "count": 2}]}, "donations": {"amount": 100},
            "blocks": [{"type": "text", "data": {"text": "<p>Lead text</p>"}}, {"type": "media", "data": {"items": [{"image": {"data": {"uuid": "u1"}}}, {}]}}, {"type": "futureBlock", "data": {}}]}
    dump(root / "posts/5000001.json.gz", post)
    dump(root / "post-trees/5000001.json.gz", {"items": [comment(11, donation=300), comment(12, 11, OWNER, donations={"amount": 50}), comment(13, text="", donation=150)]})
    entry = {"id": 6000001, "title": "Other", "subsiteId": 5, "subsiteName": "Sub"}
    dump(root / "threads/6000001.json.gz", {"entryId": 6000001, "items": [comment(21), comment(22, 21, OWNER), comment(23, 22), comment(24, 23, OWNER)]})
    (root / "my-comments").mkdir()
    feed = [comment(12, 11, OWNER, entry={"id": 5000001, "title": "T"}), comment(22, 21, OWNER, entry=entry), comment(24, 23, OWNER, entry=entry)]
    (root / "my-comments/2026.jsonl.gz").write_bytes(gzip.compress("\n".join(map(json.dumps, feed)).encode()))
    return model.Archive(spark, str(root), OWNER)


def test_read_model(spark, archive, tmp_path):
    stats = spark.createDataFrame([(5000001, 3, 500, [("1", 4)], 9)], "id long, comments int, donations long, rx array<struct<id:string,n:bigint>>, stats_at long")
    at = archive.build(str(tmp_path / "out"), stats)
    assert sinks.current(spark, str(tmp_path / "out")) == at
    t = {n: spark.read.parquet(f"{at}/{n}") for n in ("posts", "comments", "month_groups", "months", "post_blocks", "entries", "users", "search_docs", "comment_loc")}
    p = t["posts"].first()
    assert (p["donations"], p["comments"], p["lead"], p["cover"]) == (500, 3, "Lead text", "u1")
    assert t["comments"].filter("feed").count() == 3 and t["comments"].count() == 7
    assert {r["id"]: r["donation"] for r in t["comments"].filter("donation > 0").collect()} == {11: 300, 13: 150}
    groups = {r["entry_id"]: r for r in t["month_groups"].collect()}
    assert len(groups) == 2 and groups[6000001]["root_id"] == 21 and groups[6000001]["mine"] == [22, 24]
    assert {(r["type"], r["level"]) for r in t["post_blocks"].collect()} == {("text", "full"), ("media", "full"), ("futureBlock", "unsupported")}
    assert t["months"].first()["comments"] == 3 and t["comment_loc"].count() == 3 and t["users"].count() == 2
    assert {r["kind"]: r["count"] for r in t["search_docs"].groupBy("kind").count().collect()} == {"p": 1, "c": 3, "o": 4}
    d = model.donations(t["posts"], t["comments"]).first()
    assert (d["site"], d["by_comments"], d["total"]) == (500, 450, 500)
    e = {r["id"]: r for r in model.exported_comments(t["comments"]).collect()}
    assert e[24]["ancestorIds"] == [21, 22, 23] and e[24]["contextStatus"] == "ok"


def test_forest(spark):
    e = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 1), (6, None), (7, 4)], "id long, parent long")
    wanted = spark.createDataFrame([(3,), (99,)], "id long")
    assert sorted(r["id"] for r in forest.keep(e, wanted).collect()) == [1, 2, 3, 4, 7]
    assert [r["id"] for r in forest.missing(e, wanted).collect()] == [99]
    assert {r["id"]: r["root"] for r in forest.roots(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 1}
    assert {r["id"]: r["depth"] for r in forest.roots(e).collect()}[7] == 4
    cyclic = spark.createDataFrame([(1, 2), (2, 1), (3, 50)], "id long, parent long")
    assert {(r["id"], r["ancestor"]) for r in forest.ancestors(cyclic).collect()} == {(1, 2), (2, 1), (3, 50)}
    deep = spark.range(1, 151).selectExpr("id", "id - 1 as parent")
    assert forest.ancestors(deep).filter("id = 150").count() == 149


def test_merge_marks_losses(spark):
    schema = "id long, date long, text string, stub string, media boolean, state string, state_at long"
    old = spark.createDataFrame([(1, 1, "one long text", None, False, None, None), (2, 2, "two", None, False, None, None), (3, 3, "three", None, False, None, None), (4, 4, "", "removed", False, None, None)], schema)
    new = spark.createDataFrame([(1, 1, "Комментарий удалён", "removed", False, None, None), (3, 3, "three!", None, False, None, None)], schema)
    got = {r["id"]: r for r in versions.merge(old, new, 9).collect()}
    assert got[1]["text"] == "one long text" and got[1]["state"] == "removed" and got[1]["event"] == "removed"
    assert got[2]["state"] == "gone" and got[3]["event"] == "edit" and 4 not in got
    again = versions.merge(versions.merge(old, new, 9).drop("event"), new, 10)
    assert again.filter("event = 'removed'").count() == 0 and {r["state_at"] for r in again.filter("state is not null").collect()} == {9}
    with pytest.raises(guard.MassLoss):
        guard.assert_losses(spark.range(50).selectExpr("id", "true as lost"), 50)


def test_signatures_and_diffs(spark):
    a = {"text": "hi  there", "media": [], "likes": 1}
    assert versions.signature_of("comment", a) == versions.signature_of("comment", a | {"likes": 5, "text": "hi there"})
    assert versions.signature_of("comment", a) != versions.signature_of("comment", a | {"text": "ho"})
    r = versions.runs("one two three four five six", "one 2 three four five 6")
    assert [x[0] for x in r] == ["equal", "change", "equal", "change"] and "".join(x[2] for x in r) == "one 2 three four five 6"
    assert [o for o, _, _ in versions.block_ops([{"a": 1}, {"a": 2}, {"a": 3}], [{"a": 1}, {"a": 9}, {"a": 3}, {"a": 4}])] == ["equal", "replace", "equal", "insert"]
    assert versions.block_summary([1, 2], [1, 3, 4]) == {"changed": 1, "added": 1, "removed": 0}


def test_guard_columns(spark):
    no = F.lit(False)
    flags = dict.fromkeys(("moderator", "hidden", "author_deleted", "author_frozen", "removed"), no)
    rows = spark.createDataFrame([("Комментарий удалён модератором",), ("живой текст",), ("",), (".",)], "t string")
    assert [r[0] for r in rows.select(guard.comment_stub(F.col("t"), no, flags)).collect()] == ["moderator", None, "removed", None]
    wiped = rows.limit(1).select(guard.post_wiped(F.lit(400), F.lit(10), F.lit(1), F.lit("x"), F.lit("y")), guard.post_wiped(F.lit(200), F.lit(10), F.lit(1), F.lit("x"), F.lit("y"))).first()
    assert list(wiped) == [True, False]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, 1, "A", False), (1, 2, "B", False), (1, 3, "A", False), (1, 4, "B", False), (1, 5, "x", True), (1, 6, "B", False), (2, 1, "A", False), (2, 2, "A", False)]
    df = spark.createDataFrame(rows, "item long, t long, sig string, stub boolean").selectExpr("item", "timestamp_seconds(t) as seen", "sig", "stub")
    for k in range(1, 7):
        df.filter(f"seen = timestamp_seconds({k})").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = history.landed(spark, str(tmp_path / "in"), "item long, seen timestamp, sig string, stub boolean")
    q = history.changes(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: sorted((r["item"], str(r["seen"]), r["event"], r["sig"]) for r in d.collect())
    assert key(spark.table("changes")) == key(history.changes_batch(df))
    assert [x[2] for x in key(spark.table("changes"))].count("edit") == 2


def test_streams_upsert_and_dedupe(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(str(tmp_path / "in"))
    q = history.upserted(history.landed(spark, str(tmp_path / "in"), "id long, v string"), str(tmp_path / "t"), "id", str(tmp_path / "cp"))
    q.awaitTermination(120)
    spark.createDataFrame([(2, "c")], "id long, v string").write.mode("append").parquet(str(tmp_path / "in"))
    q = history.upserted(history.landed(spark, str(tmp_path / "in"), "id long, v string"), str(tmp_path / "t"), "id", str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(sinks.current(spark, str(tmp_path / "t")) + "/rows")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c")]


def test_sources(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json.gz").write_bytes(gzip.compress(b'{"x": 1}'))
    (tmp_path / "j/b.json.gz").write_bytes(gzip.compress(b'{"x": 2}')[:-12])
    assert sorted(r["status"] for r in raw.checked(spark, str(tmp_path / "j")).collect()) == ["damaged", "ok"]
    assert raw.hashed(spark, str(tmp_path / "j")).count() == 2
    packed = spark.createDataFrame([(zlib.compress(b'{"a":1}'),), (b"no",)], "b binary").select(raw.unpacked("b").alias("x"))
    assert [r["x"] for r in packed.collect()] == ['{"a":1}', None]
    raw.register(spark)
    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("create table t(id integer, name text)")
        db.executemany("insert into t values (?, ?)", [(k, f"n{k}") for k in range(10)])
    got = spark.read.format("sqlite").option("path", str(tmp_path / "s.db")).option("table", "t").load()
    assert got.count() == 10 and got.filter("id = 3").first()["name"] == "n3"
    for k, (items, after) in enumerate([([1, 2], "1"), ([3], "2"), ([], None)]):
        (tmp_path / f"{k}.json").write_text(json.dumps({"items": items, "next": after}))
    pages = spark.read.format("paged").option("path", str(tmp_path)).load()
    assert sorted((r["page"], r["item"]) for r in pages.collect()) == [("0", "1"), ("0", "2"), ("1", "3")]
    feed = spark.createDataFrame([(5, 1), (5, 2), (3, 9)], "date long, id long")
    assert [tuple(r) for r in raw.keyset_page(feed, (5, 2)).collect()] == [(5, 1), (3, 9)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "", 2025), (2, "x", 2026)], "id long, note string, year int")
    sinks.sparse_lines(df, str(tmp_path / "s"))
    assert {tuple(sorted(json.loads(r["value"]))) for r in spark.read.text(str(tmp_path / "s")).collect()} == {("id", "year"), ("id", "note", "year")}
    sinks.rewrite_years(df, str(tmp_path / "y"))
    sinks.rewrite_years(df.filter("year = 2026").withColumn("note", F.lit("z")), str(tmp_path / "y"))
    assert {(r["id"], r["note"]) for r in spark.read.json(str(tmp_path / "y")).collect()} == {(1, ""), (2, "z")}
    same = spark.createDataFrame([('{"a": 1}',), ('{ "a":1 }',)], "r string").select(sinks.packed("r").alias("b")).distinct()
    assert same.count() == 1
    text = spark.createDataFrame([(1, "\n\n".join(["p" * 40] * 5))], "id long, text string")
    assert sorted(len(r["text"]) for r in sinks.parts(text, 80).collect()) == [40, 82, 82]
    sinks.markdown(spark.createDataFrame([("n", {"title": "T"}, "body")], "name string, front map<string,string>, body string"), str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).first()["value"].startswith('---\ntitle: "T"\n---\n\nbody')


def test_sets_and_pages(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    assert {r["k"]: r["side"] for r in setlike.classify(a, a.filter("k = 1"), "k").collect()} == {1: "both", 2: "old"}
    with pytest.raises(ValueError):
        setlike.orphans(a, [None], "k")
    g = spark.createDataFrame([("m", i, w) for i, w in enumerate([200, 150, 10, 300, 5])], "ym string, pos long, n long")
    assert [r["page"] for r in counting.greedy_pages(g, "ym", "pos", "n", 300).orderBy("pos").collect()] == [1, 1, 2, 2, 3]
    b = spark.createDataFrame([(f"h{i:02}", i, 10) for i in range(20)], "sha256 string, checked_at long, size long")
    assert integrity.due(b, 35).count() == 4 and integrity.due(b, 0).count() == 1
    with pytest.raises(ValueError):
        integrity.assert_clean(spark.createDataFrame([("p", "missing")], "path string, status string"))
