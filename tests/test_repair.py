"""Repair from damaged copies, the ledger of damage, and constraints of an archive with seeded faults."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F
from test_archive import archive  # noqa: F401  (a small archive of files)

from loomline.operators import consistency, repair
from loomline.operators.versions import signature_of
from loomline.sources import raw, sinks


def item(i: int, reply: int = 0, text: str = "hello") -> dict:
    return {"id": i, "replyTo": reply, "date": 100 + i, "text": text, "media": []}


def tree(fetched: int, *items: dict) -> bytes:
    return gzip.compress(json.dumps({"entryId": 1, "fetchedAt": fetched, "items": list(items)}, ensure_ascii=False).encode(), mtime=0)


def cut(data: bytes, keep: float) -> bytes:
    """A gzip file that ends early: some of it still inflates."""
    return data[: int(len(data) * keep)]


@pytest.fixture
def folders(tmp_path):
    def put(copies: dict[int, dict[int, bytes]]) -> dict[int, str]:
        for source, files in copies.items():
            (tmp_path / str(source)).mkdir()
            for name, data in files.items():
                (tmp_path / str(source) / f"{name}.json.gz").write_bytes(data)
        return {s: str(tmp_path / str(s)) for s in copies}

    return put


def rebuilt(spark, folders) -> tuple:
    copies, nodes = raw.tree_copies(spark, folders)
    return copies, repair.rebuilt(copies, nodes)


def test_a_whole_mirror_restores_a_damaged_tree(spark, folders):
    """The kept text of a comment that upstream lost comes back with the tree; nothing is told as new."""
    kept = item(11, text="kept text") | {"_site": {"state": "removed"}}
    at = folders({0: {5: b"\x00garbage"}, 1: {5: tree(20, kept, item(12, 11))}, 2: {5: tree(10, item(11, text="older"), item(12, 11))}})
    copies, found = rebuilt(spark, at)
    rows = {r["id"]: r for r in found.collect()}
    assert {i: (r["source"], r["state"], r["damaged_above"]) for i, r in rows.items()} == {11: (1, "current", 0), 12: (1, "current", 0)}
    assert json.loads(rows[11]["body"])["text"] == "kept text" and rows[11]["sig"] == signature_of("comment", kept)
    wanted = spark.createDataFrame([(5, False)], "tree long, gone boolean")
    assert repair.outcomes(wanted, copies, found).first()["outcome"] == "restored"
    doc = json.loads(repair.documents(found).first()["doc"])
    assert doc == {"entryId": 5, "fetchedAt": 20, "missing": [], "items": [kept, item(12, 11)]}


def test_nodes_come_from_several_damaged_copies(spark, folders):
    many = [item(100 + k, 99 + k if k else 0, f"text {k} " + "".join(chr(97 + (k * 7 + j) % 26) for j in range(400))) for k in range(60)]
    newer = [x | {"text": "new " + x["text"]} for x in many]
    at = folders({0: {7: cut(tree(30, *newer), 0.5)}, 1: {7: cut(tree(20, *many), 0.8)}})
    copies, found = rebuilt(spark, at)
    rows = {r["id"]: r for r in found.collect()}
    from_file = [i for i, r in rows.items() if r["source"] == 0]
    from_mirror = [i for i, r in rows.items() if r["source"] == 1]
    assert from_file and from_mirror and max(from_file) < min(from_mirror) and sorted(rows) == list(range(100, 100 + len(rows)))
    originals = {x["id"]: x for x in many}, {x["id"]: x for x in newer}
    assert all(json.loads(r["body"]) == originals[r["source"] == 0][i] for i, r in rows.items())  # no item is made up
    assert [rows[i]["depth"] for i in sorted(rows)] == list(range(len(rows)))
    wanted = spark.createDataFrame([(7, False), (8, False), (9, True)], "tree long, gone boolean")
    assert {r["tree"]: r["outcome"] for r in repair.outcomes(wanted, copies, found).collect()} == {7: "pending", 8: "pending", 9: "lost"}
    gone = spark.createDataFrame([(7, True)], "tree long, gone boolean")
    got = repair.outcomes(gone, copies, found).first()
    assert (got["outcome"], got["sources"], got["nodes"]) == ("partial", 2, len(rows))


def test_damage_is_carried_down_and_vanished_nodes_are_told(spark):
    copies = spark.createDataFrame([(1, 0, 30, False), (1, 1, 20, True)], "tree long, source int, fetched long, whole boolean")
    nodes = spark.createDataFrame(
        [(1, 0, 1, None, 1, "a", "A"), (1, 0, 2, 1, 2, None, None), (1, 0, 3, 2, 3, "c", "C"), (1, 0, 5, 3, 5, None, None), (1, 0, 6, 77, 6, "f", "F"), (1, 0, 8, 6, 8, "h", "H"),
         (1, 1, 1, None, 1, "a0", "A0"), (1, 1, 2, 1, 2, "b0", "B0"), (1, 1, 3, 2, 3, "c0", "C0"), (1, 9, 40, 1, 1, "x", "X")],
        "tree long, source int, id long, parent long, date long, sig string, body string",
    )
    rows = {r["id"]: (r["state"], r["source"], r["orphan"], r["damaged_above"]) for r in repair.rebuilt(copies, nodes).collect()}
    assert rows == {1: ("current", 0, False, 0), 2: ("stale", 1, False, 0), 3: ("current", 0, False, 1), 5: ("lost", None, False, 1), 6: ("current", 0, True, 0), 8: ("current", 0, False, 1)}
    older = spark.createDataFrame([(1, 0, 10, False), (1, 1, 20, True)], "tree long, source int, fetched long, whole boolean")
    rows = {r["id"]: r["state"] for r in repair.rebuilt(older, nodes).collect()}
    assert rows == {1: "current", 2: "current", 3: "current", 5: "lost", 6: "gone", 8: "gone"}
    assert repair.rebuilt(copies.limit(0), nodes.limit(0)).collect() == []


def test_salvage_of_broken_files():
    whole = tree(3, item(1), item(2, 1))
    assert raw._salvaged(whole) == {"whole": True, "head": '{"entryId": 1, "fetchedAt": 3}', "items": [json.dumps(item(1)), json.dumps(item(2, 1))]}
    plain = gzip.decompress(whole)
    part = raw._salvaged(plain[:-20])
    assert not part["whole"] and json.loads(part["head"]) == {"entryId": 1, "fetchedAt": 3} and part["items"] == [json.dumps(item(1))]
    for bad in (None, b"", b"\x1f\x8b", b"\x1f\x8bxxxxxxxxxxxxxxx", b"{}", b"[1]", b'{"items": 3}', plain[:9]):
        got = raw._salvaged(bad)
        assert got["items"] == [] and got["whole"] == (bad == b"{}")


def test_own_comments(spark):
    own = spark.createDataFrame(
        [(1, 1_700_000_000, "s1", True, False), (2, 1_700_000_000, "s2", True, False), (3, 1_600_000_000, "s3", True, True), (4, 1, None, True, False), (5, 1, "s5", True, True), (6, 1, "s6", False, False), (7, 1, None, True, False)],
        "id long, date long, sig string, damaged boolean, gone boolean",
    )
    copies = spark.createDataFrame(
        [(1, 0, "s1", 5, "exact"), (1, 2, "zz", 9, "later"), (2, 0, "o", 3, "old"), (2, 2, "p", 8, "new"), (3, 1, "q", 1, "left"), (4, 0, "e", 1, "export"), (4, 1, "m", 2, "mirror"), (6, 0, "s6", 1, "x"), (7, 0, "s7", 1, None)],
        "id long, source int, sig string, modified long, body string",
    )
    got = {r["id"]: (r["outcome"], r["source"], r["body"], r["expected"]) for r in repair.comments(own, copies).collect()}
    assert got == {1: ("restored", 0, "exact", "s1"), 2: ("pending", 2, "new", "s2"), 3: ("partial", 1, "left", "s3"), 4: ("restored", 0, "export", "e"), 5: ("lost", None, None, "s5"), 7: ("pending", None, None, None)}
    assert {r["item"]: r["sig"] for r in repair.losses("comment", repair.comments(own, copies)).collect()} == {3: "s3", 5: "s5"}


def test_versions_and_markers(spark):
    h = spark.createDataFrame(
        [(1, "post", 1, "edit", "a", None, True), (2, "post", 1, "edit", "b", None, True), (3, "post", 1, "edit", "b", None, True), (4, "post", 2, "edit", None, None, True), (5, "post", 3, "damaged", "c", None, False),
         (6, "post", 3, "edit", "c", None, True), (7, "post", 4, "edit", "d", "kept", False), (8, "post", 5, "edit", None, None, True)],
        "id long, kind string, item long, event string, sig string, body string, damaged boolean",
    )
    copies = spark.createDataFrame([(1, 2, "a", "pages"), (1, 1, "x", "other"), (4, 1, "any", "mirror"), (4, 2, "any", "pages")], "id long, source int, sig string, body string")
    got = {r["id"]: (r["event"], r["body"], r["state"], r["source"]) for r in repair.versions(h, copies).collect()}
    assert got == {1: ("edit", "pages", "restored", 2), 2: ("damaged", None, "lost", None), 4: ("edit", "mirror", "restored", 1), 5: ("damaged", None, None, None), 7: ("edit", "kept", None, None), 8: ("damaged", None, "lost", None)}


def test_damage_is_recorded_once(spark):
    schema = "kind string, item long, sig string, state string, at long"
    ledger = spark.createDataFrame([], schema)
    first = spark.createDataFrame([("post", 1, "abc", "replaced", 5), ("post", 1, "abc", "lost", 9), ("post", 1, None, "lost", 5), ("post", 1, "", "lost", 7)], schema)
    added = repair.recorded(ledger, first)
    assert sorted((r["sig"] or "", r["state"], r["at"]) for r in added.collect()) == [("", "lost", 5), ("abc", "replaced", 5)]
    assert repair.recorded(added, first).collect() == [] and repair.recorded(added, first.limit(0)).collect() == []


def tables(spark, archive, tmp_path) -> dict:  # noqa: F811
    at = archive.build(str(tmp_path / "out"), None)
    assert sinks.current(spark, str(tmp_path / "out")) == at
    return {n: spark.read.parquet(f"{at}/{n}") for n in ("posts", "comments", "entries", "comment_loc", "search_docs", "post_blocks", "month_groups")}


def test_an_archive_is_consistent_and_every_seeded_fault_is_found(spark, archive, tmp_path):  # noqa: F811
    t = tables(spark, archive, tmp_path)
    broken = lambda t: {(r["table"], r["constraint"]): (r["bad"], r["examples"]) for r in consistency.check(t, consistency.ARCHIVE).filter("bad > 0").collect()}
    assert broken(t) == {}
    faults = {
        ("posts", "unique id"): t | {"posts": t["posts"].union(t["posts"])},
        ("comment_loc", "id refers to comments.id"): t | {"comments": t["comments"].filter("id != 24")},
        ("comments", "own comments are placed on pages"): t | {"comment_loc": t["comment_loc"].filter("id != 12")},
        ("posts", "posts are searchable"): t | {"search_docs": t["search_docs"].filter("kind != 'p'")},
        ("comments", "entry_id refers to entries.id"): t | {"entries": t["entries"].filter("id != 6000001")},
        ("comments", "replies are below their root"): t | {"comments": t["comments"].withColumn("level", F.when(F.col("id") == 23, 0).otherwise(F.col("level")))},
    }
    for name, state in faults.items():
        assert name in broken(state), name
    assert broken(faults["comment_loc", "id refers to comments.id"])["comment_loc", "id refers to comments.id"] == (1, ["24"])
    found = consistency.check(faults["posts", "unique id"], consistency.ARCHIVE)
    told = repair.recorded(spark.createDataFrame([], "kind string, item string, sig string, state string, at long"), consistency.damages(found, 7))
    assert told.filter("item = 'posts: unique id'").count() == 1 and repair.recorded(told, consistency.damages(found, 8)).collect() == []


def test_constraints_of_rows_keys_and_references(spark, tmp_path):
    t = {"a": spark.createDataFrame([(1, 5, "x"), (1, 6, None), (None, 7, ""), (4, None, "y")], "id long, b long, s string"), "b": spark.createDataFrame([(5,), (None,)], "id long"), "none": spark.createDataFrame([], "id long, b long")}
    c = consistency
    rules = [c.Holds("a", "said", "s != ''"), c.Unique("a", "id"), c.Refers("a", "b", "b", "id"), c.Refers("a", "b", "b", "id", "b > 6"), c.Unique("none", "id"), c.Refers("none", "b", "b", "id"), c.Holds("none", "ever", "false"), c.SameCount("alike", "a", "id = 1", "b", "true")]
    got = sorted((r["table"], r["constraint"], r["rows"], r["bad"], r["examples"]) for r in c.check(t, [x for k, x in enumerate(rules) if k != 3]).collect())
    assert got == [("a", "alike", 4, 0, []), ("a", "b refers to b.id", 3, 2, ["6", "7"]), ("a", "said", 4, 2, ["1"]), ("a", "unique id", 4, 2, ["1"]), ("none", "b refers to b.id", 0, 0, []), ("none", "ever", 0, 0, []), ("none", "unique id", 0, 0, [])]
    assert c.check(t, [rules[3]]).first()["bad"] == 1
    with pytest.raises(ValueError):
        c.check(t, [])
    watched, seen = c.observed(t["a"], [rules[0]])
    watched.write.parquet(str(tmp_path / "a"))
    assert seen.get == {"rows": 4, "said": 2}
