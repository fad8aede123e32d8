from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from test_archive import OWNER, archive  # noqa: F401

from loomline import api
from loomline.functions import blocks
from loomline.operators import forest


@pytest.fixture(scope="module")
def reader(spark, archive, tmp_path_factory):  # noqa: F811
    root = str(tmp_path_factory.mktemp("published"))
    archive.build(root)
    log = [(1, "comment", 12, 5000001, 100, "edit", None, "a", "one two"), (2, "comment", 12, 5000001, 200, "edit", None, "b", "one 2 three"), (3, "post", 5000001, 5000001, 150, "removed", "removed", None, None)]
    history = spark.createDataFrame(log, "id long, kind string, item_id long, entry_id long, at long, event string, state string, sig string, body string")
    return api.Archive(spark, root, OWNER, history)


def test_counts(reader):
    assert [(r["grp"], r["n"]) for r in reader.count().collect()] == [("", 3)]
    assert {(r["grp"], r["n"]) for r in reader.count(by="post").collect()} == {(6000001, 2), (5000001, 1)}
    assert [(r["grp"], r["n"]) for r in reader.count(by="month").collect()] == [("2026-09", 3)]
    assert reader.count(posts="foreign").first()["n"] == 2 and reader.count(posts="own").first()["n"] == 1
    assert reader.count(source="posts", by="year", since="2030-01-01").count() == 0
    for bad in ({"source": "x"}, {"by": "week"}, {"where": "posts"}, {"by": "author"}, {"source": "posts", "by": "post"}, {"query": "a", "source": "posts"}):
        with pytest.raises(ValueError):
            reader.count(**bad)


def test_lists_and_threads(reader):
    assert [r["id"] for r in reader.list_comments(sort="old").collect()] == [12, 22, 24]
    assert [r["id"] for r in reader.list_comments(limit=1, offset=1).collect()] == [22] and reader.list_comments(post=5000001).count() == 1
    assert reader.list_posts(sort="reactions").first()["positive"] + reader.list_posts().first()["negative"] == 2
    assert [(r["id"], r["relation"]) for r in reader.get_comment(22).collect()] == [(21, "above"), (22, "self"), (23, "below"), (24, "below")]
    assert [(r["id"], r["depth"]) for r in reader.get_post(5000001).collect()] == [(11, 0), (12, 1), (13, 0)]
    s = reader.archive_stats().first()
    assert (s["posts"], s["comments"], s["my_comments"], s["donations"]) == (1, 7, 3, 450)
    assert api.Library(reader.spark, {"a": reader}).list_archives().first()["archive"] == "a"


def test_search_and_history(reader):
    assert reader.search("hello", where="my_comments").count() == 3 and reader.count(query="hello", by="none").first()["n"] == 6
    h = reader.get_history().collect()
    assert [r["id"] for r in h] == [2, 3, 1] and reader.get_history(event="removed").count() == 1
    one = {r["id"]: r for r in reader.get_history(item=12).collect()}
    assert [x["op"] for x in one[1]["runs"]] == ["equal", "change"] and one[2]["runs"] is None
    places = {r["id"]: r["place"] for r in reader.where_shown(reader.table("comments").select("id")).collect()}
    assert places[12] == "month" and places[11] == "post" and places[23] == "thread"


def test_shown_around_own(spark):
    e = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 3), (6, 4), (7, 1)], "id long, parent long")
    mine = spark.createDataFrame([(4, "g")], "id long, grp string")
    assert {(r["id"], r["chain"]) for r in forest.shown(e, mine).collect()} == {(1, True), (2, True), (3, True), (4, False), (6, False)}


def test_blocks(spark):
    image = lambda u, **d: {"type": "image", "data": {"uuid": u, "type": "jpg", "width": 10, **d}}
    rows = [
        ("text", {"text": "<p>a <b>b</b></p>"}), ("header", {"text": "H", "style": "h3"}), ("list", {"type": "OL", "items": ["<i>x</i>", "y"]}), ("quote", {"text": "q", "subline1": "A", "subline2": "B", "type": "big"}),
        ("media", {"items": [{"image": image("U1", type="gif")}, {"image": {}}, {"image": image("u2")}]}), ("video", {"video": {"data": {"external_service": {"name": "YouTube", "id": "v"}, "time": 5}}}),
        ("video", {"video": {"type": "video", "data": {"uuid": "u3", "type": "mp4"}}}), ("link", {"link": {"data": {"url": "https://a.b/c", "title": "T", "hostname": "a.b"}}}), ("link", {"link": {}}),
        ("code", {"text": "x <y>", "lang": "py"}), ("quiz", {"title": "Q", "items": {"1": "yes"}}), ("osnovaEmbed", {"osnovaEmbed": {"data": {"original_id": 7, "title": "E", "author": {"name": "N"}}}}),
        ("special_button", {"text": "Go", "url": "https://z.y"}), ("future", {"k": 1}), ("audio", {"audio": {"type": "audio", "data": {"uuid": "u5", "audio_info": {"duration": 61.5}}}}),
    ]
    df = spark.createDataFrame([(1, i, k, json.dumps(d)) for i, (k, d) in enumerate(rows)], "post_id long, idx int, type string, raw string").select("post_id", "idx", "type", F.parse_json("raw").alias("data"))
    b = {r["idx"]: r for r in blocks.normalised(df).collect()}
    assert b[0]["text"] == "a b" and (b[1]["heading"], b[1]["text"]) == (3, "H") and b[2]["ordered"] and list(b[2]["items"]) == ["x", "y"]
    assert (b[3]["author"], b[3]["style"]) == ("A, B", "big") and [(m["key"], m["kind"], m["width"]) for m in b[4]["media"]] == [("u1", "video", 10), ("u2", "image", 10)]
    assert b[5]["url"] == "https://www.youtube.com/watch?v=v&t=5s" and b[6]["media"][0]["kind"] == "video" and b[7]["title"] == "T"
    assert b[8]["level"] == "error" and b[8]["raw"] and b[9]["text"] == "x <y>" and b[9]["lang"] == "py" and list(b[10]["items"]) == ["yes"]
    assert (b[11]["ref_id"], b[11]["author"]) == (7, "N") and b[12]["url"] == "https://z.y" and b[13]["level"] == "unsupported" and b[13]["raw"]
    assert b[14]["duration"] == 61.5 and b[14]["media"][0]["kind"] == "audio"
    u = spark.range(1).select(blocks.comment_url(F.lit(5), F.lit(6), "https://s.org"), blocks.media_url(F.lit("k"), "https://m.org", F.lit("video"))).first()
    assert list(u) == ["https://s.org/5?comment=6", "https://m.org/k/-/format/mp4/"]
