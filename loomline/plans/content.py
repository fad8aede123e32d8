"""Content blocks, media and addresses made of the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import blocks
from loomline.operators import forest
from loomline.plans.archive import _UP, tree
from loomline.plans.registry import Tables, query


def some_blocks(t: Tables) -> DataFrame:
    """A block a part: its name is the text, its brand and type are what else the kind of block has."""
    kind = F.element_at(F.array(*map(F.lit, ("text", "header", "list", "quote", "link", "quiz", "future"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    name, brand, sort = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    data = (
        F.when(kind == "text", F.to_json(F.struct(F.concat(F.lit("<p>"), name, F.lit("</p>")).alias("text"))))
        .when(kind == "header", F.to_json(F.struct(name.alias("text"), F.lit("h4").alias("style"))))
        .when(kind == "list", F.to_json(F.struct(F.lit("OL").alias("type"), F.array(name, brand).alias("items"))))
        .when(kind == "quote", F.to_json(F.struct(name.alias("text"), brand.alias("subline1"), sort.alias("type"))))
        .when(kind == "link", F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("https://x.org/"), brand).alias("url"), name.alias("title")).alias("data")).alias("link"))))
        .when(kind == "quiz", F.to_json(F.struct(name.alias("title"), F.create_map(F.lit("1"), sort).alias("items"))))
        .otherwise(F.to_json(F.struct(name.alias("k"))))
    )
    return t.part.select(F.col("p_partkey").alias("post_id"), F.lit(0).alias("idx"), kind.alias("type"), F.parse_json(data).alias("data"))


@query("ar8_typed_blocks", """WITH k AS (SELECT *, ['text', 'header', 'list', 'quote', 'link', 'quiz', 'future'][p_partkey % 7 + 1] AS kind FROM part)
 SELECT p_partkey AS post_id, kind AS type, CASE WHEN kind = 'future' THEN 'unsupported' ELSE 'full' END AS level, CASE WHEN kind IN ('text', 'header', 'quote') THEN p_name END AS text, CASE WHEN kind = 'quote' THEN p_brand END AS author,
   CASE WHEN kind IN ('link', 'quiz') THEN p_name END AS title, CASE WHEN kind = 'link' THEN 'https://x.org/' || p_brand END AS url, CASE WHEN kind = 'header' THEN 4 END AS heading, CASE kind WHEN 'list' THEN p_name || '|' || p_brand WHEN 'quiz' THEN p_type END AS items FROM k""")
def _blocks(t: Tables) -> DataFrame:
    return blocks.normalised(some_blocks(t)).select("post_id", "type", "level", "text", "author", "title", "url", "heading", F.array_join("items", "|").alias("items"))


@query("prj6_media_info", """SELECT p_partkey, lower('AB-' || p_partkey) AS key, CASE WHEN p_partkey % 4 = 0 THEN 'audio' WHEN p_partkey % 4 = 1 OR p_partkey % 4 = 2 THEN 'video' ELSE 'image' END AS kind, p_size AS width,
   CASE p_partkey % 4 WHEN 0 THEN 'mp3' WHEN 1 THEN 'gif' WHEN 2 THEN 'x' ELSE 'jpg' END AS format FROM part WHERE p_size > 5""")
def _media(t: Tables) -> DataFrame:
    r = F.col("p_partkey") % 4
    form = F.when(r == 0, "mp3").when(r == 1, "GIF").when(r == 2, "x").otherwise("jpg")
    data = F.struct(F.when(F.col("p_size") > 5, F.concat(F.lit("AB-"), "p_partkey")).alias("uuid"), form.alias("type"), F.col("p_size").alias("width"), (r == 2).alias("isVideo"))
    info = blocks.media_info(F.parse_json(F.to_json(F.struct(F.when(r == 0, "audio").otherwise("image").alias("type"), data.alias("data")))))
    return t.part.select("p_partkey", info.alias("m")).filter("m is not null").select("p_partkey", "m.key", "m.kind", "m.width", "m.format")


@query("prj17_addresses", """SELECT o_orderkey, 'https://s.org/' || o_custkey || '?comment=' || o_orderkey AS url, CASE WHEN o_orderkey % 3 = 0 THEN 'https://m.org/k' || o_custkey || '/-/format/mp4/' WHEN o_orderkey % 3 = 1 THEN 'http://y.org/z' ELSE 'https://m.org/k' || o_custkey || '/' END AS media FROM orders""")
def _addresses(t: Tables) -> DataFrame:
    r = F.col("o_orderkey") % 3
    key = F.when(r == 1, "http://y.org/z").otherwise(F.concat(F.lit("k"), F.col("o_custkey")))
    return t.orders.select("o_orderkey", blocks.comment_url(F.col("o_custkey"), F.col("o_orderkey"), "https://s.org/").alias("url"), blocks.media_url(key, "https://m.org", F.when(r == 0, "video").otherwise("image")).alias("media"))


@query("t12_video_pages", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || c_custkey || CASE WHEN c_nationkey > 0 THEN '&t=' || c_nationkey || 's' ELSE '' END WHEN 1 THEN 'https://vk.com/video' || c_custkey WHEN 2 THEN 'other' END AS page FROM customer""")
def _videos(t: Tables) -> DataFrame:
    r = F.col("c_custkey") % 4
    page = blocks.video_page(F.when(r == 0, "youtube").when(r == 1, "vk").when(r == 2, "elsewhere"), F.when(r != 3, F.col("c_custkey").cast("string")), F.col("c_nationkey"), F.when(r == 2, "other"))
    return t.customer.select("c_custkey", page.alias("page"))


@query("g8_collapsed_chains", f"""{_UP}, w AS (SELECT id, id % 3 AS grp FROM e WHERE id IN (17, 125, 131, 150, 199)),
 nodes AS (SELECT grp, id FROM w UNION SELECT grp, ancestor FROM up JOIN w USING (id) WHERE ancestor IN (SELECT id FROM e) UNION SELECT grp, up.id FROM up JOIN w ON up.ancestor = w.id),
 kids AS (SELECT n.grp, e.parent AS id, count(*) AS c FROM nodes n JOIN e ON e.id = n.id GROUP BY 1, 2),
 ends AS (SELECT n.grp, n.id FROM nodes n LEFT JOIN kids k ON k.grp = n.grp AND k.id = n.id LEFT JOIN w ON w.grp = n.grp AND w.id = n.id WHERE coalesce(c, 0) <> 1 OR w.id IS NOT NULL),
 under AS (SELECT grp, id FROM ends UNION SELECT grp, up.id FROM ends JOIN up ON up.ancestor = ends.id)
 SELECT n.grp, n.id, u.id IS NULL AS chain FROM nodes n LEFT JOIN under u ON u.grp = n.grp AND u.id = n.id""")
def _g8(t: Tables) -> DataFrame:
    mine = t.part.filter("p_partkey IN (17, 125, 131, 150, 199)").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("grp"))
    return forest.shown(tree(t), mine)
