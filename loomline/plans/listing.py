"""Queries of labels and of what listings tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import labels
from loomline.operators import listing
from loomline.plans.registry import Tables, query

_FORM = "CASE WHEN k % 100 BETWEEN 11 AND 19 THEN 'заказов' WHEN k % 10 = 1 THEN 'заказ' WHEN k % 10 BETWEEN 2 AND 4 THEN 'заказа' ELSE 'заказов' END"
_SIZE = "CASE WHEN v < 1024 THEN format('{:.0f} Б', v) WHEN v < 1048576 THEN format('{:.1f} КБ', v / 1024) WHEN v < 1073741824 THEN format('{:.1f} МБ', v / 1048576) WHEN v < 1099511627776 THEN format('{:.1f} ГБ', v / 1073741824) ELSE format('{:.1f} ТБ', v / 1099511627776) END"


@query("t20_labels", f"""SELECT k AS o_orderkey, replace(format('{{:,}}', k), ',', chr(160)) || ' ' || {_FORM} AS label, replace(format('{{:,}}', m), ',', chr(160)) || chr(160) || '₽' AS sum, {_SIZE} AS size
 FROM (SELECT o_orderkey::BIGINT AS k, floor(o_totalprice)::BIGINT AS m, (o_orderkey::DOUBLE * o_orderkey * o_custkey) AS v FROM orders)""")
def _labels(t: Tables) -> DataFrame:
    bytes_ = F.col("o_orderkey").cast("double") * F.col("o_orderkey") * F.col("o_custkey")
    return t.orders.select(
        "o_orderkey", labels.counted(F.col("o_orderkey"), "заказ", "заказа", "заказов").alias("label"), labels.rubles(F.floor("o_totalprice")).alias("sum"), labels.size(bytes_).alias("size")
    )


@query("m_beta_durations", """SELECT event_id, CASE WHEN s > 0 THEN (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE '' END AS length,
 CASE WHEN value > 0 THEN round_even(6 + 40 * value / (SELECT max(value) FROM events), 0)::INT END AS bar FROM (SELECT event_id, value, round_even(value, 0)::BIGINT AS s FROM events)""")
def _durations(t: Tables) -> DataFrame:
    most = t.events.agg(F.max("value")).scalar()
    return t.events.select("event_id", labels.duration(F.col("value")).alias("length"), labels.bar(F.col("value"), most).alias("bar"))


@query("prj14_live_stats", """SELECT o_orderkey, '{"comments":' || o_custkey || '}' AS counters, CASE WHEN o_orderstatus <> 'F' THEN '{"n":1}' END AS likes, n AS gifts
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _live(t: Tables) -> DataFrame:
    """Likes that are no object, as those of orders with status F, are left out; so are gifts that are no list."""
    gifts = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("g"))
    likes = F.when(F.col("o_orderstatus") == "F", F.lit('"many"')).otherwise('{"n":1}')
    raw = F.format_string('{"counters":{"comments":%d},"likes":%s,"gifts":%s}', F.col("o_custkey"), likes, F.coalesce(F.to_json("g"), F.lit("null")))
    stats = t.orders.join(gifts, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", listing.live_stats(raw).alias("s"))
    return stats.select("o_orderkey", "s.counters", "s.likes", "s.gifts")


@query("prj15_unlisted", "WITH p AS (SELECT c_custkey, max(date_trunc('month', o_orderdate)) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT c_custkey, coalesce(m < (SELECT max(m) FROM p), false) AS unlisted FROM p")
def _unlisted(t: Tables) -> DataFrame:
    seen = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.max(F.date_trunc("month", "o_orderdate")).alias("m"))
    return listing.unlisted(seen, "m").select("c_custkey", "unlisted")


@query("prj16_reference", "SELECT o_orderkey AS id, 'https://posts.example/' || o_orderkey AS url, CASE WHEN o_orderstatus = 'F' THEN coalesce(c_name, '') ELSE o_orderpriority END AS author FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 10 <> 3")
def _reference(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer.filter("c_custkey % 10 != 3"), F.col("c_custkey") == F.col("o_custkey"), "left")
    first = F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(F.col("o_orderpriority"))
    ref = listing.reference(F.col("o_orderkey"), F.lit(None).cast("string"), F.col("o_orderstatus"), F.col("o_orderdate"), first, F.col("c_name"), base="https://posts.example/")
    return j.select(ref.alias("r")).select("r.id", "r.url", "r.author")


@query("prj2_as_answer", "SELECT o_orderkey AS id, o_custkey AS author_id, c_name AS name, '' AS text, o_orderstatus = 'F' AS removed, o_shippriority AS likes FROM (SELECT *, 0 AS o_shippriority FROM orders) LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 10 <> 3")
def _answer(t: Tables) -> DataFrame:
    users = t.customer.filter("c_custkey % 10 != 3").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("nickname"), F.lit("").alias("uri"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"), F.col("o_custkey").alias("author"), none("long").alias("reply_to"), none("int").alias("level"),
        none("string").alias("text"), F.when(F.col("o_orderstatus") == "F", True).alias("removed"), none("boolean").alias("edited"), none("int").alias("likes"),
    )
    return listing.as_answer(rows, users).select("id", F.col("author.id").alias("author_id"), "author.name", "text", F.col("isRemoved").alias("removed"), F.col("likes.counterLikes").alias("likes"))


@query("ar5_overlaid", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'lost' ELSE o_orderstatus END AS status, o_orderpriority AS priority FROM orders")
def _overlaid(t: Tables) -> DataFrame:
    base = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    m = listing.overlaid(base, F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("status"), F.lit("lost"))))
    return t.orders.select("o_orderkey", m["status"].alias("status"), m["priority"].alias("priority"))


@query("f17_catalogue_used", "SELECT type, n FROM (SELECT p_type AS type, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY 1) WHERE n > 0")
def _catalogue(t: Tables) -> DataFrame:
    uses = t.lineitem.filter("l_quantity > 45").groupBy("l_partkey").agg(F.count("*").alias("n"))
    kinds = t.part.join(uses, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy(F.col("p_type").alias("type")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return listing.catalogue(kinds, "used")
