"""Filters, joins, aggregations, windows, paging and set operations over the tables: one query for each kind of operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loomline.functions.calendar import in_days, period
from loomline.operators import counting, setlike
from loomline.operators.listing import accumulated
from loomline.plans.registry import Tables, query

#: The archive's owner: an entry is theirs when its segment or nation says so.
OWNER = 7


def comments(t: Tables) -> DataFrame:
    """orders as comments, with the customer they belong to as the entry, from outside."""
    entries = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).filter("c_custkey % 10 != 3")
    dim = entries.select("c_custkey", F.col("c_name").alias("title"), F.col("c_nationkey").alias("subsite_id"), F.col("n_name").alias("subsite_name"), (F.col("c_mktsegment") == "BUILDING").alias("own"))
    return t.orders.join(dim, F.col("o_custkey") == F.col("c_custkey"), "left")


_COMMENTS = """d AS (SELECT c_custkey, c_name AS title, c_nationkey AS subsite_id, n_name AS subsite_name, (c_mktsegment = 'BUILDING')::INT AS own
 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 3), c AS (SELECT * FROM orders LEFT JOIN d ON o_custkey = c_custkey)"""


def _count_sql(group: str, where: str = "true") -> str:
    return f"""WITH {_COMMENTS} SELECT {group} AS grp, count(*) AS n, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, max(title) AS title,
 max(subsite_id) AS max_subsite, min(subsite_id) AS min_subsite, max(subsite_name) AS subsite_name, max(own) AS own FROM c WHERE {where} GROUP BY 1"""


_LOCAL = "o_orderdate + INTERVAL 3 HOUR"
_OWN = "(coalesce(own, 0) = 1 OR coalesce(subsite_id = 7, false))"
for _name, _args, _sql in (
    ("none", {"by": "none"}, _count_sql("''")),
    ("month", {"by": "month"}, _count_sql(f"strftime({_LOCAL}, '%Y-%m')")),
    ("year", {"by": "year"}, _count_sql(f"strftime({_LOCAL}, '%Y')")),
    ("day", {"by": "day"}, _count_sql(f"strftime({_LOCAL}, '%Y-%m-%d')")),
    ("post", {"by": "post", "key": "o_custkey"}, _count_sql("o_custkey")),
    ("post_author", {"by": "post_author", "key": "subsite_name"}, _count_sql("subsite_name")),
    ("author", {"by": "author", "key": "o_orderpriority"}, _count_sql("o_orderpriority")),
    ("own", {"by": "year", "own": "yes"}, _count_sql(f"strftime({_LOCAL}, '%Y')", _OWN)),
    ("foreign", {"by": "year", "own": "no"}, _count_sql(f"strftime({_LOCAL}, '%Y')", f"NOT {_OWN}")),
):
    query(f"a1_count_{_name}", _sql)(lambda t, a=_args: counting.grouped_count(comments(t), when="o_orderdate", owner=F.lit(OWNER), **a))


@query("a16_count_header", f"""WITH {_COMMENTS}, g AS (SELECT strftime({_LOCAL}, '%Y-%m') AS grp, count(*) AS n, min(o_orderdate) AS f, max(o_orderdate) AS l FROM c GROUP BY 1)
 SELECT count(*) AS groups, sum(n)::BIGINT AS total, min(f) AS first_date, max(l) AS last_date, (SELECT grp FROM g ORDER BY n DESC, grp LIMIT 1) AS top FROM g""")
def _header(t: Tables) -> DataFrame:
    g = counting.grouped_count(comments(t), "month", "o_orderdate")
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("total"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.min_by("grp", F.struct(-F.col("n"), "grp")).alias("top"))


@query("f1_half_open_days", "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-09 21:00:00' AND ts < TIMESTAMP '2024-01-12 21:00:00'")
def _days(t: Tables) -> DataFrame:
    return t.events.filter(in_days(F.col("ts").cast("timestamp"), "2024-01-10", "2024-01-12")).select("event_id", "ts", "value")


@query("f2_year_fills_bounds", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-28 21:00:00' AND o_orderdate < TIMESTAMP '1996-12-31 21:00:00'")
def _year(t: Tables) -> DataFrame:
    since, until, year = "1996-02-29", None, 1996
    return t.orders.filter(in_days(F.col("o_orderdate").cast("timestamp"), since or f"{year}-01-01", until or f"{year}-12-31")).select("o_orderkey")


@query("f3_source_flags", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND user_id % 2 = 0 GROUP BY 1")
def _flags(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type").isin("click", "view") & (F.col("user_id") % 2 == 0)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("f4_foreign_with_null_entry", f"WITH {_COMMENTS} SELECT o_orderkey, title FROM c WHERE NOT {_OWN}")
def _foreign(t: Tables) -> DataFrame:
    return comments(t).filter(~(F.coalesce(F.col("own"), F.lit(False)) | F.coalesce(F.col("subsite_id") == OWNER, F.lit(False)))).select("o_orderkey", "title")


@query("f5_kind_filter", "SELECT lang, source, count(*) AS n FROM documents WHERE lang IN ('de', 'fr') GROUP BY 1, 2")
def _kind(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("lang").isin("de", "fr")).groupBy("lang", "source").agg(F.count("*").alias("n"))


_HISTORY = "h AS (SELECT event_id AS id, user_id AS item_id, ts, CASE event_type WHEN 'click' THEN 'removed' WHEN 'purchase' THEN 'restored' WHEN 'view' THEN 'edit' ELSE 'damaged' END AS event FROM events)"


def history(t: Tables) -> DataFrame:
    """events as a log of an item's history."""
    event = F.when(F.col("event_type") == "click", "removed").when(F.col("event_type") == "purchase", "restored").when(F.col("event_type") == "view", "edit").otherwise("damaged")
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("item_id"), "ts", event.alias("event"))


@query("f6_history_filters", f"WITH {_HISTORY} SELECT id, item_id, event FROM h WHERE event <> 'damaged' AND item_id < 50 AND ts >= TIMESTAMP '2024-01-05 00:00:00'")
def _history_filters(t: Tables) -> DataFrame:
    return history(t).filter("event != 'damaged' and item_id < 50 and ts >= timestamp_ntz '2024-01-05 00:00:00'").select("id", "item_id", "event")


@query("f7_currently_removed", f"WITH {_HISTORY}, l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, id DESC) AS k FROM h WHERE event IN ('removed', 'restored')) SELECT item_id, ts, id FROM l WHERE k = 1 AND event = 'removed'")
def _removed(t: Tables) -> DataFrame:
    return setlike.latest(history(t).filter(F.col("event").isin("removed", "restored")), ["item_id"], ["ts", "id"]).filter("event = 'removed'").select("item_id", "ts", "id")


@query("f8_mine_or_kind", "SELECT p_partkey FROM part WHERE p_type LIKE 'P%' OR p_size > 40")
def _mine(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_type").startswith("P") | (F.col("p_size") > 40)).select("p_partkey")


@query("f9_like_any", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#3%'")
def _like_any(t: Tables) -> DataFrame:
    return t.part.filter("p_brand LIKE ANY ('Brand#1%', 'Brand#3%')").select("p_partkey", "p_brand")


@query("f10_like_any_but_own", "SELECT s_suppkey FROM supplier WHERE (s_name LIKE '%1' OR s_name LIKE '%2') AND s_name <> 'Supplier#000000001'")
def _dropped(t: Tables) -> DataFrame:
    return t.supplier.filter("s_name LIKE ANY ('%1', '%2') AND s_name <> 'Supplier#000000001'").select("s_suppkey")


@query("f11_exists", "SELECT r_regionkey, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 20) AS any_left FROM region")
def _exists(t: Tables) -> DataFrame:
    some = t.nation.filter("n_nationkey > 20").select(F.col("n_regionkey").alias("r_regionkey"), F.lit(True).alias("any_left")).distinct()
    return t.region.join(some, "r_regionkey", "left").select("r_regionkey", F.coalesce("any_left", F.lit(False)).alias("any_left"))


@query("f12_needs_refresh", "SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS at_, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE at_ IS NULL OR n < 2 OR o_orderstatus = 'P' OR o_orderdate >= TIMESTAMP '2001-07-01 00:00:00'")
def _refresh(t: Tables) -> DataFrame:
    state = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("fetched"), F.count("*").alias("n"))
    stale = F.col("fetched").isNull() | (F.col("n") < 2) | (F.col("o_orderstatus") == "P") | (F.col("o_orderdate") >= F.lit("2001-07-01 00:00:00").cast("timestamp_ntz"))
    return t.orders.join(state, F.col("o_orderkey") == F.col("l_orderkey"), "left").filter(stale).select("o_orderkey")


@query("f13_media_todo", "SELECT p_partkey FROM part WHERE (p_size < 10 OR (p_size < 20 AND p_retailprice < 1200)) AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag IN ('A', 'R'))")
def _todo(t: Tables) -> DataFrame:
    used = t.lineitem.filter(F.col("l_returnflag").isin("A", "R")).select(F.col("l_partkey").alias("p_partkey"))
    return t.part.filter("p_size < 10 OR (p_size < 20 AND p_retailprice < 1200)").join(used, "p_partkey", "left_semi").select("p_partkey")


@query("f20_thread_needs", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL AND (l_linenumber > 3 OR l_quantity > 45) AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _needs(t: Tables) -> DataFrame:
    own = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.filter("l_orderkey IS NOT NULL AND (l_linenumber > 3 OR l_quantity > 45)").join(own, "l_orderkey", "left_anti").select("l_orderkey").distinct()


@query("f21_prefix_range", "SELECT p_partkey, p_name FROM part WHERE p_name >= 'blue g' AND p_name < 'blue h'")
def _prefix(t: Tables) -> DataFrame:
    return t.part.filter((F.col("p_name") >= "blue g") & (F.col("p_name") < "blue h")).select("p_partkey", "p_name")


@query("f22_neighbours", "SELECT l_orderkey, l_linenumber, max(q) OVER (PARTITION BY l_orderkey ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_, min(q) OVER (PARTITION BY l_orderkey ORDER BY q RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_ FROM (SELECT *, epoch(l_shipdate)::BIGINT AS q FROM lineitem)")
def _neighbours(t: Tables) -> DataFrame:
    w = W.Window.partitionBy("l_orderkey").orderBy("q")
    rows = t.lineitem.withColumn("q", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")))
    return rows.select("l_orderkey", "l_linenumber", F.max("q").over(w.rangeBetween(W.Window.unboundedPreceding, -1)).alias("before_"), F.min("q").over(w.rangeBetween(1, W.Window.unboundedFollowing)).alias("after_"))


@query("j2_left_enrich", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _enrich(t: Tables) -> DataFrame:
    c = t.customer.filter("c_acctbal > 0")
    places = F.broadcast(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("j3_constant_side_condition", f"WITH {_HISTORY} SELECT id, c_name FROM h LEFT JOIN customer ON event = 'edit' AND c_custkey = item_id")
def _side(t: Tables) -> DataFrame:
    return history(t).join(t.customer, (F.col("event") == "edit") & (F.col("c_custkey") == F.col("item_id")), "left").select("id", "c_name")


@query("j5_usage_inner", "SELECT p_partkey, s_suppkey, count(*) AS uses FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size <= 3 GROUP BY 1, 2")
def _usage(t: Tables) -> DataFrame:
    small = t.part.filter("p_size <= 3")
    return t.lineitem.join(small, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("p_partkey", "s_suppkey").agg(F.count("*").alias("uses"))


@query("j6_nested_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49))")
def _nested(t: Tables) -> DataFrame:
    inner = t.orders.join(t.lineitem.filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return t.customer.join(inner.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("j7_not_exists", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _not_exists(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("j8_only_by_comments", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey IS NOT NULL)")
def _only(t: Tables) -> DataFrame:
    li = t.lineitem.filter("l_orderkey IS NOT NULL")
    return li.filter("l_returnflag = 'R'").select("l_orderkey").distinct().join(li.filter("l_returnflag = 'A'").select("l_orderkey"), "l_orderkey", "left_anti")


@query("j9_orphans", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48 UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def _orphans(t: Tables) -> DataFrame:
    uses = [t.lineitem.filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")), t.lineitem.filter("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))]
    return setlike.orphans(t.part.select("p_partkey"), uses, "p_partkey")


@query("a7_donation_total", "SELECT round(sum(greatest(o_totalprice, coalesce(s, 0))), 2) AS total, count(*) AS posts, sum((coalesce(s, 0) > o_totalprice)::INT)::BIGINT AS by_comments FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _total(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    j = t.orders.join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    more = F.coalesce("s", F.lit(0.0))
    return j.agg(F.round(F.sum(F.greatest("o_totalprice", more)), 2).alias("total"), F.count("*").alias("posts"), F.count_if(more > F.col("o_totalprice")).alias("by_comments"))


@query("j10_scalar_per_post", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders_, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_ FROM customer")
def _scalar(t: Tables) -> DataFrame:
    s = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_"))
    return t.customer.join(s, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders_"), "last_")


@query("j11_examples_per_type", "SELECT p_type, p_partkey, k AS rank FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 5")
def _examples(t: Tables) -> DataFrame:
    return counting.top_k(t.part, ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 5).select("p_type", "p_partkey", "rank")


@query("j12_parent_and_author", "SELECT c.conv_id, c.turn, p.role AS parent_role, length(p.text) AS parent_length FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def _parent(t: Tables) -> DataFrame:
    p = t.conversations.select(F.col("conv_id").alias("pc"), (F.col("turn") + 1).alias("pt"), F.col("role").alias("parent_role"), F.length("text").cast("long").alias("parent_length"))
    return t.conversations.join(p, (F.col("conv_id") == F.col("pc")) & (F.col("turn") == F.col("pt")), "left").select("conv_id", "turn", "parent_role", "parent_length")


@query("j13_trigram_neighbours", """WITH w AS (SELECT DISTINCT p_type AS word FROM part), v AS (SELECT DISTINCT c_mktsegment AS term FROM customer UNION SELECT DISTINCT p_type FROM part),
 a AS (SELECT DISTINCT word, word[i:i + 2] AS g FROM (SELECT word, unnest(range(1, len(word) - 1)) AS i FROM w)), b AS (SELECT DISTINCT term, term[i:i + 2] AS g FROM (SELECT term, unnest(range(1, len(term) - 1)) AS i FROM v))
 SELECT word, term, count(*) AS shared FROM a JOIN b USING (g) GROUP BY 1, 2""")
def _trigram(t: Tables) -> DataFrame:
    v = t.customer.select(F.col("c_mktsegment").alias("term")).distinct().union(t.part.select("p_type").distinct()).distinct()
    return setlike.trigram_neighbours(t.part.select(F.col("p_type").alias("word")).distinct(), v)


_SIDES = "a AS (SELECT * FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 <> 0)"


@query("j15_three_way_classify", f"WITH {_SIDES} SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'old' WHEN a.p_partkey IS NULL THEN 'new' WHEN a.p_size <> b.p_size THEN 'changed' ELSE 'both' END AS side FROM a FULL JOIN b ON a.p_partkey = b.p_partkey")
def _three(t: Tables) -> DataFrame:
    new = t.part.filter("p_partkey % 5 != 0").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return setlike.classify(t.part.filter("p_partkey % 3 != 0"), new, "p_partkey", F.col("o.p_size") == F.col("n.p_size"))


@query("j16_catalog_with_retired", "WITH o AS (SELECT DISTINCT p_brand, min(p_size) OVER (PARTITION BY p_brand) AS v FROM part WHERE p_partkey < 1000), n AS (SELECT DISTINCT p_brand, max(p_size) OVER (PARTITION BY p_brand) AS v FROM part WHERE p_partkey > 500 AND p_brand < 'Brand#4') SELECT coalesce(n.p_brand, o.p_brand) AS p_brand, coalesce(n.v, o.v) AS v, n.p_brand IS NULL AS retired FROM o FULL JOIN n ON o.p_brand = n.p_brand")
def _catalog(t: Tables) -> DataFrame:
    old = t.part.filter("p_partkey < 1000").groupBy("p_brand").agg(F.min("p_size").alias("v"))
    new = t.part.filter("p_partkey > 500 AND p_brand < 'Brand#4'").groupBy("p_brand").agg(F.max("p_size").alias("v"))
    return accumulated(old, new, "p_brand")


@query("a3_events_per_item", f"WITH {_HISTORY} SELECT item_id, sum((event = 'edit')::INT)::BIGINT AS edits, count(*) AS n FROM h GROUP BY 1")
def _per_item(t: Tables) -> DataFrame:
    return history(t).groupBy("item_id").agg(F.count_if(F.col("event") == "edit").alias("edits"), F.count("*").alias("n"))


@query("a4_counts_by_status", "SELECT o_orderstatus, strftime(o_orderdate + INTERVAL 3 HOUR, '%Y') AS y, count(*) AS n FROM orders GROUP BY 1, 2")
def _status(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", period(F.col("o_orderdate"), "year").alias("y")).agg(F.count("*").alias("n"))


@query("a5_usage_by_type", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS posts FROM lineitem GROUP BY 1")
def _by_type(t: Tables) -> DataFrame:
    once = t.lineitem.groupBy("l_returnflag", "l_orderkey").agg(F.count("*").alias("n"))  # two exact steps; a hot type is spread by order first
    return once.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.count("*").alias("posts"))


@query("a6_donors", "SELECT user_id, round(s, 2) AS total, n, last_ FROM (SELECT user_id, sum(value) AS s, count(*) AS n, max(ts) AS last_ FROM events WHERE event_type = 'purchase' GROUP BY 1) ORDER BY round(s, 2) DESC, user_id LIMIT 12")
def _donors(t: Tables) -> DataFrame:
    d = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"), F.max("ts").alias("last_"))
    return d.orderBy(F.desc("total"), "user_id").limit(12)


@query("a8_archive_stats", "SELECT (SELECT count(*) FROM orders) AS posts, (SELECT count(*) FROM lineitem) AS comments, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS authors, (SELECT coalesce(round(sum(value), 2), 0) FROM events WHERE value < 0) AS none_, (SELECT min(o_orderdate) FROM orders) AS first_, (SELECT max(o_orderdate) FROM orders) AS last_")
def _stats(t: Tables) -> DataFrame:
    o = t.orders.agg(F.count("*").alias("posts"), F.min("o_orderdate").alias("first_"), F.max("o_orderdate").alias("last_"))
    c = t.lineitem.agg(F.count("*").alias("comments"), F.count_distinct("l_suppkey").alias("authors"))
    e = t.events.filter("value < 0").agg(F.coalesce(F.round(F.sum("value"), 2), F.lit(0.0)).alias("none_"))
    one = F.lit(1)
    return o.withColumn("k", one).join(c.withColumn("k", one), "k").join(e.withColumn("k", one), "k").drop("k")


_MONTHS = "m AS (SELECT strftime(o_orderdate + INTERVAL 3 HOUR, '%Y-%m') AS ym, o_custkey % 50 AS root, o_orderdate, o_orderkey FROM orders)"


def month_groups(t: Tables) -> DataFrame:
    """orders of a month and a thread, newest first by their last date."""
    m = t.orders.select(period(F.col("o_orderdate"), "month").alias("ym"), (F.col("o_custkey") % 50).alias("root"), "o_orderdate", "o_orderkey")
    g = m.groupBy("ym", "root").agg(F.count("*").alias("n"), F.max(F.struct("o_orderdate", "o_orderkey")).alias("last"), F.array_sort(F.collect_list("o_orderkey")).alias("mine"))
    order = W.Window.partitionBy("ym").orderBy(F.desc("last.o_orderdate"), F.desc("last.o_orderkey"))
    return g.withColumn("pos", F.row_number().over(order) - 1)


_GROUPS = f"{_MONTHS}, g AS (SELECT ym, root, count(*) AS n, max(o_orderdate) AS last_date, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key, list_sort(list(o_orderkey)) AS mine FROM m GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY ym ORDER BY last_date DESC, last_key DESC) - 1 AS pos FROM g)"


@query("w3_month_groups", f"WITH {_GROUPS} SELECT ym, root, n, last_date, pos, mine FROM p")
def _w3(t: Tables) -> DataFrame:
    return month_groups(t).select("ym", "root", "n", F.col("last.o_orderdate").alias("last_date"), F.col("pos").cast("long").alias("pos"), "mine")


@query("p3_greedy_pages", f"""WITH RECURSIVE {_GROUPS},
 s(ym, pos, page, acc) AS (SELECT ym, pos, 1, n FROM p WHERE pos = 0 UNION ALL
   SELECT p.ym, p.pos, CASE WHEN s.acc >= 12 THEN s.page + 1 ELSE s.page END, CASE WHEN s.acc >= 12 THEN p.n ELSE s.acc + p.n END FROM s JOIN p ON p.ym = s.ym AND p.pos = s.pos + 1)
 SELECT ym, pos, page FROM s""")
def _p3(t: Tables) -> DataFrame:
    return counting.greedy_pages(month_groups(t), "ym", "pos", "n", 12)


@query("a9_months", f"""WITH RECURSIVE {_GROUPS},
 s(ym, pos, page, acc, n) AS (SELECT ym, pos, 1, n, n FROM p WHERE pos = 0 UNION ALL
   SELECT p.ym, p.pos, CASE WHEN s.acc >= 12 THEN s.page + 1 ELSE s.page END, CASE WHEN s.acc >= 12 THEN p.n ELSE s.acc + p.n END, p.n FROM s JOIN p ON p.ym = s.ym AND p.pos = s.pos + 1)
 SELECT ym, sum(n)::BIGINT AS comments, count(*) AS groups, max(page) AS pages FROM s GROUP BY 1""")
def _a9(t: Tables) -> DataFrame:
    g = month_groups(t)
    paged = counting.greedy_pages(g, "ym", "pos", "n", 12)
    return g.select("ym", F.col("pos").cast("long").alias("pos"), "n").join(paged, ["ym", "pos"]).groupBy("ym").agg(F.sum("n").alias("comments"), F.count("*").alias("groups"), F.max("page").alias("pages"))


@query("a10_year_bars", "WITH m AS (SELECT strftime(o_orderdate + INTERVAL 3 HOUR, '%Y-%m') AS ym, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT ym[1:4] AS y, sum(n)::BIGINT AS n, max(n) AS top FROM m GROUP BY 1) SELECT y, n, round_even(6 + 40 * n / max(n) OVER (), 0)::BIGINT AS height FROM y")
def _a10(t: Tables) -> DataFrame:
    m = t.orders.groupBy(period(F.col("o_orderdate"), "month").alias("ym")).agg(F.count("*").alias("n"))
    y = m.groupBy(F.left("ym", F.lit(4)).alias("y")).agg(F.sum("n").alias("n"))
    return y.select("y", "n", F.bround(6 + 40 * F.col("n") / F.max("n").over(W.Window.partitionBy()), 0).cast("long").alias("height"))


@query("a11_outcomes", f"WITH {_HISTORY} SELECT item_id % 10 AS part, sum((event = 'removed')::INT)::BIGINT AS removed, sum((event = 'restored')::INT)::BIGINT AS restored, sum((event = 'edit')::INT)::BIGINT AS edit, sum((event = 'damaged')::INT)::BIGINT AS damaged FROM h GROUP BY 1")
def _a11(t: Tables) -> DataFrame:
    return history(t).groupBy((F.col("item_id") % 10).alias("part")).agg(*[F.count_if(F.col("event") == e).alias(e) for e in ("removed", "restored", "edit", "damaged")])


@query("a12_report_buckets", "WITH f AS (SELECT l_returnflag || l_linestatus AS bucket, l_suppkey, min(l_orderkey) AS seq FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seq, l_suppkey) AS r FROM f) SELECT bucket, (SELECT count(*) FROM lineitem WHERE l_returnflag || l_linestatus = bucket) AS n, list(l_suppkey ORDER BY r) AS examples FROM k WHERE r <= 5 GROUP BY 1")
def _a12(t: Tables) -> DataFrame:
    li = t.lineitem.withColumn("bucket", F.concat("l_returnflag", "l_linestatus"))
    first = li.groupBy("bucket", "l_suppkey").agg(F.min("l_orderkey").alias("seq"), F.count("*").alias("n"))
    shown = counting.top_k(first, ["bucket"], [F.col("seq"), F.col("l_suppkey")], 5).groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("examples"))
    return first.groupBy("bucket").agg(F.sum("n").alias("n")).join(shown, "bucket")


@query("a13_max_over_copies", "SELECT o_orderkey, greatest(o_totalprice, coalesce(m, 0)) AS best FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _a13(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("m"))
    return t.orders.join(m, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.greatest("o_totalprice", F.coalesce("m", F.lit(0.0))).alias("best"))


@query("a14_distinct_years", "SELECT DISTINCT strftime(o_orderdate + INTERVAL 3 HOUR, '%Y') AS y FROM orders")
def _a14(t: Tables) -> DataFrame:
    return t.orders.select(period(F.col("o_orderdate"), "year").alias("y")).distinct()


@query("a15_usage_bytes", "SELECT count(*) AS blobs, sum(n_chars)::BIGINT AS bytes FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def _a15(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.filter("toxic = 0"), "doc_id", "left_semi").agg(F.count("*").alias("blobs"), F.sum("n_chars").alias("bytes"))


@query("a17_owners_of_key", "SELECT l_partkey, list_sort(list(DISTINCT l_suppkey)) AS owners FROM lineitem GROUP BY 1")
def _a17(t: Tables) -> DataFrame:
    return t.lineitem.select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.array_sort(F.collect_list("l_suppkey")).alias("owners"))


@query("snk6_capped_owners", "SELECT l_suppkey, list_sort(list(DISTINCT l_partkey))[1:100] AS used_by FROM lineitem GROUP BY 1")
def _capped(t: Tables) -> DataFrame:
    """A sparse export row lists at most 100 owners; the limit is the format's."""
    first = counting.top_k(t.lineitem.select("l_suppkey", "l_partkey").distinct(), ["l_suppkey"], [F.col("l_partkey")], 100)
    return first.groupBy("l_suppkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("used_by"))


@query("w1_latest_event", f"WITH {_HISTORY} SELECT item_id, arg_max(event, (ts, id)) AS event, max(ts) AS ts FROM h GROUP BY 1")
def _w1(t: Tables) -> DataFrame:
    return setlike.latest(history(t), ["item_id"], ["ts", "id"]).select("item_id", "event", "ts")


@query("w2_next_version", f"WITH {_HISTORY} SELECT id, item_id, coalesce(lead(id) OVER (PARTITION BY item_id ORDER BY ts, id), -1) AS next_id FROM h WHERE event = 'edit'")
def _w2(t: Tables) -> DataFrame:
    w = W.Window.partitionBy("item_id").orderBy("ts", "id")
    return history(t).filter("event = 'edit'").select("id", "item_id", F.coalesce(F.lead("id").over(w), F.lit(-1)).alias("next_id"))


@query("w4_bytes_budget", "SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM documents) WHERE before_ < 200000")
def _w4(t: Tables) -> DataFrame:
    return counting.prefix_budget(t.documents.select("doc_id", "source", "n_chars"), [F.col("source"), F.col("doc_id")], "n_chars", 200_000).select("doc_id")


@query("w5_first_seen", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def _w5(t: Tables) -> DataFrame:
    return setlike.latest(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts")


@query("w6_top_posts", "SELECT o_custkey, o_orderkey, k AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 5")
def _w6(t: Tables) -> DataFrame:
    return counting.top_k(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "rank")


@query("w7_day_headers", "SELECT event_id, coalesce(lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> d, true) AS header FROM (SELECT *, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS d FROM events)")
def _w7(t: Tables) -> DataFrame:
    w = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("d", period(F.col("ts"), "day"))
    return e.select("event_id", F.coalesce(F.lag("d").over(w) != F.col("d"), F.lit(True)).alias("header"))


@query("w8_month_navigation", "WITH m AS (SELECT DISTINCT strftime(o_orderdate + INTERVAL 3 HOUR, '%Y-%m') AS ym FROM orders) SELECT ym, lag(ym) OVER (ORDER BY ym) AS prev, lead(ym) OVER (ORDER BY ym) AS next FROM m")
def _w8(t: Tables) -> DataFrame:
    m = t.orders.select(period(F.col("o_orderdate"), "month").alias("ym")).distinct()  # a line a month
    w = W.Window.orderBy("ym")
    return m.select("ym", F.lag("ym").over(w).alias("prev"), F.lead("ym").over(w).alias("next"))


@query("p1_page_three", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _p1(t: Tables) -> DataFrame:
    return counting.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 50)


@query("p2_clamped_page", "SELECT c_custkey, greatest(1, least(c_custkey % 9, ceil(n / 4.0)))::BIGINT AS page FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def _p2(t: Tables) -> DataFrame:
    n = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return n.select("c_custkey", counting.clamp_page(F.col("c_custkey") % 9, F.col("n"), 4).cast("long").alias("page"))


@query("p4_by_comments", "SELECT o_orderkey, count(l_orderkey) AS comments FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 200")
def _p4(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("c"))
    j = t.orders.join(c, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("c", F.lit(0)).alias("comments"))
    return j.orderBy(F.desc("comments"), F.desc("o_orderkey")).limit(200)


@query("p6_group_order", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, o_custkey::VARCHAR LIMIT 50")
def _p6(t: Tables) -> DataFrame:
    g = t.orders.groupBy(F.col("o_custkey").alias("grp")).agg(F.count("*").alias("n"))
    return g.orderBy(*counting.count_order("post")).limit(50).withColumnRenamed("grp", "o_custkey")


@query("p8_history_order", f"WITH {_HISTORY} SELECT id, ts FROM h ORDER BY ts DESC, id DESC LIMIT 500")
def _p8(t: Tables) -> DataFrame:
    return history(t).select("id", "ts").orderBy(F.desc("ts"), F.desc("id")).limit(500)


@query("s1_precedence_union", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'tree' WHEN o_orderkey % 2 = 0 THEN 'thread' ELSE 'feed' END AS src FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 OR o_orderkey % 5 = 0")
def _s1(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("id"))
    return setlike.precedence_union([o.filter("id % 3 = 0").withColumn("src", F.lit("tree")), o.filter("id % 2 = 0").withColumn("src", F.lit("thread")), o.filter("id % 5 = 0").withColumn("src", F.lit("feed"))], "id")


@query("s2_union_archives", "SELECT p_brand AS key_, count(*) AS n FROM (SELECT p_brand FROM part WHERE p_size < 20 UNION ALL SELECT p_brand FROM part WHERE p_size > 10) GROUP BY 1")
def _s2(t: Tables) -> DataFrame:
    return t.part.filter("p_size < 20").select("p_brand").union(t.part.filter("p_size > 10").select("p_brand")).groupBy(F.col("p_brand").alias("key_")).agg(F.count("*").alias("n"))


@query("s3_difference", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber > 2")
def _s3(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderdate < timestamp_ntz '1996-01-01 00:00:00'").select(F.col("o_orderkey").alias("k")).subtract(t.lineitem.filter("l_linenumber > 2").select("l_orderkey"))


@query("s4_context_minus_own", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def _s4(t: Tables) -> DataFrame:
    threads = t.orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    own = t.supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return t.lineitem.join(threads, "l_orderkey", "left_semi").join(own, "l_suppkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("s5_years_of_both", "SELECT year(o_orderdate) AS y FROM orders UNION SELECT year(l_shipdate) FROM lineitem")
def _s5(t: Tables) -> DataFrame:
    return t.orders.select(F.year("o_orderdate").cast("long").alias("y")).union(t.lineitem.select(F.year("l_shipdate").cast("long"))).distinct()


@query("s6_last_wins", "SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _s6(t: Tables) -> DataFrame:
    base = t.customer.select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    return setlike.precedence_union([base, t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))], "k", last_wins=True).select("k", "v")


@query("src13_user_ident", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'id' ELSE 'uri' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR ELSE lower(replace(c_name, '#', '')) END AS value FROM customer")
def _ident(t: Tables) -> DataFrame:
    from loomline.functions.text import user_ident

    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("https://example.org/u/"), "c_custkey")).otherwise(F.concat(F.lit(" @"), F.lower(F.replace("c_name", F.lit("#"), F.lit("")))))
    kind, value = user_ident(text)
    return t.customer.select("c_custkey", kind.alias("kind"), value.alias("value"))


@query("src9_month_slices", "SELECT unnest(range(date_trunc('month', min(ts))::DATE, date_trunc('month', max(ts)::DATE + INTERVAL 2 DAY)::DATE + INTERVAL 1 MONTH, INTERVAL 1 MONTH))::DATE AS slice FROM events")
def _slices(t: Tables) -> DataFrame:
    from loomline.functions.calendar import month_slices

    bounds = t.events.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return bounds.select(F.explode(month_slices(F.col("a"), F.col("b"))).alias("slice"))


@query("snk8_largest_that_fits", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, sum(n_chars + 1) OVER (ORDER BY doc_id) AS upto FROM documents) WHERE upto <= 29700 OR k = 1")
def _fits(t: Tables) -> DataFrame:
    """An answer of 30,000 characters less 300 for its end; the first row always."""
    d = counting.ranged_sum(t.documents.select("doc_id", (F.col("n_chars") + 1).alias("size")), [F.col("doc_id")], "size", "before")
    return d.filter((F.col("before") + F.col("size") <= 29_700) | (F.col("before") == 0)).select("doc_id")
