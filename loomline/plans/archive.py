"""Threads, versions, merging and integrity over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators import forest, guard, integrity, setlike, versions
from loomline.plans.registry import Tables, query
from loomline.plans.relational import _HISTORY, history


def tree(t: Tables) -> DataFrame:
    """part as a forest: ten children a key; key 0 is nobody's child."""
    return t.part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 10).cast("long").alias("parent"), F.col("p_size").cast("long").alias("date"))


_UP = "WITH RECURSIVE e AS (SELECT p_partkey AS id, p_partkey // 10 AS parent, p_size::BIGINT AS d FROM part), up(id, ancestor, n) AS (SELECT id, parent, 1 FROM e WHERE parent > 0 UNION ALL SELECT up.id, e.parent, n + 1 FROM up JOIN e ON up.ancestor = e.id WHERE e.parent > 0)"


@query("g2_ancestors", f"{_UP} SELECT id, ancestor, n AS up FROM up")
def _g2(t: Tables) -> DataFrame:
    return forest.ancestors(tree(t))


@query("g3_descendants", f"{_UP} SELECT ancestor AS id, id AS descendant, n AS down FROM up")
def _g3(t: Tables) -> DataFrame:
    return forest.descendants(tree(t))


@query("g1_chains_of_turns", "WITH RECURSIVE e AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations), up(id, ancestor, n) AS (SELECT id, parent, 1 FROM e WHERE parent IS NOT NULL AND parent <> 0 UNION ALL SELECT up.id, e.parent, n + 1 FROM up JOIN e ON up.ancestor = e.id WHERE e.parent IS NOT NULL AND e.parent <> 0) SELECT id, ancestor, n AS up FROM up")
def _g1(t: Tables) -> DataFrame:
    key = F.col("conv_id") * 1000 + F.col("turn")
    return forest.ancestors(t.conversations.select(key.alias("id"), F.when(F.col("turn") > 0, key - 1).alias("parent")))


@query("g4_kept_by_pruning", f"{_UP}, w AS (SELECT id FROM e WHERE id IN (17, 250, 1999)) SELECT id FROM w UNION SELECT ancestor FROM up WHERE id IN (SELECT id FROM w) AND ancestor IN (SELECT id FROM e) UNION SELECT id FROM up WHERE ancestor IN (SELECT id FROM w)")
def _g4(t: Tables) -> DataFrame:
    wanted = t.part.filter("p_partkey IN (17, 250, 1999)").select(F.col("p_partkey").alias("id")).union(t.spark.range(99_999_999, 99_999_999 + 1))
    return forest.keep(tree(t), wanted)


@query("g5_missing", "SELECT c_custkey + 1000 AS id FROM customer WHERE c_custkey + 1000 NOT IN (SELECT p_partkey FROM part)")
def _g5(t: Tables) -> DataFrame:
    return forest.missing(tree(t), t.customer.select((F.col("c_custkey") + 1000).alias("id")))


@query("g6_roots", f"{_UP}, k AS (SELECT id, max(n) AS depth FROM up GROUP BY 1) SELECT e.id, coalesce((SELECT ancestor FROM up WHERE up.id = e.id AND up.n = k.depth), e.id) AS root, coalesce(k.depth, 0)::BIGINT AS depth FROM e LEFT JOIN k ON k.id = e.id WHERE e.id > 0")
def _g6(t: Tables) -> DataFrame:
    return forest.roots(tree(t).filter("id > 0"))


@query("g7_tree_roots", "SELECT p_partkey AS id FROM part WHERE p_partkey // 10 = 0 OR p_partkey // 10 NOT IN (SELECT p_partkey FROM part)")
def _g7(t: Tables) -> DataFrame:
    e = tree(t)
    return e.filter("parent = 0").select("id").union(e.filter("parent != 0").join(e.select(F.col("id").alias("parent")), "parent", "left_anti").select("id"))


@query("g9_subtree_sizes", f"{_UP} SELECT ancestor AS id, count(*) AS n FROM up GROUP BY 1")
def _g9(t: Tables) -> DataFrame:
    return forest.subtree_sizes(tree(t))


@query("g11_preorder", f"""{_UP.replace("WITH RECURSIVE", "WITH RECURSIVE", 1)}, p(id, root, depth, path) AS (SELECT id, id, 0, lpad(d::VARCHAR, 4, '0') || lpad(id::VARCHAR, 9, '0') FROM e WHERE id BETWEEN 1 AND 9
   UNION ALL SELECT e.id, p.root, p.depth + 1, p.path || '/' || lpad(e.d::VARCHAR, 4, '0') || lpad(e.id::VARCHAR, 9, '0') FROM p JOIN e ON e.parent = p.id AND e.id <> p.id) SELECT id, root, depth::BIGINT AS depth, row_number() OVER (PARTITION BY root ORDER BY path) AS place FROM p""")
def _g11(t: Tables) -> DataFrame:
    rows = forest.preorder(tree(t).filter("id > 0").withColumn("parent", F.when(F.col("parent") > 0, F.col("parent"))))
    return rows.select("id", "root", "depth", (F.col("pre") + 1).alias("place"))


@query("m5_events", f"WITH {_HISTORY}, r AS (SELECT *, lag(event) OVER (PARTITION BY item_id ORDER BY ts, id) AS b FROM h WHERE event IN ('removed', 'restored')) SELECT id, item_id, event FROM r WHERE event IS DISTINCT FROM b AND NOT (event = 'restored' AND b IS DISTINCT FROM 'removed')")
def _m5(t: Tables) -> DataFrame:
    return versions.events(history(t), ["item_id"], ["ts", "id"]).select("id", "item_id", "event")


_SIGHT = "s AS (SELECT user_id AS item, ts, (value::BIGINT % 4)::VARCHAR AS sig, event_type = 'error' AS stub FROM events)"


@query("m4_edits", f"WITH {_SIGHT}, p AS (SELECT *, lead(sig) OVER w AS ns, lead(stub) OVER w AS nb, lead(ts) OVER w AS until FROM s WINDOW w AS (PARTITION BY item ORDER BY ts)) SELECT item, sig, min(until) AS seen FROM p WHERE NOT stub AND NOT nb AND sig <> ns GROUP BY 1, 2".replace("value::BIGINT", "floor(value)::BIGINT"))
def _m4(t: Tables) -> DataFrame:
    sight = t.events.select(F.lit("comment").alias("kind"), F.col("user_id").alias("item"), F.col("ts").alias("seen"), (F.floor("value") % 4).cast("string").alias("sig"), (F.col("event_type") == "error").alias("stub"), F.col("props").alias("body"))
    return versions.edits(sight).select("item", "sig", "seen")


@query("m2_upsert_rules", """WITH s AS (SELECT l_orderkey AS id, l_linenumber - 1 AS src, l_linenumber = 3 AS feed, l_quantity::BIGINT AS donation, CASE WHEN l_linenumber > 1 THEN strftime(l_shipdate, '%Y-%m') END AS m, l_shipdate AS data FROM lineitem)
 SELECT id, max(feed::INT) = 1 AS feed, max(donation) AS donation, arg_max(m, src) FILTER (m IS NOT NULL) AS "month", arg_max(data, CASE WHEN feed THEN 10 ELSE -src END) AS data FROM (SELECT DISTINCT ON (id, src) * FROM s ORDER BY id, src, donation, data) GROUP BY 1""")
def _m2(t: Tables) -> DataFrame:
    li = t.lineitem.groupBy(F.col("l_orderkey").alias("id"), "l_linenumber").agg(F.min(F.struct(F.col("l_quantity").cast("long").alias("donation"), F.col("l_shipdate").alias("data"))).alias("x"))
    rows = li.select("id", (F.col("l_linenumber") - 1).alias("src"), (F.col("l_linenumber") == 3).alias("feed"), F.col("x.donation").alias("donation"), F.lit(0).alias("donated"), F.lit(0).alias("hist"), F.when(F.col("l_linenumber") > 1, F.date_format("x.data", "yyyy-MM")).alias("month"), F.col("x.data").alias("data"))
    return versions.upsert_comments(rows).select("id", "feed", "donation", "month", "data")


@query("m1_merge_trees", """WITH o AS (SELECT conv_id * 1000 + turn AS id, turn AS d, text FROM conversations WHERE (conv_id + turn) % 5 <> 0), n AS (SELECT conv_id * 1000 + turn AS id, turn AS d, CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 4 = 0 THEN text || '!' ELSE text END AS text FROM conversations WHERE (conv_id + turn) % 7 <> 0)
 SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'gone' WHEN o.id IS NOT NULL AND n.text = '' AND o.text <> '' THEN 'removed' END AS state,
  CASE WHEN n.id IS NULL OR (o.id IS NOT NULL AND n.text = '' AND o.text <> '') THEN 'removed' WHEN o.id IS NOT NULL AND o.text <> n.text AND o.text <> '' AND n.text <> '' THEN 'edit' END AS event, length(CASE WHEN n.id IS NULL OR (o.id IS NOT NULL AND n.text = '' AND o.text <> '') THEN o.text ELSE n.text END)::BIGINT AS size
 FROM o FULL JOIN n ON o.id = n.id""")
def _m1(t: Tables) -> DataFrame:
    no = F.lit(False)
    flags = dict.fromkeys(("moderator", "hidden", "author_deleted", "author_frozen", "removed"), no)
    base = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("turn").alias("date"), "text", "conv_id", "turn")
    shaped = lambda d: d.select("id", "date", "text", guard.comment_stub(F.col("text"), no, flags).alias("stub"), no.alias("media"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("long").alias("state_at"))
    new = base.filter("(conv_id + turn) % 7 != 0").withColumn("text", F.when(F.col("conv_id") % 3 == 0, "").when(F.col("conv_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    out = versions.merge(shaped(base.filter("(conv_id + turn) % 5 != 0")), shaped(new), 1)
    return out.select("id", "state", "event", F.length("text").cast("long").alias("size"))


@query("m9_absent", "SELECT o_orderkey AS id FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1997-01-01 00:00:00' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)")
def _m9(t: Tables) -> DataFrame:
    own = t.orders.select(F.col("o_orderkey").alias("id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("date"))
    return versions.absent(own, t.lineitem.filter("l_linenumber > 3").select(F.col("l_orderkey").alias("id")), 820_454_400, 852_076_800).select("id")


@query("m8_word_diffs")
def _m8(t: Tables) -> DataFrame:
    """Each user turn against the next one of its conversation."""
    c = t.conversations
    n = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("later"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", versions.word_runs("text", "later").alias("runs"))


@query("m7_signatures", r"""SELECT conv_id, turn, left(sha1('{"media":' || CASE WHEN turn % 3 = 0 THEN '[{"embed":' || turn + 5 || '},{"a":1.5,"b":[{},null,' || to_json('x "' || conv_id || '"') || ']},{"uuid":"u' || turn || '"}]' ELSE '[]' END
  || ',"text":' || to_json(trim(regexp_replace(text, '\s+', ' ', 'g'))) || '}'), 16) AS sig FROM conversations""")
def _m7(t: Tables) -> DataFrame:
    """Turns as documents, of which every third has media: an embedded post, a nested object with keys that do not count, a medium."""
    media = """from_json(concat('[{"type": "osnovaEmbed", "data": {"original_id": ', turn + 5, '}}, {"likes": 3, "b": [{}, null, "x  \\\\"', conv_id, '\\\\" "], "a": 1.50}, {"x": 1, "uuid": "u', turn, '"}]'), 'array<variant>')"""
    raw = F.to_json(F.struct(F.col("text").alias("text"), F.expr(f"CASE WHEN turn % 3 = 0 THEN {media} END").alias("media"), F.col("turn").alias("likes")))
    key = F.concat_ws("/", "conv_id", "turn")
    rows = t.conversations.select("conv_id", "turn", key.alias("key"), raw.alias("raw"))
    return rows.join(versions.signed(rows, "key", "comment"), "key").select("conv_id", "turn", "sig")


@query("m15_queue_new_keys", "SELECT p_partkey FROM part WHERE p_size > 25 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)")
def _m15(t: Tables) -> DataFrame:
    return t.part.filter("p_size > 25").select("p_partkey").join(t.lineitem.filter("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("m17_thread_plan", "SELECT l_suppkey, count(*) AS needs, max(l_shipdate) AS newest FROM lineitem WHERE l_returnflag = 'N' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1")
def _m17(t: Tables) -> DataFrame:
    done = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return t.lineitem.filter("l_returnflag = 'N'").join(F.broadcast(done) if done.count() < 100_000 else done, "l_suppkey", "left_anti").groupBy("l_suppkey").agg(F.count("*").alias("needs"), F.max("l_shipdate").alias("newest"))


@query("m18_scope_footprint", "SELECT count(*) AS n, sum(n_chars)::BIGINT AS bytes, count(DISTINCT source) AS sources FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def _m18(t: Tables) -> DataFrame:
    gone = t.documents.filter("lang = 'en'").join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return gone.agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"), F.count_distinct("source").alias("sources"))


@query("i1_content_dedup", "SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS stored_as, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents")
def _i1(t: Tables) -> DataFrame:
    return integrity.by_content(t.documents).select("doc_id", "sha256", "stored_as", "copies")


@query("i2_probe_dedup", "SELECT a.doc_id AS key, min(b.doc_id) AS same_as FROM documents a JOIN documents b ON a.lang = b.lang AND a.text = b.text AND a.doc_id <> b.doc_id GROUP BY 1")
def _i2(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("key"), F.col("lang").alias("sig"), F.col("text").cast("binary").alias("data"))
    return integrity.probe(d, d)


_FILES = "m AS (SELECT p_partkey AS path, p_brand AS sha, p_size AS size FROM part WHERE p_partkey % 4 <> 0), d AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 10 = 0 THEN 'x' ELSE p_brand END AS sha, CASE WHEN p_partkey % 20 = 0 THEN -1 ELSE p_size END AS size FROM part WHERE p_partkey % 7 <> 0)"


@query("i4_reconcile", f"WITH {_FILES} SELECT coalesce(m.path, d.path) AS path, CASE WHEN m.path IS NULL THEN CASE WHEN d.sha IS NULL THEN 'unreadable' ELSE 'adopted' END WHEN d.path IS NULL THEN 'missing' WHEN d.sha IS NULL THEN 'unreadable' WHEN m.sha = d.sha THEN 'ok' WHEN m.size = d.size THEN 'damaged' ELSE 'stale' END AS status FROM m FULL JOIN d ON m.path = d.path")
def _i4(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("sha"), F.col("p_size").alias("size"))
    disk = p.filter("path % 7 != 0").select("path", F.when(F.col("path") % 9 == 0, None).when(F.col("path") % 10 == 0, "x").otherwise(F.col("sha")).alias("sha"), F.when(F.col("path") % 20 == 0, -1).otherwise(F.col("size")).alias("size"))
    return integrity.reconcile(p.filter("path % 4 != 0"), disk)


@query("i5_best_copy", "SELECT item, arg_max(date_, (ex, date_, -src, body)) AS date_, arg_max(body, (ex, date_, -src, body)) AS body FROM (SELECT l_suppkey AS item, (l_returnflag = CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'Z' END)::INT AS ex, l_shipdate AS date_, l_linenumber AS src, l_orderkey AS body FROM lineitem) GROUP BY 1")
def _i5(t: Tables) -> DataFrame:
    wanted = t.supplier.select(F.col("s_suppkey").alias("item"), F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("Z").alias("sig"))
    c = t.lineitem.select(F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("sig"), F.col("l_shipdate").alias("date"), F.col("l_linenumber").alias("source"), F.col("l_orderkey").alias("body"))
    return integrity.best_copies(wanted, c).select("item", F.col("date").alias("date_"), "body")


@query("i7_due_checks", "SELECT p_partkey FROM (SELECT p_partkey, coalesce(sum(p_size) OVER (ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM part) WHERE b < 5000")
def _i7(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", F.col("p_retailprice").alias("checked_at"), F.col("p_partkey").alias("sha256"), F.col("p_size").alias("size"))
    return integrity.due(p, 5000).select("p_partkey")


@query("i8_settle", "SELECT o_orderkey AS item, CASE WHEN f = o_orderpriority THEN 'exact' WHEN f IS NOT NULL THEN 'replaced' WHEN o_custkey % 4 + 1 >= 3 THEN 'lost' ELSE 'retry' END AS outcome FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'other' END AS f FROM orders)")
def _i8(t: Tables) -> DataFrame:
    repairs = t.orders.select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("expected"), (F.col("o_custkey") % 4).alias("attempts"))
    fresh = t.orders.filter("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("other").alias("sig"))
    return integrity.settle(repairs, fresh).select("item", "outcome")


@query("i9_salvage", "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.o_custkey, b.o_custkey) AS o_custkey FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0 AND o_totalprice > 1000) a FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0 AND o_totalprice > 1000) b ON a.o_orderkey = b.o_orderkey")
def _i9(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return integrity.salvage([o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0")], "o_orderkey", F.col("o_totalprice") > 1000).select("o_orderkey", "o_custkey")


@query("i10_orphans_never_guess", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _i10(t: Tables) -> DataFrame:
    return setlike.orphans(t.documents.select("doc_id"), [t.labels], "doc_id")
