"""Repair and merging over the tables: conversations are trees of which three copies survive, each damaged by a rule of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators import consistency, guard, media, repair
from loomline.plans.registry import Tables, query
from loomline.sources import buckets


def three(t: Tables, rows: DataFrame) -> DataFrame:
    """rows as each of three sources has them."""
    return rows.withColumn("source", F.explode(F.array(*[F.lit(k) for k in range(3)])))


def copies(t: Tables) -> DataFrame:
    """Fetched at different times; some are missing, a third is whole."""
    c = three(t, t.conversations.select(F.col("conv_id").alias("tree")).distinct())
    return c.filter("(tree + 2 * source) % 7 != 0").select("tree", "source", F.expr("(tree * 7 + source * 5) % 23").cast("long").alias("fetched"), F.expr("(tree + source) % 3 = 0").alias("whole"))


def nodes(t: Tables) -> DataFrame:
    """Turns, each an answer to the one before. A damaged copy has lost some and cannot read others; a whole one shows what vanished upstream."""
    n = three(t, t.conversations.select(F.col("conv_id").alias("tree"), "turn", "text"))
    n = n.withColumn("whole", F.expr("(tree + source) % 3 = 0")).filter("CASE WHEN whole THEN (turn + source) % 6 != 5 ELSE (tree + turn * 3 + source) % 5 != 0 END")
    key = F.expr("tree * 1000 + turn + 1")
    readable = F.expr("whole OR (tree * 3 + turn + source) % 4 != 0")
    version = F.expr("((tree * 7 + source * 5) % 23) % 2").cast("string")
    body = F.when(readable, F.concat("text", F.lit("/"), version))
    return n.select("tree", "source", key.alias("id"), F.when(F.col("turn") > 0, key - 1).alias("parent"), F.col("turn").alias("date"), F.md5(body.cast("binary")).alias("sig"), body.alias("body"))


_TREES = """s AS (SELECT unnest([0, 1, 2]) AS source),
 c AS (SELECT *, (tree * 7 + source * 5) % 23 AS fetched, (tree + source) % 3 = 0 AS whole FROM (SELECT DISTINCT conv_id AS tree FROM conversations), s WHERE (tree + 2 * source) % 7 <> 0),
 n AS (SELECT conv_id AS tree, c.source, c.fetched, conv_id * 1000 + turn + 1 AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn END AS parent, turn AS date,
         CASE WHEN whole OR (tree * 3 + turn + c.source) % 4 <> 0 THEN text || '/' || (c.fetched % 2) END AS body
       FROM conversations JOIN c ON c.tree = conv_id WHERE CASE WHEN whole THEN (turn + c.source) % 6 <> 5 ELSE (tree + turn * 3 + c.source) % 5 <> 0 END),
 l AS (SELECT tree, id, any_value(parent) AS parent, any_value(date) AS date, max(fetched) AS listed, arg_max(struct_pack(source := source, fetched := fetched, body := body), fetched * 10 - source) FILTER (body IS NOT NULL) AS best FROM n GROUP BY tree, id),
 w AS (SELECT tree, max(fetched) FILTER (whole) AS whole_at FROM c GROUP BY tree),
 p AS (SELECT l.*, best.source AS source, best.fetched AS fetched, best.body AS body, parent IS NOT NULL AND parent NOT IN (SELECT id FROM l) AS orphan,
         CASE WHEN best IS NULL THEN 'lost' WHEN whole_at > listed THEN 'gone' WHEN best.fetched < listed THEN 'stale' ELSE 'current' END AS state FROM l JOIN w USING (tree)),
 up AS (SELECT a.id, b.id AS over, b.orphan, b.state, b.parent FROM p a JOIN p b ON b.id = a.parent UNION ALL SELECT up.id, p.id, p.orphan, p.state, p.parent FROM up JOIN p ON p.id = up.parent),
 f AS (SELECT p.*, (SELECT count(*) FROM up WHERE up.id = p.id) AS depth, (SELECT count(*) FROM up WHERE up.id = p.id AND (up.orphan OR up.state IN ('lost', 'stale'))) AS damaged_above FROM p)"""


@query("i6_tree_nodes", f"WITH RECURSIVE {_TREES} SELECT tree, id, parent, depth, source::INTEGER AS source, fetched, md5(body) AS sig, body, state, orphan, damaged_above FROM f")
def _i6_nodes(t: Tables) -> DataFrame:
    return repair.rebuilt(copies(t), nodes(t)).select("tree", "id", "parent", "depth", "source", "fetched", "sig", "body", "state", "orphan", "damaged_above")


@query("i6_tree_outcomes", f"""WITH RECURSIVE {_TREES}, o AS (SELECT tree, arg_max(whole, fetched * 10 - source) AS whole FROM c GROUP BY tree),
 g AS (SELECT tree, count(*) AS nodes, count(body) AS readable, count(DISTINCT source) AS sources, count_if(orphan) AS orphans, count_if(state = 'lost') AS lost, count_if(state = 'stale') AS stale, count_if(state = 'gone') AS gone FROM f GROUP BY tree)
 SELECT d.tree, CASE WHEN o.whole AND coalesce(lost + stale + orphans, 0) = 0 THEN 'restored' WHEN d.tree % 4 <> 0 THEN 'pending' WHEN readable > 0 THEN 'partial' ELSE 'lost' END AS outcome,
  coalesce(nodes, 0) AS nodes, coalesce(lost, 0)::BIGINT AS lost, coalesce(stale, 0)::BIGINT AS stale, coalesce(gone, 0)::BIGINT AS gone, coalesce(orphans, 0)::BIGINT AS orphans, coalesce(sources, 0) AS sources
 FROM (SELECT DISTINCT conv_id AS tree FROM conversations) d LEFT JOIN o USING (tree) LEFT JOIN g USING (tree)""")
def _i6_outcomes(t: Tables) -> DataFrame:
    """One in four trees is no longer upstream."""
    wanted = t.conversations.select(F.col("conv_id").alias("tree")).distinct().withColumn("gone", F.expr("tree % 4 = 0"))
    return repair.outcomes(wanted, copies(t), repair.rebuilt(copies(t), nodes(t)))


_LINES = "li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2)"


def lines(t: Tables) -> DataFrame:
    """lineitem with one row an order and number."""
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")])


_OWN = f"""{_LINES}, o AS (SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS date, CASE WHEN o_orderkey % 5 > 0 THEN 'N' END AS known, o_orderkey % 2 = 0 AS damaged, o_orderkey % 3 = 0 AS gone FROM orders),
 k AS (SELECT l_orderkey AS id, l_linenumber AS source, l_returnflag AS sig, epoch(l_shipdate)::BIGINT AS modified, l_partkey::VARCHAR AS body FROM li WHERE l_linenumber < 4 AND (l_orderkey + l_linenumber) % 3 > 0),
 j AS (SELECT o.*, k.source, k.sig, k.modified, k.body FROM o LEFT JOIN k USING (id) WHERE damaged),
 g AS (SELECT id, any_value(date) AS date, any_value(known) AS known, any_value(gone) AS gone, arg_min(struct_pack(source := source, sig := sig, body := body), source) FILTER (sig = known) AS exact,
   arg_min(struct_pack(source := source, sig := sig, body := body), source) FILTER (body IS NOT NULL) AS first, arg_max(struct_pack(source := source, sig := sig, body := body), modified * 10 - source) FILTER (body IS NOT NULL) AS latest FROM j GROUP BY id),
 h AS (SELECT *, coalesce(known, first.sig) AS expected, CASE WHEN known IS NULL THEN first ELSE exact END AS e FROM g)"""


@query("i6_own_comments", f"WITH {_OWN} SELECT id, year(to_timestamp(date) AT TIME ZONE 'UTC')::INTEGER AS \"year\", CASE WHEN e IS NOT NULL THEN 'restored' WHEN NOT gone THEN 'pending' WHEN latest IS NOT NULL THEN 'partial' ELSE 'lost' END AS outcome, coalesce(e, latest).source::INTEGER AS source, coalesce(e, latest).sig AS sig, coalesce(e, latest).body AS body, expected FROM h")
def _i6_comments(t: Tables) -> DataFrame:
    return repair.comments(*_own(t)).withColumn("source", F.col("source").cast("int"))


def _own(t: Tables) -> tuple[DataFrame, DataFrame]:
    own = t.orders.select(F.col("o_orderkey").alias("id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("date"), F.expr("CASE WHEN o_orderkey % 5 > 0 THEN 'N' END").alias("sig"), F.expr("o_orderkey % 2 = 0").alias("damaged"), F.expr("o_orderkey % 3 = 0").alias("gone"))
    k = lines(t).filter("l_linenumber < 4 AND (l_orderkey + l_linenumber) % 3 > 0")
    return own, k.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("source"), F.col("l_returnflag").alias("sig"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("modified"), F.col("l_partkey").cast("string").alias("body"))


_KEPT = f"""{_LINES}, h AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS kind, l_partkey AS item, CASE WHEN l_linenumber = 5 THEN 'damaged' ELSE 'edit' END AS event, CASE WHEN l_suppkey % 4 > 0 THEN l_linestatus END AS sig,
   CASE WHEN l_linenumber <> 5 AND l_orderkey % 3 > 0 THEN l_suppkey::VARCHAR END AS body, l_linenumber <> 5 AND l_orderkey % 3 = 0 AS damaged FROM li),
 k AS (SELECT l_orderkey * 10 + l_linenumber AS id, source, CASE WHEN (l_partkey + source) % 2 = 0 THEN l_linestatus ELSE 'other' END AS sig, l_suppkey || '/' || source AS body FROM li, (SELECT unnest([0, 1]) AS source) WHERE (l_orderkey + l_linenumber * 2 + source) % 5 > 2),
 g AS (SELECT h.id, min(k.source) AS source, arg_min(k.body, k.source) AS body FROM h JOIN k USING (id) WHERE damaged AND (h.sig IS NULL OR h.sig = k.sig) GROUP BY h.id)"""


def _kept(t: Tables) -> tuple[DataFrame, DataFrame]:
    li = lines(t).withColumn("id", F.expr("l_orderkey * 10 + l_linenumber"))
    h = li.selectExpr(
        "id", "l_returnflag kind", "l_partkey item", "CASE WHEN l_linenumber = 5 THEN 'damaged' ELSE 'edit' END event", "CASE WHEN l_suppkey % 4 > 0 THEN l_linestatus END sig",
        "CASE WHEN l_linenumber != 5 AND l_orderkey % 3 > 0 THEN cast(l_suppkey AS string) END body", "l_linenumber != 5 AND l_orderkey % 3 = 0 damaged",
    )
    k = li.withColumn("source", F.explode(F.array(F.lit(0), F.lit(1)))).filter("(l_orderkey + l_linenumber * 2 + source) % 5 > 2")
    return h, k.selectExpr("id", "source", "CASE WHEN (l_partkey + source) % 2 = 0 THEN l_linestatus ELSE 'other' END sig", "concat(l_suppkey, '/', source) body")


@query("i6_kept_versions", f"""WITH {_KEPT}, m AS (SELECT h.kind, h.item, h.sig, min(h.id) AS id FROM h LEFT JOIN g USING (id) WHERE damaged AND g.id IS NULL GROUP BY 1, 2, 3)
 SELECT id, kind, item, event, sig, body, NULL::VARCHAR AS state, NULL::INTEGER AS source FROM h WHERE NOT damaged
 UNION ALL SELECT id, kind, item, event, sig, g.body, 'restored', g.source::INTEGER FROM h JOIN g USING (id)
 UNION ALL SELECT id, kind, item, 'damaged', sig, NULL, 'lost', NULL FROM m WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.event = 'damaged' AND x.kind = m.kind AND x.item = m.item AND coalesce(x.sig, '') = coalesce(m.sig, ''))""")
def _i6_versions(t: Tables) -> DataFrame:
    return repair.versions(*_kept(t))


@query("m6_damage_ledger", f"""WITH {_OWN}, r AS (SELECT id, expected, CASE WHEN e IS NOT NULL THEN 'restored' WHEN NOT gone THEN 'pending' ELSE 'lost' END AS outcome FROM h),
 a AS (SELECT DISTINCT id % 500 AS item, coalesce(expected, '') AS sig FROM r WHERE outcome = 'lost'), b AS (SELECT DISTINCT o_custkey AS item, 'N' AS sig FROM orders WHERE o_orderkey % 11 = 0)
 SELECT 'comment' AS kind, item, nullif(sig, '') AS sig, 'lost' AS state FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def _m6(t: Tables) -> DataFrame:
    """Items of which the ledger knows some already; several losses are of one item and signature."""
    found = repair.losses("comment", repair.comments(*_own(t))).withColumn("item", F.col("item") % 500)
    ledger = t.orders.filter("o_orderkey % 11 = 0").select(F.lit("comment").alias("kind"), F.col("o_custkey").alias("item"), F.lit("N").alias("sig"), F.lit("lost").alias("state"))
    return repair.recorded(ledger, found, "state")


_LIMIT = "length(text) = n_chars"
CONSTRAINTS = (
    consistency.Holds("documents", "lengths", _LIMIT, "doc_id"), consistency.Holds("documents", "texts", "text != ''", "doc_id"), consistency.Holds("orders", "priced", "o_totalprice > 1000", "o_orderkey"),
    consistency.Unique("lineitem", "l_orderkey"), consistency.Unique("customer", "c_custkey"), consistency.Unique("labels", "doc_id"),
    consistency.Refers("lineitem", "l_orderkey", "orders", "o_orderkey", "l_linenumber < 5"), consistency.Refers("labels", "doc_id", "documents", "doc_id"), consistency.Refers("documents", "doc_id", "labels", "doc_id"),
    consistency.SameCount("open orders are half", "orders", "o_orderstatus = 'O'", "orders", "o_orderstatus <> 'O'"), consistency.SameCount("labelled", "documents", "true", "labels", "quality = 1"),
)


def _unique_sql(table: str, key: str) -> str:
    g = f"SELECT {key} AS k, count(*) AS n FROM {table} GROUP BY 1"
    return f"SELECT '{table}' AS \"table\", 'unique {key}' AS \"constraint\", sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS bad, (SELECT list(k::VARCHAR ORDER BY k::VARCHAR) FROM (SELECT k FROM ({g}) WHERE n > 1 ORDER BY k LIMIT 5)) AS examples FROM ({g})"


def _refers_sql(table: str, column: str, to: str, key: str, where: str = "true") -> str:
    bad = f"{column} NOT IN (SELECT {key} FROM {to})"
    return f"SELECT '{table}', '{column} refers to {to}.{key}', count(*), count_if({bad})::BIGINT, (SELECT list(k::VARCHAR ORDER BY k::VARCHAR) FROM (SELECT DISTINCT {column} AS k FROM {table} WHERE {where} AND {bad} ORDER BY 1 LIMIT 5)) FROM {table} WHERE {where}"


def _holds_sql(table: str, name: str, condition: str, example: str) -> str:
    return f"SELECT '{table}', '{name}', count(*), count_if(NOT coalesce({condition}, false))::BIGINT, list_filter([min({example}) FILTER (NOT coalesce({condition}, false))::VARCHAR], lambda x: x IS NOT NULL) FROM {table}"


@query("i12_constraints", "SELECT \"table\", \"constraint\", rows, bad, coalesce(array_to_string(examples, ' '), '') AS examples FROM (" + " UNION ALL ".join([
    _unique_sql("lineitem", "l_orderkey"), _unique_sql("customer", "c_custkey"), _unique_sql("labels", "doc_id"), _holds_sql("documents", "lengths", _LIMIT, "doc_id"), _holds_sql("documents", "texts", "text != ''", "doc_id"), _holds_sql("orders", "priced", "o_totalprice > 1000", "o_orderkey"),
    _refers_sql("lineitem", "l_orderkey", "orders", "o_orderkey", "l_linenumber < 5"), _refers_sql("labels", "doc_id", "documents", "doc_id"), _refers_sql("documents", "doc_id", "labels", "doc_id"),
    "SELECT 'orders', 'open orders are half', count(*), abs(count_if(o_orderstatus = 'O') - count_if(o_orderstatus <> 'O'))::BIGINT, []::VARCHAR[] FROM orders",
    "SELECT 'documents', 'labelled', a + b, abs(a - b)::BIGINT, []::VARCHAR[] FROM (SELECT (SELECT count(*) FROM documents) AS a, (SELECT count(*) FROM labels WHERE quality = 1) AS b)",
]) + ")")
def _i12(t: Tables) -> DataFrame:
    tables = {n: getattr(t, n) for n in ("documents", "orders", "lineitem", "customer", "labels")}
    return consistency.check(tables, CONSTRAINTS).withColumn("examples", F.array_join("examples", " "))


_FEED = """o AS (SELECT conv_id * 1000 + turn AS key, text, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'gone' END AS state, (conv_id + turn) % 11 = 0 AS damaged, md5(text) AS sig FROM conversations WHERE (conv_id + turn) % 5 <> 0),
 n AS (SELECT conv_id * 1000 + turn AS key, CASE WHEN conv_id % 6 = 5 THEN 1 WHEN conv_id % 6 < 4 THEN 7 END AS author, CASE WHEN turn % 3 = 0 AND conv_id % 3 = 0 THEN '' WHEN turn % 4 = 1 THEN '.' WHEN conv_id % 4 = 0 THEN text || '!' ELSE text END AS text FROM conversations WHERE (conv_id + turn) % 7 <> 0),
 j AS (SELECT coalesce(o.key, n.key) AS key, o.key IS NOT NULL AS old, NOT coalesce(damaged, true) AS sound, o.text AS ot, o.state, o.sig, n.text AS nt, md5(n.text) AS nsig, n.key IS NOT NULL AND coalesce(author = 7, true) AS fresh FROM o FULL JOIN n ON o.key = n.key),
 w AS (SELECT *, CASE WHEN fresh AND sound AND ot <> '' THEN CASE WHEN nt = '' THEN 'removed' WHEN length(trim(ot)) >= 40 AND length(trim(nt)) <= 3 THEN 'wiped' END END AS why FROM j)"""


@query("m3_feed_upsert", f"""WITH {_FEED} SELECT key AS id, CASE WHEN fresh AND why IS NULL THEN NULL ELSE coalesce(state, why) END AS state, CASE WHEN fresh AND why IS NULL THEN nsig ELSE sig END AS sig,
  array_to_string(list_filter([CASE WHEN fresh AND NOT old THEN 'insert' END, CASE WHEN why IS NOT NULL AND state IS NULL THEN 'removed' END, CASE WHEN fresh AND old AND NOT sound THEN 'found' END,
   CASE WHEN fresh AND sound AND why IS NULL AND sig <> nsig THEN 'edit' END, CASE WHEN fresh AND sound AND why IS NULL AND state IS NOT NULL THEN 'restored' END], lambda x: x IS NOT NULL), ' ') AS events FROM w WHERE old OR fresh""")
def _m3(t: Tables) -> DataFrame:
    """A feed that lost texts, changed some and has comments of others, against an archive with damaged and marked ones."""
    no = F.lit(False)
    flags = dict.fromkeys(("moderator", "hidden", "author_deleted", "author_frozen", "removed"), no)
    base = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "conv_id", "turn", "text")
    shaped = lambda d, author, state, damaged: F.struct(author.cast("int").alias("author"), "text", guard.comment_stub(F.col("text"), no, flags).alias("stub"), no.alias("media"), F.md5(F.col("text").cast("binary")).alias("sig"), damaged.alias("damaged"), state.cast("string").alias("state"), F.lit(None).cast("long").alias("state_at"))
    old = base.filter("(conv_id + turn) % 5 != 0").select("key", shaped(base, F.lit(7), F.expr("CASE WHEN (conv_id + turn) % 13 = 0 THEN 'gone' END"), F.expr("(conv_id + turn) % 11 = 0")).alias("o"))
    text = F.expr("CASE WHEN turn % 3 = 0 AND conv_id % 3 = 0 THEN '' WHEN turn % 4 = 1 THEN '.' WHEN conv_id % 4 = 0 THEN concat(text, '!') ELSE text END")
    new = base.filter("(conv_id + turn) % 7 != 0").withColumn("text", text).select("key", shaped(base, F.expr("CASE WHEN conv_id % 6 = 5 THEN 1 WHEN conv_id % 6 < 4 THEN 7 END"), F.lit(None), no).alias("n"))
    merged = buckets.feed_rule(7, 1)(old.join(new, "key", "full_outer")).filter("row is not null")
    return merged.select(F.col("key").alias("id"), "row.state", "row.sig", F.array_join("events", " ").alias("events"))


def _refs(t: Tables) -> DataFrame:
    return t.part.selectExpr("p_partkey AS key", "md5(cast(concat(p_brand, p_size) AS binary)) AS sha256", "CASE p_partkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'pending' ELSE 'done' END AS status")


def _blobs(t: Tables) -> DataFrame:
    files = t.part.filter("p_size % 4 != 0").groupBy("p_brand", "p_size").agg(F.min("p_type").alias("mime"))
    sha = F.md5(F.concat("p_brand", "p_size").cast("binary"))
    return files.select(sha.alias("sha256"), F.col("p_size").cast("long").alias("size"), "mime", F.concat(F.left(sha, F.lit(2)), F.lit("/"), sha).alias("path"))


_INDEX = """b AS (SELECT md5(p_brand || p_size) AS sha256, p_size::BIGINT AS size, min(p_type) AS mime FROM part WHERE p_size % 4 <> 0 GROUP BY p_brand, p_size),
 r AS (SELECT p_partkey AS key, md5(p_brand || p_size) AS sha256, p_partkey % 5 = 0 AS missing FROM part WHERE p_partkey % 5 <> 1),
 x AS (SELECT key, CASE WHEN NOT missing THEN r.sha256 END AS sha256, CASE WHEN NOT missing THEN 'media/' || left(r.sha256, 2) || '/' || r.sha256 END AS path, CASE WHEN NOT missing THEN size END AS size, CASE WHEN NOT missing THEN mime END AS mime, missing FROM r LEFT JOIN b USING (sha256) WHERE missing OR b.sha256 IS NOT NULL)"""


@query("j4_media_index", f"WITH {_INDEX} SELECT * FROM x")
def _j4(t: Tables) -> DataFrame:
    return media.index(_refs(t), _blobs(t))


@query("j4_media_usage", f"WITH {_INDEX} SELECT l_suppkey AS archive, count(*) AS files, sum(size)::BIGINT AS bytes FROM (SELECT DISTINCT l_suppkey, sha256, size FROM lineitem JOIN x ON x.key = l_partkey WHERE NOT missing) GROUP BY 1")
def _j4_usage(t: Tables) -> DataFrame:
    return media.usage(t.lineitem.select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("archive")), media.index(_refs(t), _blobs(t)))


@query("j19_other_owners", "SELECT o_orderkey, o_custkey, s_name AS other FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey AND s_suppkey <> 7")
def _j19(t: Tables) -> DataFrame:
    library = t.supplier.select(F.col("s_suppkey").alias("uid"), F.col("s_name").alias("name"))
    return media.others(t.orders.select("o_orderkey", "o_custkey"), library, 7, "o_custkey")
