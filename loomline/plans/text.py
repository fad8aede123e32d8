"""Text functions, dates and JSON over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import calendar, text
from loomline.operators import setlike
from loomline.plans.registry import Tables, query
from loomline.session import spread


@query("t2_tokens", r"SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM benchmark")
def _tokens(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.token_array(F.col("text")).alias("words"))


@query("t1_norm", "SELECT doc_id, md5(replace(lower(text), 'ё', 'е')) AS h FROM documents")
def _norm(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.norm(F.col("text"))).alias("h"))


@query("a2_vocabulary", r"WITH w AS (SELECT DISTINCT doc_id, f, unnest(regexp_extract_all(lower(x), '[\p{L}\p{N}]+')) AS term FROM (SELECT doc_id, 'b' AS f, text AS x FROM documents UNION ALL SELECT doc_id, 't', text[1:80] FROM documents)) SELECT term, count(*) AS df FROM w GROUP BY 1")
def _vocabulary(t: Tables) -> DataFrame:
    from loomline.operators.search import vocabulary

    docs = t.documents.select("doc_id", F.left("text", F.lit(80)).alias("title"), F.col("text").alias("body"))
    return vocabulary(docs)


@query("f18_vocabulary_filter", r"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) SELECT term FROM w WHERE len(term) BETWEEN 3 AND 40 AND regexp_matches(term, '[a-zа-я]')")
def _filter(t: Tables) -> DataFrame:
    from loomline.operators.search import worth_indexing

    return t.documents.select(F.explode(text.token_array(F.col("text"))).alias("term")).distinct().filter(worth_indexing(F.col("term")))


@query("t8_stemmed_words")
def _stems(t: Tables) -> DataFrame:
    """Each distinct word is stemmed once; documents get their stems by a join."""
    words = spread(t.documents).select(F.explode(text.token_array(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return words.select("term", "n", text.stems_of("term").alias("stems"))


@query("t14_short", r"SELECT page_id, CASE WHEN len(p) > 120 THEN p[1:120] || '…' ELSE p END AS short FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS p FROM pages)")
def _short(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.short(F.col("html"), 120).alias("short"))


@query("t16_guard_norm", r"SELECT conv_id, turn, md5(regexp_replace(trim(regexp_replace(replace(lower(text), 'ё', 'е'), '\s+', ' ', 'g')), '[.!… ]+$', '')) AS h FROM conversations")
def _guard(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.md5(text.guard_norm(F.col("text"))).alias("h"))


_WORDS = r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS x FROM"


@query("t17_spelling_pairs", f"""WITH a AS ({_WORDS} benchmark), b AS ({_WORDS} documents),
 a1 AS (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM a), b1 AS (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM b),
 p AS (SELECT a.x AS word, b1.x AS term FROM a JOIN b1 ON a.x = left(b1.x, i - 1) || substr(b1.x, i + 1)
   UNION SELECT a1.x, b.x FROM a1 JOIN b ON b.x = left(a1.x, i - 1) || substr(a1.x, i + 1)
   UNION SELECT a1.x, b1.x FROM a1 JOIN b1 ON a1.i = b1.i AND left(a1.x, a1.i - 1) || '*' || substr(a1.x, a1.i + 1) = left(b1.x, b1.i - 1) || '*' || substr(b1.x, b1.i + 1)
   UNION SELECT a1.x, b.x FROM a1 JOIN b ON b.x = left(a1.x, i - 1) || substr(a1.x, i + 1, 1) || substr(a1.x, i, 1) || substr(a1.x, i + 2)),
 g AS (SELECT word, term, [substr(word, k, 3) FOR k IN range(1, len(word) - 1)] AS wg, [substr(term, k, 3) FOR k IN range(1, len(term) - 1)] AS tg FROM p WHERE word <> term)
 SELECT word, term, 1 AS distance FROM g WHERE list_has_any(wg, tg)""")
def _pairs(t: Tables) -> DataFrame:
    """Words of the benchmark with vocabulary terms within distance 1 that share a trigram."""
    words = t.benchmark.select(F.explode(text.token_array(F.col("text"))).alias("word")).distinct()
    terms = spread(t.documents).select(F.explode(text.token_array(F.col("text"))).alias("term")).distinct()
    shared = F.size(F.array_intersect(setlike.trigrams(F.col("word")), setlike.trigrams(F.col("term"))))
    close = setlike.one_edit_neighbours(words, terms).filter((F.col("word") != F.col("term")) & (shared > 0))
    return close.withColumn("distance", text.osa("word", "term", F.lit(1))).filter("distance <= 1").select("word", "term", "distance")


@query("t18_trigrams", "SELECT p_type, list_sort(list(DISTINCT g)) AS grams FROM (SELECT p_type, p_type[i:i + 2] AS g FROM (SELECT p_type, unnest(range(1, len(p_type) - 1)) AS i FROM (SELECT DISTINCT p_type FROM part))) GROUP BY 1")
def _grams(t: Tables) -> DataFrame:
    return t.part.select("p_type").distinct().select("p_type", F.array_sort(setlike.trigrams(F.col("p_type"))).alias("grams")).filter("size(grams) > 0")


@query("t19_layouts", "SELECT DISTINCT c_mktsegment, translate(lower(c_mktsegment), '`qwertyuiop[]asdfghjkl;''zxcvbnm,./', 'ёйцукенгшщзхъфывапролджэячсмитьбю.') AS ru FROM customer")
def _layouts(t: Tables) -> DataFrame:
    return t.customer.select("c_mktsegment").distinct().select("c_mktsegment", text.to_layout(F.lower("c_mktsegment"), "ru").alias("ru"))


@query("t13_slug", "SELECT page_id, left(regexp_replace(regexp_replace(lower(regexp_extract('https://x.org/' || page_id || '-' || url, '/\\d+-([^/?#]+)', 1)), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM pages".replace("\\\\", "\\"))
def _slug(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.slug(F.concat(F.lit("https://x.org/"), "page_id", F.lit("-"), "url")).alias("slug"))


@query("t22_diff_words", r"SELECT conv_id, turn, regexp_extract_all(text, '\s*\S+|\s+') AS words FROM conversations")
def _diff_words(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.regexp_extract_all("text", F.lit(r"\s*\S+|\s+"), F.lit(0)).alias("words"))


@query("dt1_periods", "SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%Y') AS y, strftime(ts + INTERVAL 3 HOUR, '%Y-%m') AS m, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS d, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def _periods(t: Tables) -> DataFrame:
    return t.events.select("event_id", *[calendar.period(F.col("ts"), u).alias(a) for u, a in (("year", "y"), ("month", "m"), ("day", "d"), ("iso", "iso"))])


@query("dt3_day_bounds", "SELECT o_orderkey, epoch(d)::BIGINT - 10800 AS since, epoch(d)::BIGINT - 10800 + 86400 AS until FROM (SELECT o_orderkey, date_trunc('day', o_orderdate) AS d FROM orders)")
def _bounds(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")
    return t.orders.select("o_orderkey", calendar.day_start(day).alias("since"), calendar.day_start(day, end=True).alias("until"))


@query("dt4_next_month", "SELECT o_orderkey, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS next FROM orders")
def _next(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", calendar.next_month(F.to_date("o_orderdate")).alias("next"))


@query("m_alpha_loss_limit", "SELECT c_custkey, greatest(3, least(ceil(n / 10.0), 10))::BIGINT AS lim FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def _limit(t: Tables) -> DataFrame:
    from loomline.operators.guard import loss_limit

    n = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return n.select("c_custkey", loss_limit(F.col("n")).cast("long").alias("lim"))


@query("ar6_json_column", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def _json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("ar2_media_signature", "SELECT p_partkey, CASE WHEN p_size > 5 THEN concat_ws('|', p_size, coalesce(nullif(p_brand, 'Brand#11'), ''), p_type, '') END AS sig FROM part")
def _signature(t: Tables) -> DataFrame:
    parts = [F.col("p_size").cast("string"), F.coalesce(F.nullif(F.col("p_brand"), F.lit("Brand#11")), F.lit("")), F.col("p_type"), F.lit("")]
    return t.part.select("p_partkey", F.when(F.col("p_size") > 5, F.concat_ws("|", *parts)).alias("sig"))


@query("prj9_reaction_pairs", "SELECT l_orderkey, list_transform(list_sort(list({'c': -l_quantity::BIGINT, 'i': l_linenumber::BIGINT})), lambda x: x.i) AS ids, sum(l_quantity)::BIGINT AS total FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def _reactions(t: Tables) -> DataFrame:
    from loomline.functions.records import reaction_pairs, reactions_total

    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("id"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).otherwise(-1).cast("string").alias("count")))).alias("counters"))
    pairs = reaction_pairs(F.col("counters"))
    return rows.select("l_orderkey", F.transform(pairs, lambda x: x["id"]).alias("ids"), reactions_total(pairs).alias("total")).filter("size(ids) > 0")


@query("prj7_block_explode", r"SELECT conv_id, turn, i - 1 AS idx, words[i] AS type, CASE WHEN words[i] IN ('the', 'of', 'and') THEN 'full' WHEN len(words[i]) > 4 THEN 'generic' ELSE 'unsupported' END AS level FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM conversations))")
def _blocks(t: Tables) -> DataFrame:
    """Words of a turn stand for the blocks of a post: exploded with their place, and a level by kind."""
    rows = t.conversations.select("conv_id", "turn", F.posexplode(text.token_array(F.col("text"))).alias("p", "type"))
    level = F.when(F.col("type").isin("the", "of", "and"), "full").when(F.length("type") > 4, "generic").otherwise("unsupported")
    return rows.select("conv_id", "turn", F.col("p").cast("long").alias("idx"), "type", level.alias("level"))


@query("prj13_live_overlay", "SELECT o_orderkey, coalesce(c, 0)::BIGINT AS comments, floor(o_totalprice)::BIGINT AS views FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE n END AS c FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)")
def _overlay(t: Tables) -> DataFrame:
    """Counters of the download, overlaid with those of the latest listing unless the post is lost."""
    live = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    j = t.orders.join(live, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    base = F.create_map(F.lit("comments"), F.lit(0).cast("long"), F.lit("views"), F.floor("o_totalprice"))
    over = F.when((F.col("o_orderstatus") != "F") & F.col("n").isNotNull(), F.create_map(F.lit("comments"), F.col("n"))).otherwise(F.create_map().cast("map<string,bigint>"))
    m = F.map_concat(base, over)
    return j.select("o_orderkey", m["comments"].alias("comments"), m["views"].alias("views"))
