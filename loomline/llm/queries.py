"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import centroids, chat_repair, exact_dedup, fertility, jaccard_join, katz, line_crf, mixing, piece_codec, posting_ann, prefix_trie, substring_dedup, url_filter
from loomline.llm.common import table


def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.summary(table(spark, sf_dir, "conversations"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed_sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(concat('11:', coalesce(doc_id::VARCHAR, 'null'))) AS u FROM documents),
 s AS (SELECT src, sum(size)::BIGINT AS size FROM d GROUP BY src),
 w AS (SELECT *, ((row_number() OVER (ORDER BY src IS NULL, src) - 1) % 3 + 1)::DOUBLE AS w, size * 3.0::DOUBLE AS cap FROM s),
 l AS (SELECT *, (sum(size) OVER ()::DOUBLE - sum(cap) OVER (ORDER BY cap / w, src IS NULL, src ROWS UNBOUNDED PRECEDING) + cap)
         / sum(w) OVER (ORDER BY cap / w, src IS NULL, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam,
         row_number() OVER (ORDER BY cap / w, src IS NULL, src) AS k FROM w),
 level AS (SELECT arg_min(lam, k) AS lam FROM l WHERE lam <= cap / w),
 t AS (SELECT src, size, CASE WHEN level.lam IS NULL THEN cap ELSE least(cap, level.lam * w) END AS target FROM l, level),
 p AS (SELECT *, CASE WHEN size > 0 THEN floor(target / size)::BIGINT ELSE 0 END AS whole FROM t),
 q AS (SELECT *, target - whole * size AS more FROM p),
 g AS (SELECT src, u, sum(size)::BIGINT AS size FROM d GROUP BY src, u),
 c AS (SELECT g.src, g.u, q.more, sum(g.size) OVER (PARTITION BY g.src ORDER BY g.u ROWS UNBOUNDED PRECEDING) - g.size / 2 AS mid
       FROM g JOIN q ON g.src IS NOT DISTINCT FROM q.src),
 cut AS (SELECT src, max(u) AS u FROM c WHERE mid <= more GROUP BY src)
SELECT d.doc_id, d.size, q.size AS source_size, q.target,
       CASE WHEN d.size = 0 THEN 0 ELSE d.size * (q.whole + CASE WHEN d.u <= cut.u AND q.more > 0 THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM d JOIN q ON d.src IS NOT DISTINCT FROM q.src LEFT JOIN cut ON d.src IS NOT DISTINCT FROM cut.src
"""


def digits(text) -> F.Column:
    """A number below 2**24 from the MD5 of a text, the same in any engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("long")


def list_entries(pages: DataFrame) -> DataFrame:
    """A log of list entries over the hosts of the pages themselves: four tenths of the hosts are blocked at some minute, half of those are
    taken off again and some come back; a quarter of the domains above are blocked; an eighth of the first path segments are allowed."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p")).filter("h != ''")
    host = hosts.select("h").distinct().withColumn("k", digits(F.col("h")) % 10)
    begin = digits(F.concat(F.lit("a"), "h")) % 400_000
    end = begin + 1 + digits(F.concat(F.lit("r"), "h")) % 80_000
    entry = lambda rows, rule, verdict, action, at: rows.select(rule.alias("rule"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), at.alias("at"))
    rule = F.col("h")
    domain = hosts.select(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1).alias("h")).distinct().filter("h != ''").filter(digits(F.concat(F.lit("d"), "h")) % 4 == 0)
    path = hosts.filter("size(p) > 0").select(F.concat("h", F.lit("/"), F.element_at("p", 1)).alias("h")).distinct().filter(digits(F.col("h")) % 8 == 0)
    parts = [
        entry(host.filter("k < 4"), rule, "block", "add", begin),
        entry(host.filter("k < 2"), rule, "block", "remove", end),
        entry(host.filter("k = 0"), rule, "block", "add", end + 50_000),
        entry(domain, rule, "block", "add", begin),
        entry(path, rule, "allow", "add", begin),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page counts as fetched at a minute of the year that comes from its URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", digits(F.concat(F.lit("t"), "url")) % 525_600)
    out = url_filter.judge(captures, list_entries(pages))
    return out.select("page_id", "url", "fetched", F.col("__verdict").alias("verdict"), F.col("__rule").alias("rule"), F.col("__active").cast("long").alias("active"))


OP3_SQL = r"""
WITH c AS (SELECT page_id, url, ('0x' || substr(md5('t' || url), 1, 6))::BIGINT % 525600 AS fetched,
    lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*?)\.?(?::\d*)?(?:[/?#]|$)', 1)) AS h,
    list_filter(string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages),
 hosts AS (SELECT DISTINCT h, ('0x' || substr(md5(h), 1, 6))::BIGINT % 10 AS k FROM c WHERE h <> ''),
 t AS (SELECT h, k, 'host' AS kind FROM hosts
       UNION ALL SELECT DISTINCT regexp_extract(h, '([^.]+\.[^.]+)$', 1), 0, 'domain' FROM c WHERE regexp_extract(h, '([^.]+\.[^.]+)$', 1) <> ''
       UNION ALL SELECT DISTINCT h || '/' || p[1], 0, 'path' FROM c WHERE h <> '' AND len(p) > 0),
 d AS (SELECT *, ('0x' || substr(md5('a' || h), 1, 6))::BIGINT % 400000 AS b, ('0x' || substr(md5('r' || h), 1, 6))::BIGINT % 80000 AS r FROM t
       WHERE kind = 'host' OR (kind = 'domain' AND ('0x' || substr(md5('d' || h), 1, 6))::BIGINT % 4 = 0) OR (kind = 'path' AND ('0x' || substr(md5(h), 1, 6))::BIGINT % 8 = 0)),
 e AS (SELECT h AS rule, 'block' AS verdict, 'add' AS action, b AS minute FROM d WHERE kind = 'host' AND k < 4
       UNION ALL SELECT h, 'block', 'remove', b + 1 + r FROM d WHERE kind = 'host' AND k < 2
       UNION ALL SELECT h, 'block', 'add', b + 1 + r + 50000 FROM d WHERE kind = 'host' AND k = 0
       UNION ALL SELECT h, 'block', 'add', b FROM d WHERE kind = 'domain'
       UNION ALL SELECT h, 'allow', 'add', b FROM d WHERE kind = 'path'),
 l AS (SELECT rule, minute, max(action || ':' || verdict) AS x FROM e GROUP BY rule, minute),
 v AS (SELECT rule, split_part(x, ':', 2) AS verdict, split_part(x, ':', 1) AS action, minute AS f, lead(minute) OVER (PARTITION BY rule ORDER BY minute) AS u FROM l),
 keys AS (SELECT DISTINCT url, fetched, unnest(list_concat(
            [array_to_string(string_split(h, '.')[i:], '.') FOR i IN range(1, len(string_split(h, '.')) + 1)],
            [h || '/' || array_to_string(p[1:j], '/') FOR j IN range(1, len(p) + 1)])) AS rule FROM c WHERE h <> ''),
 a AS (SELECT url, fetched, v.rule, verdict, row_number() OVER (PARTITION BY url, fetched ORDER BY len(regexp_split_to_array(v.rule, '[./]')) DESC, verdict <> 'block', v.rule) AS k,
              count(*) OVER (PARTITION BY url, fetched) AS n
       FROM keys JOIN v USING (rule) WHERE action = 'add' AND f <= fetched AND (u IS NULL OR fetched < u))
SELECT c.page_id, c.url, c.fetched, coalesce(a.verdict, 'none') AS verdict, a.rule, coalesce(a.n, 0) AS active FROM c LEFT JOIN a ON a.url = c.url AND a.fetched = c.fetched AND a.k = 1
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM d
"""


def piece_model() -> str:
    """The default vocabulary: the file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())


def op6_posting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.trimmed(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    out = line_crf.scored(docs, model)
    return out.select("doc_id", (line_crf.part_of("doc_id", 4) == 2).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= line_crf.THRESHOLD).cast("int").alias("predicted"))


def op11_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return fertility.judged(docs, piece_model(), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    """Each round as a relation of its own: places, then the centroids they give."""
    parts = [
        """v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
     c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT sha256('2:' || vec_id) AS h, q FROM v ORDER BY h LIMIT 40))"""
    ]
    for k in range(6):
        parts.append(
            f"""p{k} AS (SELECT vec_id, any_value(q) AS q, min(d * 64 + c) % 64 AS c, min(d) AS d
          FROM (SELECT v.vec_id, v.q, c{k}.c, list_sum(list_transform(list_zip(v.q, c{k}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{k}) GROUP BY vec_id)"""
        )
        if k < 5:
            parts.append(
                f"""m{k} AS (SELECT c, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END::BIGINT ORDER BY j) AS q
          FROM (SELECT c, j, sum(q[j])::BIGINT AS s, count(*)::BIGINT AS n FROM p{k}, range(1, 65) r(j) GROUP BY c, j) GROUP BY c),
     c{k + 1} AS (SELECT c{k}.c, coalesce(m{k}.q, c{k}.q) AS q FROM c{k} LEFT JOIN m{k} USING (c))"""
            )
    return "WITH " + ",\n     ".join(parts) + """
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c5.q, ',')) AS centroid_sha256 FROM p5 JOIN c5 USING (c)
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS r, coalesce(text, '') AS x
           FROM conversations WHERE conv_id IS NOT NULL),
 k AS (SELECT c, max(pos) AS n, c - c % 100 AS b,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
           lambda a, z: list_reduce(list_prepend(xor(a, z), range(8)), lambda y, i: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h
       FROM t GROUP BY c),
 r AS (SELECT k.c, t.pos AS d, r, x FROM k JOIN t ON t.c = k.b AND t.pos <= k.h
       UNION ALL SELECT k.c, least(k.h, coalesce(o.n, 0)) + t.pos - k.h, r, x FROM k JOIN t USING (c) LEFT JOIN k o ON o.c = k.b WHERE t.pos > k.h),
 p AS (SELECT c, d, x, array_to_string(list(md5(len(r) || ':' || r || x)) OVER (PARTITION BY c ORDER BY d), ' ') AS path FROM r
       UNION ALL SELECT c, 0, '', '' FROM k),
 q AS (SELECT *, max(d) OVER (PARTITION BY c) AS n, lag(path) OVER (PARTITION BY c ORDER BY d) AS up FROM p),
 e AS (SELECT d, path, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(len(x)) AS own,
              sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM q GROUP BY d, path),
 f AS (SELECT e.*, (SELECT count(*) FROM e g WHERE g.d = e.d + 1 AND g.up = e.path) AS n_children FROM e),
 s AS (SELECT q.d, q.path, sum((f.n_children = 0)::INT) AS n_leaves, sum(f.own) AS saved_tokens FROM f JOIN q ON q.c = f.conv_id AND q.d <= f.d GROUP BY q.d, q.path)
SELECT f.conv_id, f.d::BIGINT AS depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.d = f.d AND s.path = f.path LEFT JOIN e g ON g.d = f.d - 1 AND g.path = f.up
"""


def queries() -> dict:
    return {
        "op1_chat_repair": op1_chat_repair,
        "op2_mix_sources": op2_mix_sources,
        "op3_url_filter": op3_url_filter,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_posting_ann": op6_posting_ann,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_katz_score": op8_katz_score,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_quality_crf": op10_quality_crf,
        "op11_fertility": op11_fertility,
        "op12_centroids": op12_centroids,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict:
    return {"op2_mix_sources": OP2_SQL, "op3_url_filter": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op12_centroids": _op12_sql(), "op13_prefix_trie": OP13_SQL}
