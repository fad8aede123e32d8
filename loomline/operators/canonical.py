"""Canonical text and signatures of JSON documents on the JVM: a recursive walk over VARIANT, and tokens sorted by path.

A document is walked level by level (a recursive relation); every node gives the text that begins it and, if it holds others, the text that ends it, each
under its path: the places of the nodes above among their siblings, keys in code point order. Sorted by path and joined, the tokens of a document
are its JSON without spaces, with sorted keys. What changes by itself is left out on the way: the keys VOLATILE, all of a medium but its uuid, all of
an embedded post but its id; white space in texts counts as one space.

Defined results: a text that is no JSON object has no signature; keys that are not there count as null, false ones of text, title and lists as
empty. Numbers with a fraction are written as a double prints.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.session import configure

# Keys that change by themselves and never make a new version.
VOLATILE = set(
    """counters reactions likes donations donation donate gifts isOnline lastModificationDate collectibles isFavorited dateFavorite isLiked isVoted
    votes viewsCount hits base64preview color hash size external_service isPinned commentsSeenCount subscribedToTreads isSubscribed online _site
    _source""".split()
)
EMBED = "osnovaEmbed"
#: What each kind's content is made of, in the order of its keys.
PARTS = {"post": ("blocks", "customCover", "repost", "title"), "comment": ("media", "text")}
FALSE = ("null", "false", "0", '""', "[]", "{}")
# What counts as white space in Unicode.
_SPACES = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quoted(text: Column) -> Column:
    """A text as JSON writes it: quotes, backslashes and control characters are escaped, all else stays."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rare = plain
    for code in range(32):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(_ESCAPES.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(F.regexp_like(text, F.lit(r"[\x00-\x1f]")), rare).otherwise(plain), F.lit('"'))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def _scalar(v: Column, squeeze: bool = True) -> Column:
    """The text of a node that holds no others."""
    text, shown, kind = F.try_variant_get(v, "$", "string"), F.to_json(v), F.schema_of_variant(v)
    point = F.contains(shown, F.lit("."))
    whole = F.startswith(kind, F.lit("DECIMAL")) & ~point & (F.length(shown) <= 18)  # 1.0; whole numbers of so few digits are no decimals
    return F.when(F.startswith(shown, F.lit('"')), quoted(squeezed(text) if squeeze else text)).when(whole, F.concat(shown, F.lit(".0"))).when(point, F.try_variant_get(v, "$", "double").cast("string")).otherwise(shown)


def _false(v: Column) -> Column:
    return v.isNull() | F.to_json(v).isin(*FALSE)


def _stands_for(v: Column) -> Column:
    """The text that stands for an object as a whole (a medium's uuid, an embedded post's id); null for all else."""
    uuid, kind = F.try_variant_get(v, "$.uuid", "variant"), F.to_json(F.try_variant_get(v, "$.type", "variant"))
    own, inner = F.try_variant_get(v, "$.original_id", "variant"), F.try_variant_get(v, "$.data.original_id", "variant")
    origin = F.when(~_false(own), own).when(~_false(inner), inner)
    is_uuid = F.startswith(F.to_json(uuid), F.lit('"')) & (F.to_json(uuid) != '""')
    is_embed = (F.coalesce(kind == f'"{EMBED}"', F.lit(False)) | own.isNotNull()) & origin.isNotNull()
    return F.when(F.coalesce(is_uuid, F.lit(False)), F.concat(F.lit('{"uuid":'), _scalar(uuid, False), F.lit("}"))).when(is_embed, F.concat(F.lit('{"embed":'), _scalar(origin, False), F.lit("}")))


#: One level: the children of nodes for which nothing stands as a whole, in order.
_WALK = """
WITH RECURSIVE walk(doc, part, path, pos, key, v, depth) MAX RECURSION LEVEL 10000 AS (
  SELECT doc, part, '$', 0, CAST(NULL AS STRING), v, 0 FROM {begin}
  UNION ALL
  SELECT doc, part, concat(path, '.', lpad(CAST(pos AS STRING), 9, '0')), pos, c.key, c.value, depth + 1 FROM (
    SELECT doc, part, path, depth, posexplode(CASE
      WHEN coalesce(startswith(uuid, '"') AND uuid != '""', false) OR ((coalesce(type = '"$EMBED"', false) OR own IS NOT NULL) AND (own NOT IN ($FALSE) OR inner NOT IN ($FALSE))) THEN NULL
      WHEN held IS NOT NULL THEN transform(array_sort(filter(map_keys(held), k -> k NOT IN ($VOLATILE))), k -> struct(k AS key, held[k] AS value))
      ELSE transform(items, x -> struct(CAST(NULL AS STRING) AS key, x AS value)) END) AS (pos, c)
    FROM (
      SELECT doc, part, path, depth, try_variant_get(v, '$', 'map<string,variant>') AS held, try_variant_get(v, '$', 'array<variant>') AS items,
        to_json(try_variant_get(v, '$.uuid', 'variant')) AS uuid, to_json(try_variant_get(v, '$.type', 'variant')) AS type,
        to_json(try_variant_get(v, '$.original_id', 'variant')) AS own, to_json(try_variant_get(v, '$.data.original_id', 'variant')) AS inner
      FROM walk)))
SELECT doc, part, path, pos, key, v FROM walk"""
_listed = lambda words: ", ".join(f"'{w}'" for w in words)
_WALK = _WALK.replace("$EMBED", EMBED).replace("$FALSE", _listed(FALSE).replace("{}", "{{}}")).replace("$VOLATILE", _listed(sorted(VOLATILE)))


def texts(nodes: DataFrame) -> DataFrame:
    """nodes: doc, part, v (a VARIANT; of a document and part there is one) -> doc, part, text: its canonical text. A part without a value is `null`."""
    rows = configure(nodes.sparkSession).sql(_WALK, begin=nodes.select("doc", "part", "v"))
    v = F.col("v")
    whole, is_object, is_array = _stands_for(v), F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.try_variant_get(v, "$", "array<variant>").isNotNull()
    before = F.concat(F.when(F.col("pos") > 0, ",").otherwise(""), F.when(F.col("key").isNull(), "").otherwise(F.concat(quoted(F.col("key")), F.lit(":"))))
    opening = F.when(is_object, F.coalesce(whole, F.lit("{"))).when(is_array, "[").otherwise(F.coalesce(_scalar(v), F.lit("null")))
    closing = F.when(is_object & whole.isNull(), "}").when(is_array, "]")
    token = lambda path, text: F.struct(path.alias("path"), text.alias("text"))
    tokens = rows.select("doc", "part", F.explode(F.array_compact(F.array(token(F.col("path"), F.concat(before, opening)), F.when(closing.isNotNull(), token(F.concat("path", F.lit(".~")), closing))))).alias("t"))
    return tokens.groupBy("doc", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), "").alias("text"))


def _part(kind: str, name: str, v: Column) -> Column:
    """The value of a part of a document's content."""
    get = lambda path: F.try_variant_get(v, path, "variant")
    empty = {"text": '""', "title": '""', "media": "[]", "blocks": "[]"}
    if name == "repost":
        return F.when(~_false(get("$.repostId")), get("$.repostId")).otherwise(get("$.repostData.data.id"))
    return F.when(~_false(get(f"$.{name}")), get(f"$.{name}")).otherwise(F.parse_json(F.lit(empty[name]))) if name in empty else get(f"$.{name}")


def signed(rows: DataFrame, key: str, kind: str, raw: str = "raw") -> DataFrame:
    """key (unique) and sig: the content signature of the JSON text in raw, the first 16 hex digits of the SHA-1 of its content's canonical text."""
    parsed = rows.select(F.col(key).alias("doc"), F.try_parse_json(raw).alias("v")).withColumn("is_object", F.try_variant_get("v", "$", "map<string,variant>").isNotNull())
    parts = parsed.filter("is_object").select("doc", F.explode(F.array(*[F.struct(F.lit(name).alias("part"), _part(kind, name, F.col("v")).alias("v")) for name in PARTS[kind]])).alias("x")).select("doc", "x.part", "x.v")
    whole = texts(parts).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: F.concat(F.lit('"'), p["part"], F.lit('":'), p["text"])), ",").alias("inner"))
    sig = F.left(F.sha1(F.concat(F.lit("{"), "inner", F.lit("}")).cast("binary")), F.lit(16))
    return parsed.select("doc").join(whole.select("doc", sig.alias("sig")), "doc", "left").withColumnRenamed("doc", key)


def plain_text(x) -> str:
    """The same text of one value in Python, for a few documents on the driver: nodes still to write wait on a stack, closing marks among them."""
    out, todo = [], [("", x)]
    while todo:
        before, x = todo.pop()
        out.append(before)
        if x is ...:
            continue
        if isinstance(x, dict):
            data = x.get("data")
            origin = x.get("original_id") or (data.get("original_id") if isinstance(data, dict) else None)
            stands = {"uuid": x["uuid"]} if isinstance(x.get("uuid"), str) and x["uuid"] else {"embed": origin} if origin and (x.get("type") == EMBED or "original_id" in x) else None
            if stands:
                out.append(json.dumps(stands, ensure_ascii=False, separators=(",", ":"), sort_keys=True))
                continue
            inner, marks = [(json.dumps(k, ensure_ascii=False) + ":", x[k]) for k in sorted(x.keys() - VOLATILE)], "{}"
        elif isinstance(x, list):
            inner, marks = [("", y) for y in x], "[]"
        else:
            out.append(json.dumps(" ".join(x.split()) if isinstance(x, str) else x, ensure_ascii=False))
            continue
        out.append(marks[0])
        todo.append((marks[1], ...))
        todo += [("," * (k > 0) + name, y) for k, (name, y) in enumerate(inner)][::-1]
    return "".join(out)


def plain_signature(kind: str, doc: dict) -> str:
    """The signature of one document in Python."""
    repost = doc.get("repostId") or ((doc.get("repostData") or {}).get("data") or {}).get("id")
    value = {"repost": repost, "customCover": doc.get("customCover")} | {name: doc.get(name) or empty for name, empty in (("text", ""), ("title", ""), ("media", []), ("blocks", []))}
    inner = ",".join(f'"{name}":{plain_text(value[name])}' for name in PARTS[kind])
    return hashlib.sha1(f"{{{inner}}}".encode()).hexdigest()[:16]
