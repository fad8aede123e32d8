"""The read model: raw documents of an archive to denormalised tables, each bullet one DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loomline.functions.calendar import period
from loomline.functions.markup import comment_to_text, to_text
from loomline.functions.records import block_level, first_of, lead, money, reaction_pairs
from loomline.operators import counting, forest, setlike, versions
from loomline.sources import raw, sinks

#: A page of a month begins anew when it holds so many own comments.
PAGE_SIZE = 300
COUNTERS = "array<struct<id:string,count:string>>"
AUTHOR = "struct<id:bigint,name:string,nickname:string,uri:string>"
COMMENT = f"id bigint, replyTo bigint, level int, author {AUTHOR}, date bigint, text string, media array<variant>, reactions struct<counters:{COUNTERS}>, replyCount int, entry struct<id:bigint,title:string,subsiteId:bigint,subsiteName:string>, donation string, donations struct<amount:string>"
POST = f"id bigint, date bigint, title string, url string, counters struct<comments:int>, reactions struct<counters:{COUNTERS}>, donations struct<amount:string>, customCover variant, cover variant, blocks array<struct<type:string,hidden:boolean,data:variant>>"
ITEMS = f"items array<struct<{', '.join(x.replace(' ', ':', 1) for x in COMMENT.split(', '))}>>".replace(", ", ",")
THREAD = f"entryId bigint, {ITEMS}"


def field(data: Column, name: str) -> Column:
    return F.try_variant_get(data, f"$.{name}", "string")


def slim(rows: DataFrame) -> DataFrame:
    """The columns of a comment that the model keeps, from the nested document c."""
    c = F.col("c")
    return rows.select(
        "src", "thread", c["id"].alias("id"), F.coalesce(c["replyTo"], F.lit(0)).alias("reply_to"), F.coalesce(c["level"], F.lit(0)).alias("level"), F.coalesce(c["date"], F.lit(0)).alias("date"),
        c["author"].alias("author"), c["text"].alias("text"), (F.coalesce(F.size(c["media"]), F.lit(0)) > 0).alias("has_media"), reaction_pairs(c["reactions"]["counters"]).alias("rx"),
        F.coalesce(c["replyCount"], F.lit(0)).alias("reply_count"), c["entry"].alias("entry"), money(c["donation"]).alias("donation"), money(c["donations"]["amount"]).alias("donated"),
    )


class Archive:
    """Raw folders of one archive: posts/, post-trees/, my-comments/, threads/."""

    def __init__(self, spark: SparkSession, root: str, owner: int):
        self.spark, self.root, self.owner = spark, root, owner

    def posts(self, stats: DataFrame | None = None) -> DataFrame:
        """Posts with lead, cover, plain text and counters; stats (id, comments, donations, rx) of the latest listing overlay them."""
        p = raw.documents(self.spark, f"{self.root}/posts/*.json.gz", POST)
        texts = F.transform(F.coalesce("blocks", F.array().cast(p.schema["blocks"].dataType)), lambda b: F.concat_ws("\n", *[field(b["data"], k) for k in ("text", "subline1", "title", "description")]))
        leads = F.transform(F.filter(F.coalesce("blocks", F.array().cast(p.schema["blocks"].dataType)), lambda b: (b["type"] == "text") & ~F.coalesce(b["hidden"], F.lit(False))), lambda b: field(b["data"], "text"))
        media = F.transform(F.filter("blocks", lambda b: b["type"] == "media"), lambda b: F.try_variant_get(b["data"], "$.items[0].image.data.uuid", "string"))
        cover = first_of(F.try_variant_get("customCover", "$.data.uuid", "string"), F.try_variant_get("cover", "$.data.uuid", "string"), F.element_at(F.filter(media, lambda m: m.isNotNull()), 1))
        out = p.select(
            "id", "date", F.coalesce("title", F.lit("")).alias("title"), "url", lead(F.transform(leads, lambda x: F.regexp_replace(x, "<[^>]+>", ""))).alias("lead"), cover.alias("cover"),
            F.coalesce("counters.comments", F.lit(0)).alias("comments"), reaction_pairs(F.col("reactions.counters")).alias("rx"), money(F.col("donations.amount")).alias("donations"), F.array_join(F.filter(texts, lambda x: x != ""), "\n").alias("markup"),
        ).withColumn("body", to_text("markup")).drop("markup")
        if stats is None:
            return out.withColumn("stats_at", F.lit(None).cast("long"))
        live = stats.select("id", F.col("comments").alias("c"), F.col("donations").alias("d"), F.col("rx").alias("r"), "stats_at")
        return out.join(live, "id", "left").withColumns({"comments": F.coalesce("c", "comments"), "donations": F.coalesce("d", "donations"), "rx": F.coalesce("r", "rx")}).drop("c", "d", "r")

    def blocks(self) -> DataFrame:
        p = raw.documents(self.spark, f"{self.root}/posts/*.json.gz", POST)
        kind = F.coalesce("col.type", F.lit("?"))
        return p.select(F.col("id").alias("post_id"), F.posexplode("blocks")).select("post_id", F.col("pos").alias("idx"), kind.alias("type"), block_level(kind).alias("level"))

    def sightings(self) -> DataFrame:
        """All copies of comments: of trees (0), of threads (1), of the owner's feed (2, newest of repeated ids)."""
        trees = raw.documents(self.spark, f"{self.root}/post-trees/*.json.gz", ITEMS).withColumn("thread", F.regexp_extract(F.input_file_name(), r"(\d+)\.json\.gz$", 1).cast("long"))
        threads = raw.documents(self.spark, f"{self.root}/threads/*.json.gz", THREAD).withColumnRenamed("entryId", "thread")
        feed = raw.lines(self.spark, f"{self.root}/my-comments/*.jsonl.gz", COMMENT)
        columns = [F.col(x.split(" ")[0]) for x in COMMENT.split(", ") if " " in x]
        nested = feed.select(F.lit(2).alias("src"), F.col("entry.id").alias("thread"), F.struct(*columns).alias("c"))
        every = trees.select(F.lit(0).alias("src"), "thread", F.explode("items").alias("c"))
        every = slim(every).unionByName(slim(threads.select(F.lit(1).alias("src"), "thread", F.explode("items").alias("c")))).unionByName(slim(nested))
        return every.groupBy("src", "id").agg(F.max_by(F.struct(*[c for c in every.columns if c not in ("src", "id")]), "date").alias("x")).select("src", "id", "x.*")

    def comments(self) -> DataFrame:
        """One row a comment by the rules of the upsert; month only for the feed's."""
        s = self.sightings()
        rows = s.select(
            "id", "src", (F.col("src") == 2).alias("feed"), "donation", "donated", F.lit(0).alias("hist"), F.when(F.col("src") == 2, period(F.timestamp_seconds("date"), "month")).alias("month"),
            F.struct("text", "rx", "has_media", "entry", "reply_count").alias("data"), F.coalesce("thread", "entry.id").alias("entry_id"), "reply_to", "level", "date", F.col("author.id").alias("author"),
        )
        return versions.upsert_comments(rows).withColumn("mine", F.col("author") == self.owner)

    def users(self) -> DataFrame:
        """Authors as first seen: trees before threads before the feed, then by date."""
        s = self.sightings().filter("author.id is not null")
        return s.groupBy(F.col("author.id").alias("id")).agg(F.min_by("author", F.struct("src", "date", "id")).alias("a")).select("id", "a.name", "a.nickname", "a.uri")

    def entries(self, posts: DataFrame) -> DataFrame:
        own = posts.select("id", "title", F.lit(self.owner).cast("long").alias("subsite_id"), F.lit(None).cast("string").alias("subsite_name"), F.lit(True).alias("own"))
        seen = self.sightings().filter("src = 2 and entry.id is not null")
        other = seen.groupBy(F.col("entry.id").alias("id")).agg(F.max_by("entry", F.struct("date", F.col("id"))).alias("e")).select("id", "e.title", F.col("e.subsiteId").alias("subsite_id"), F.col("e.subsiteName").alias("subsite_name"), F.lit(False).alias("own"))
        return setlike.precedence_union([own, other], "id")

    def month_groups(self, comments: DataFrame, posts: DataFrame) -> DataFrame:
        """Own comments of the feed by month, post and thread root, newest first, with page numbers."""
        feed = comments.filter("feed")
        there = comments.filter("entry_id is not null")
        replies = there.select(F.col("reply_to").alias("id")).distinct().withColumn("has_replies", F.lit(True))
        fetched = self.sightings().filter("src < 2").select("id", F.col("reply_to").alias("parent"))
        rooted = feed.join(forest.roots(fetched), "id", "left").join(replies, "id", "left").join(posts.select(F.col("id").alias("entry_id"), F.lit(True).alias("own")), "entry_id", "left")
        g = rooted.groupBy(F.col("month").alias("ym"), "entry_id", F.coalesce("root", "id").alias("root_id")).agg(
            F.array_sort(F.collect_list("id")).alias("mine"), F.max(F.struct("date", "id")).alias("newest"), F.max(F.coalesce("has_replies", F.lit(False))).alias("has_replies"),
            F.max("data.has_media").alias("has_media"), F.max(F.coalesce("own", F.lit(False))).alias("own"),
        )
        w = W.Window.partitionBy("ym").orderBy(F.desc("newest"))
        g = g.withColumns({"pos": (F.row_number().over(w) - 1).cast("long"), "size": F.size("mine"), "last_date": F.col("newest.date")}).drop("newest")
        return g.join(counting.greedy_pages(g, "ym", "pos", "size", PAGE_SIZE), ["ym", "pos"]).drop("size")

    def tables(self, stats: DataFrame | None = None) -> dict[str, DataFrame]:
        posts, comments = self.posts(stats), self.comments()
        groups = self.month_groups(comments, posts)
        months = groups.groupBy("ym").agg(F.sum(F.size("mine")).alias("comments"), F.count("*").alias("groups"), F.max("page").alias("pages"))
        located = groups.select(F.explode("mine").alias("id"), "ym", "page")
        return {"posts": posts, "comments": comments, "users": self.users(), "entries": self.entries(posts), "month_groups": groups, "months": months, "comment_loc": located, "post_blocks": self.blocks(), "search_docs": self.search_docs(posts, comments)}

    def search_docs(self, posts: DataFrame, comments: DataFrame) -> DataFrame:
        """Posts (p), the owner's comments of the feed (c), all others (o)."""
        p = posts.select((F.col("id") * 2).alias("doc_id"), F.lit("p").alias("kind"), F.col("id").alias("ref"), F.col("id").alias("entry"), "date", F.lit(self.owner).cast("long").alias("author"), "title", "body")
        c = comments.select((F.col("id") * 2 + 1).alias("doc_id"), F.when(F.col("feed"), "c").otherwise("o").alias("kind"), F.col("id").alias("ref"), F.col("entry_id").alias("entry"), "date", "author", F.lit("").alias("title"), comment_to_text("data.text").alias("body"))
        return p.unionByName(c)

    def build(self, out: str, stats: DataFrame | None = None) -> str:
        """Write all tables and publish them together."""
        return sinks.publish(self.tables(stats), out)


def donations(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(id, site, by_comments, total): a post's donations are the larger of the site's sum and that of its comments."""
    c = comments.groupBy(F.col("entry_id").alias("id")).agg(F.sum("donation").alias("by_comments"))
    j = posts.select("id", F.col("donations").alias("site")).join(c, "id", "left").fillna(0, ["by_comments"])
    return j.withColumn("total", F.greatest("site", "by_comments"))


def exported_comments(comments: DataFrame) -> DataFrame:
    """Own comments with the ids of what they answer, what answers them, and whether their context is there."""
    from loomline.functions.records import context_status

    edges = comments.select("id", F.col("reply_to").alias("parent"))
    up = forest.ancestors(edges)
    above = up.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("o"), "ancestor"))), lambda x: x["ancestor"]).alias("ancestorIds"))
    below = up.groupBy(F.col("ancestor").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("replyIds"))
    own = comments.filter("feed").join(above, "id", "left").join(below, "id", "left")
    needed = (F.col("level") > 0) | (F.col("data.reply_count") > 0)
    fetched = F.col("ancestorIds").isNotNull() | F.col("replyIds").isNotNull()
    none = F.array().cast("array<bigint>")
    return own.select("id", "entry_id", "date", F.col("data.text").alias("text"), F.coalesce("ancestorIds", none).alias("ancestorIds"), F.coalesce("replyIds", none).alias("replyIds"), context_status(fetched, needed, fetched, F.col("entry_id")).alias("contextStatus"))
