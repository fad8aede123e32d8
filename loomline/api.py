"""Read queries over published archives: each is a method that returns a DataFrame, and unusable arguments raise ValueError.

A library is a folder of published read models (see plans.model), one folder an archive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loomline.functions.calendar import day_start
from loomline.functions.records import split_reactions
from loomline.operators import counting, forest, search
from loomline.operators.versions import word_runs
from loomline.plans.model import donations
from loomline.sources import sinks

WHERE = {"all": None, "posts": ["p"], "my_comments": ["c"], "others_comments": ["o"]}
SOURCES = ("my_comments", "post_comments", "posts")
GROUPS = ("none", "post", "post_author", "author", "year", "month", "day")
KEYS = {"post": "entry_id", "post_author": "subsite_id", "author": "author"}
POST_SORTS = ("new", "old", "comments", "donations", "reactions")


def bounds(when: Column, since: str | None = None, until: str | None = None, year: int | None = None) -> Column:
    """since <= when < the day after until; a year fills the bounds left open."""
    if year is not None:
        since, until = since or f"{year:04}-01-01", until or f"{year:04}-12-31"
    ok = F.lit(True)
    if since:
        ok &= when >= day_start(F.lit(since))
    if until:
        ok &= when < day_start(F.lit(until), end=True)
    return ok


def _one_of(name: str, value, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{name} is one of {', '.join(allowed)}")


class Archive:
    """One published archive. history (optional): id, kind, item_id, entry_id, at, event, state, sig, body."""

    def __init__(self, spark: SparkSession, root: str, owner: int, history: DataFrame | None = None):
        self.spark, self.root, self.owner, self.history = spark, root, owner, history

    def table(self, name: str) -> DataFrame:
        """A table of the version that is current now."""
        at = sinks.current(self.spark, self.root)
        if at is None:
            raise ValueError(f"{self.root} has no published read model")
        return self.spark.read.parquet(f"{at}/{name}")

    def index(self) -> search.Index:
        """Lies with the version it is of, and is written when that is first searched."""
        root = f"{sinks.current(self.spark, self.root)}/search/{search.FORMAT}"
        return search.opened(self.spark, root) or search.write(self.table("search_docs"), root)

    def search(self, query: str, where: str = "all", since: str | None = None, until: str | None = None, year: int | None = None, sort: str = "rank", limit: int = 20, page: int = 1, exact: bool = False) -> DataFrame:
        """A page of hits with their snippets: corrected words unless exact; at most 50 a page."""
        _one_of("where", where, WHERE)
        asked = search.parse(query) if exact else search.Corrector(self.index()).fix(search.parse(query))
        hits = search.search(self.index(), asked, kinds=WHERE[where]).join(self.table("search_docs"), "doc_id").filter(bounds(F.col("date"), since, until, year))
        order = {"rank": [F.desc("close"), F.col("score")], "date": [F.desc("date")], "old": [F.col("date")]}[sort]
        return search.snippets(counting.page(hits, [*order, F.col("doc_id")], max(1, page), max(1, min(limit, 50))), asked)

    def count(self, source: str = "my_comments", by: str = "none", query: str | None = None, where: str = "all", posts: str = "all", since: str | None = None, until: str | None = None, year: int | None = None) -> DataFrame:
        """Counts by group: grp, n, first and last date, and the entry's title and owner."""
        _one_of("source", source, SOURCES)
        _one_of("by", by, GROUPS)
        _one_of("posts", posts, ("all", "own", "foreign"))
        _one_of("where", where, WHERE)
        if query is None and where != "all":
            raise ValueError("where says what a query looks in; without a query it is source that counts")
        if query is not None and source != "my_comments":
            raise ValueError("a query counts its hits; where says what it looks in")
        if query is None and source == "posts" and (by in KEYS or posts != "all"):
            raise ValueError("posts are all the owner's; group them by year, month or day")
        if query is None and source == "my_comments" and by == "author":
            raise ValueError("own comments have one author; post_author groups by the authors of posts")
        if query is not None:
            rows = search.search(self.index(), search.parse(query), kinds=WHERE[where]).select("doc_id").join(self.table("search_docs"), "doc_id").select(F.col("entry").alias("entry_id"), "date", "author")
        elif source == "posts":
            rows = self.table("posts").select(F.col("id").alias("entry_id"), "date", F.lit(self.owner).cast("long").alias("author"))
        else:
            c = self.table("comments")
            own = self.table("posts").select(F.col("id").alias("entry_id"))
            rows = (c.filter("mine") if source == "my_comments" else c.join(own, "entry_id", "left_semi")).select("entry_id", "date", "author")
        entries = self.table("entries").withColumnRenamed("id", "entry_id")
        rows = rows.join(entries, "entry_id", "left").filter(bounds(F.col("date"), since, until, year)).withColumn("when", F.timestamp_seconds("date"))
        got = counting.grouped_count(rows, by, "when", key=KEYS.get(by), own={"own": "yes", "foreign": "no"}.get(posts), owner=F.lit(self.owner))
        return got.orderBy(*counting.count_order(by))

    def list_posts(self, sort: str = "new", since: str | None = None, until: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """Posts with their positive and negative reactions, ties by id."""
        _one_of("sort", sort, POST_SORTS)
        pos, neg = split_reactions(F.col("rx"))
        rows = self.table("posts").filter(bounds(F.col("date"), since, until)).select("id", "date", "title", "url", "comments", "donations", pos.alias("positive"), neg.alias("negative"))
        order = {"new": F.desc("date"), "old": F.col("date"), "comments": F.desc("comments"), "donations": F.desc("donations"), "reactions": F.desc("positive")}[sort]
        return rows.orderBy(order, F.desc("id")).offset(max(0, offset)).limit(max(1, min(limit, 200)))

    def list_comments(self, sort: str = "new", since: str | None = None, until: str | None = None, post: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """The owner's comments with the title of their entry."""
        _one_of("sort", sort, ("new", "old"))
        rows = self.table("comments").filter("mine").filter(bounds(F.col("date"), since, until))
        if post is not None:
            rows = rows.filter(F.col("entry_id") == post)
        order = [F.col("date"), F.col("id")] if sort == "old" else [F.desc("date"), F.desc("id")]
        some = rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, 200)))
        titled = some.join(self.table("entries").select(F.col("id").alias("entry_id"), "title"), "entry_id", "left")
        return titled.select("id", "entry_id", "date", F.col("data.text").alias("text"), "title").orderBy(*order)

    def get_post(self, post: int, limit: int = 1000, offset: int = 0) -> DataFrame:
        """The comments of a post in pre-order with depth, a part at a time; the post itself is a row of table("posts")."""
        there = self.table("comments").filter(F.col("entry_id") == post)
        listed = forest.preorder(there.select("id", F.col("reply_to").alias("parent"), "date"))
        roots = there.select(F.col("id").alias("root"), F.col("date").alias("root_date"))
        rows = there.join(listed.join(roots, "root"), "id")
        return rows.orderBy("root_date", "root", "pre").offset(max(0, offset)).limit(max(1, min(limit, 1000))).select("id", "depth", "author", "date", F.col("data.text").alias("text"), "donation", "donated", "mine")

    def get_comment(self, comment: int) -> DataFrame:
        """A comment, what it answers from the root on, and all that answers it: relation is above, self or below."""
        rows = self.table("comments")
        edges = rows.select("id", F.col("reply_to").alias("parent")).join(rows.filter(F.col("id") == comment).select("entry_id").join(rows, "entry_id").select("id"), "id", "left_semi")
        listed = forest.intervals(edges.join(rows.select("id", "date"), "id"))
        of = listed.filter(F.col("id") == comment).select(F.col("root").alias("of_root"), F.col("pre").alias("of_pre"), F.col("size").alias("of_size"), F.col("depth").alias("of_depth"))
        near = listed.join(F.broadcast(of), F.col("root") == F.col("of_root")).withColumn("distance", (F.col("depth") - F.col("of_depth")).cast("int"))  # one row of the comment itself
        inside = lambda pre, start, size: (pre > start) & (pre < start + size)
        above = near.filter(inside(F.col("of_pre"), F.col("pre"), F.col("size"))).select("id", F.lit("above").alias("relation"), "distance")
        below = near.filter(inside(F.col("pre"), F.col("of_pre"), F.col("of_size"))).select("id", F.lit("below").alias("relation"), "distance")
        self_ = rows.filter(F.col("id") == comment).select("id", F.lit("self").alias("relation"), F.lit(0).alias("distance"))
        return above.unionByName(self_).unionByName(below).join(rows.select("id", "author", "date", F.col("data.text").alias("text")), "id", "left").orderBy("distance", "date", "id")

    def get_history(self, kind: str | None = None, item: int | None = None, event: str | None = None, since: str | None = None, until: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """The log, newest first; of one item all its versions, each with the word runs to the next one."""
        if self.history is None:
            raise ValueError("the archive has no history")
        rows = self.history.filter(bounds(F.col("at"), since, until))
        if kind is not None:
            rows = rows.filter(F.col("kind") == kind)
        if item is not None:
            after = F.lead("body").over(W.Window.partitionBy("kind", "item_id", F.col("event") == "edit").orderBy("at", "id"))
            rows = rows.filter(F.col("item_id") == item).withColumn("next", F.when(F.col("event") == "edit", after)).withColumn("runs", F.when(F.col("next").isNotNull(), word_runs("body", "next")))
        if event is not None:
            rows = rows.filter(F.col("event") == event)
        return rows.orderBy(F.desc("at"), F.desc("id")).offset(max(0, offset)).limit(max(1, min(limit, 200)))

    def archive_stats(self) -> DataFrame:
        """One row: posts, comments, own comments, entries, donations, first and last date."""
        c, p = self.table("comments"), self.table("posts")
        of = c.agg(F.struct(F.count("*").alias("comments"), F.count_if("mine").alias("my_comments"), F.count_distinct("entry_id").alias("commented"), F.min("date").alias("first"), F.max("date").alias("last"))).scalar()
        rows = p.agg(F.count("*").alias("posts")).select("posts", of.alias("c"), donations(p, c).agg(F.sum("total")).scalar().alias("donations"))
        return rows.select("posts", "c.*", "donations")

    def where_shown(self, comments: DataFrame) -> DataFrame:
        """(id) -> (id, place, ym, page, entry_id): a month's page for own comments and for the threads around them, the owner's post for comments
        under it, else the site."""
        c = self.table("comments").select("id", "entry_id", F.col("reply_to").alias("parent"))
        loc = self.table("comment_loc").select("id", "ym", "page")
        groups = self.table("month_groups").groupBy("entry_id", "root_id").agg(F.max_by(F.struct("ym", "page"), "ym").alias("g"))
        own = self.table("posts").select(F.col("id").alias("entry_id"), F.lit(True).alias("own"))
        rows = comments.join(c, "id").join(loc, "id", "left").join(own, "entry_id", "left").join(forest.roots(c.select("id", "parent")).select("id", F.col("root").alias("root_id")), "id", "left").join(groups, ["entry_id", "root_id"], "left")
        place = F.when(F.col("ym").isNotNull(), "month").when(F.col("own"), "post").when(F.col("g").isNotNull(), "thread").otherwise("site")
        return rows.select("id", place.alias("place"), F.coalesce("ym", F.when(place == "thread", F.col("g.ym"))).alias("ym"), F.coalesce("page", F.when(place == "thread", F.col("g.page"))).alias("page"), "entry_id")


class Library:
    """All published archives of a root folder, by name."""

    def __init__(self, spark: SparkSession, archives: dict[str, Archive]):
        self.spark, self.archives = spark, archives

    def list_archives(self) -> DataFrame:
        """archive and its statistics, one row each."""
        frames = [a.archive_stats().withColumn("archive", F.lit(name)) for name, a in sorted(self.archives.items())]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], "archive string")
