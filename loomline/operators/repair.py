"""Repair: nested documents rebuilt node by node from several damaged copies, own comments and kept versions from theirs, and a ledger of what is lost.

A tree (the comments under a post, the branch of a discussion) may survive in the file itself, in a mirror and in the published pages, each
fetched at its own time and each damaged in its own way. Every node is taken from the copy that was fetched last among those in which it can be
read; where it came from stays beside it, and what damage is above it is carried down the tree. A node that no copy has is never made up:
a listed one without a readable record keeps its place with no body.

Everything is grouped by node or item before it meets, so the copies of one large tree are no group, and copies of a tree are some few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators import forest

#: Ranks of sources, the better first.
FILE, MIRROR, PAGES = 0, 1, 2


def _time(rows: Column, source: Column) -> Column:
    """Later fetches first, of one time the better source."""
    return F.struct(rows.alias("fetched"), (-source).alias("rank"))


def rebuilt(copies: DataFrame, nodes: DataFrame) -> DataFrame:
    """copies: tree, source, fetched, whole (read to its end); nodes: tree, source, id (unique over all trees), parent, date, sig, body (null where the record could not be
    read) -> tree, id, parent, root, depth, date, source, fetched, sig, body, state, orphan, damaged_above.

    state: current (as the last copy that lists it has it), stale (a later copy lists it, but cannot be read there), gone (a later whole copy no
    longer lists it), lost (listed, readable nowhere). orphan: its parent is in no copy. damaged_above: how many stale, lost or orphaned nodes are
    above it. Records of a copy that is not in copies are left out; repeated records of a node in a copy count as one, the readable one with the largest body."""
    at = _time(F.col("fetched"), F.col("source"))
    kept = F.struct("source", "fetched", "parent", "date", "sig", "body")
    seen = nodes.join(copies.select("tree", "source", "fetched"), ["tree", "source"])
    one = seen.groupBy("tree", "id").agg(
        F.max_by(kept, F.when(F.col("body").isNotNull(), F.struct(at.alias("at"), "body"))).alias("best"),
        F.max_by(F.struct("parent", "date", "fetched"), F.struct(at.alias("at"), "parent", "date")).alias("listed"),
    )
    whole = copies.groupBy("tree").agg(F.max(F.when(F.col("whole"), F.col("fetched"))).alias("whole_at"))
    state = F.when(F.col("best").isNull(), "lost").when(F.col("whole_at") > F.col("listed.fetched"), "gone").when(F.col("best.fetched") < F.col("listed.fetched"), "stale").otherwise("current")
    from_best = lambda c: F.when(F.col("best").isNotNull(), F.col(f"best.{c}")).otherwise(F.col(f"listed.{c}")).alias(c)
    placed = one.join(whole, "tree").select("tree", "id", from_best("parent"), from_best("date"), "best.source", "best.fetched", "best.sig", "best.body", state.alias("state"))
    there = placed.select(F.col("id").alias("there"))
    marked = placed.join(there, F.col("parent") == F.col("there"), "left").withColumn("orphan", (F.coalesce("parent", F.lit(0)) != 0) & F.col("there").isNull()).drop("there")
    hurt = (F.col("state").isin("lost", "stale") | F.col("orphan")).cast("long")
    carried = forest.climbed(forest.tidy(marked.select("id", "parent", hurt.alias("hurt"))), above=("hurt",))
    return marked.join(carried.select("id", "root", "depth", F.col("above_hurt").alias("damaged_above")), "id").select(
        "tree", "id", "parent", "root", "depth", "date", "source", "fetched", "sig", "body", "state", "orphan", "damaged_above"
    )


def outcomes(wanted: DataFrame, copies: DataFrame, found: DataFrame) -> DataFrame:
    """wanted: tree, gone (no longer upstream); found: what rebuilt() gave -> a line a wanted tree: tree, outcome, nodes, lost, stale, gone, orphans, sources (how many its nodes come
    from). restored: the last copy is whole and nothing is missing; lost: no node can be read and upstream has none either; partial: what
    survived is all there is; pending: it is to be fetched again, and what survived stands in for it."""
    last = copies.groupBy("tree").agg(F.max_by("whole", _time(F.col("fetched"), F.col("source"))).alias("whole"))
    n = found.groupBy("tree").agg(
        F.count("*").alias("nodes"), F.count("body").alias("readable"), F.count_distinct("source").alias("sources"), F.count_if("orphan").alias("orphans"),
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("lost", "stale", "gone")],
    )
    rows = wanted.join(last, "tree", "left").join(n, "tree", "left")
    whole = F.coalesce(F.col("whole"), F.lit(False)) & (F.coalesce(F.col("n_lost") + F.col("n_stale") + F.col("orphans"), F.lit(0)) == 0)
    some = F.coalesce("readable", F.lit(0)) > 0
    outcome = F.when(whole, "restored").when(~F.col("gone"), "pending").when(some, "partial").otherwise("lost")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return rows.select("tree", outcome.alias("outcome"), zero("nodes", "nodes"), zero("n_lost", "lost"), zero("n_stale", "stale"), zero("n_gone", "gone"), zero("orphans", "orphans"), zero("sources", "sources"))


def documents(found: DataFrame, head: str = "entryId") -> DataFrame:
    """tree, doc: the rebuilt nodes as one JSON document a tree, as it was one file: items by (date, id), the ids that are lost in missing, and the
    latest of the times they were fetched at. Bodies are JSON texts and go in as they are."""
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("date", "id", "body")))), lambda x: x["body"]), ",")
    lost = F.array_join(F.array_sort(F.collect_list(F.when(F.col("body").isNull(), F.col("id")))), ",")
    rows = found.groupBy("tree").agg(F.max("fetched").alias("at"), items.alias("items"), lost.alias("missing"))
    at = F.coalesce(F.col("at").cast("string"), F.lit("null"))
    return rows.select("tree", F.concat(F.lit(f'{{"{head}":'), F.col("tree").cast("string"), F.lit(',"fetchedAt":'), at, F.lit(',"missing":['), "missing", F.lit('],"items":['), "items", F.lit("]}")).alias("doc"))


def comments(own: DataFrame, copies: DataFrame) -> DataFrame:
    """own: id, date, sig (null: never signed), damaged, gone (no longer upstream); copies: id, source, sig, modified, body -> for each damaged one id, year,
    outcome, source, sig, body, expected.

    An exact copy has the signature that the archive knew; of one never signed, that of the better source's copy. Without one the copy changed last
    stands in, of one time the better source. outcome: restored (exact), else pending, or of what upstream no longer has partial or lost. year
    is to be exported again; expected is the signature of the version that is gone unless restored."""
    bad = own.filter("damaged").select("id", "date", F.col("sig").alias("known"), "gone")
    j = bad.join(copies.filter("body is not null").select("id", "source", "sig", "modified", "body"), "id", "left")
    copy = F.struct("source", "sig", "modified", "body")
    there = F.col("body").isNotNull()
    groups = j.groupBy("id").agg(
        F.max_by(copy, F.when(there & (F.col("sig") == F.col("known")), F.struct((-F.col("source")).alias("s"), "body"))).alias("exact"),
        F.max_by(copy, F.when(there, F.struct((-F.col("source")).alias("s"), "body"))).alias("first"),
        F.max_by(copy, F.when(there, F.struct(F.coalesce("modified", F.lit(0)).alias("m"), (-F.col("source")).alias("s"), "body"))).alias("latest"),
        F.first("date").alias("date"), F.first("known").alias("known"), F.first("gone").alias("gone"),
    )
    expected = F.coalesce("known", "first.sig")
    exact = F.when(F.col("known").isNull(), F.col("first")).otherwise(F.col("exact"))
    rows = groups.withColumns({"expected": expected, "is_exact": exact.isNotNull(), "x": F.coalesce(exact, F.col("latest"))})
    outcome = F.when(F.col("is_exact"), "restored").when(~F.col("gone"), "pending").when(F.col("x").isNotNull(), "partial").otherwise("lost")
    return rows.select("id", F.year(F.timestamp_seconds("date")).alias("year"), outcome.alias("outcome"), "x.source", "x.sig", "x.body", "expected")


def versions(history: DataFrame, copies: DataFrame) -> DataFrame:
    """history: id, kind, item, event, sig, body, damaged; copies: id, source, sig, body -> history repaired: id, kind, item, event, sig, body, state, source. A
    damaged body comes from the better source that has the version's own signature (any, where it has none). A version that no copy has becomes a
    marker (event damaged, state lost, no body), one for each (kind, item, signature): further ones, and those told before, go."""
    bad = history.filter("damaged")
    fits = copies.filter("body is not null").select("id", F.col("source").alias("c_source"), F.col("sig").alias("c_sig"), F.col("body").alias("c_body"))
    j = bad.select("id", "sig").join(fits, "id").filter(F.col("sig").isNull() | (F.col("sig") == F.col("c_sig")))
    good = j.groupBy("id").agg(F.min_by(F.struct("c_source", "c_body"), F.struct("c_source", "c_body")).alias("c"))
    tried = bad.join(good, "id", "left")
    as_was = F.lit(None).cast("string").alias("state"), F.lit(None).cast("int").alias("source")
    sound = history.filter("not damaged").select("id", "kind", "item", "event", "sig", "body", *as_was)
    restored = tried.filter("c is not null").select("id", "kind", "item", "event", "sig", F.col("c.c_body").alias("body"), F.lit("restored").alias("state"), F.col("c.c_source").cast("int").alias("source"))
    lost = tried.filter("c is null").select("kind", "item", "sig", "id", F.lit("lost").alias("state"))
    markers = recorded(sound.filter("event = 'damaged'").select("kind", "item", "sig", "id", "state"), lost, "id")
    return sound.unionByName(restored).unionByName(
        markers.select("id", "kind", "item", F.lit("damaged").alias("event"), "sig", F.lit(None).cast("string").alias("body"), "state", F.lit(None).cast("int").alias("source"))
    )


def recorded(ledger: DataFrame, found: DataFrame, order: str = "at") -> DataFrame:
    """The rows of found that the ledger of damage takes up: each (kind, item, sig) once, the smallest by order, null and empty signatures being one. Both
    frames have the same columns. A second run over the same findings adds nothing."""
    mark = ["kind", "item", F.coalesce("sig", F.lit("")).alias("__sig")]
    known = ledger.select(*mark).distinct()
    rest = [c for c in found.columns if c not in ("kind", "item")]
    one = found.groupBy(*mark).agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("x"))
    return one.join(known, ["kind", "item", "__sig"], "left_anti").select("kind", "item", "x.*").select(*found.columns)


def losses(kind: str, repaired: DataFrame, key: str = "id") -> DataFrame:
    """What comments() or outcomes() could not bring back, as rows for the ledger: kind, item, sig, state."""
    sig = F.col("expected") if "expected" in repaired.columns else F.lit(None).cast("string")
    return repaired.filter(F.col("outcome").isin("lost", "partial")).select(F.lit(kind).alias("kind"), F.col(key).alias("item"), sig.alias("sig"), F.lit("lost").alias("state"))
