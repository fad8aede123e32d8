"""Forests by parent links: ancestors, descendants, roots, pruning, listings.

Sums along a path and over a subtree, depths, places in pre-order and pruning come by pointer doubling (climbed, intervals): a row a node, whatever
the depth, and as many rounds as its logarithm. Only ancestors() and descendants() list pairs, because pairs are what they return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.counting import ranged_sum
from loomline.session import configure, discard, shared_dir, stored


def _links(edges: DataFrame) -> DataFrame:
    """(id, up) of the rows that have a parent: not null, not 0 and another than the id. Of rows with one id the last parent counts (the largest)."""
    return edges.groupBy("id").agg(F.max("parent").alias("up")).filter("id is not null and up is not null and up != 0 and up != id")


def ancestors(edges: DataFrame) -> DataFrame:
    """edges: (id, parent), parent null or 0 at a root -> (id, ancestor, up): every ancestor with its distance. An id that is only a parent is
    an ancestor and ends the chain; a cycle ends at the first repeat. Of rows with one id the last parent counts (the largest).

    Pairs within 2**k links, and those of the farthest ancestor, give the pairs within 2**(k + 1); each round is stored, and joins are by sorting, so
    that nothing but counts comes to the driver. A cycle shows by an id that is above itself, and from then on repeats are taken out of a round."""
    spark = configure(edges.sparkSession)
    now, _ = stored(_links(edges).select("id", F.col("up").alias("ancestor"), F.lit(1).alias("up")), "ancestors")
    known, reach, cyclic = now, 1, False
    while now.filter(F.col("up") == reach).limit(1).count():
        far = now.filter(F.col("up") == reach).select("id", F.col("ancestor").alias("via"))
        further = known.select(F.col("id").alias("via"), "ancestor", (F.col("up") + reach).alias("up"))
        now, at = stored(far.join(further.hint("merge"), "via").select("id", "ancestor", "up"), "ancestors")
        cyclic = cyclic or bool(now.filter("id = ancestor").limit(1).count())
        if cyclic:
            once = now.filter("id != ancestor").groupBy("id", "ancestor").agg(F.min("up").alias("up")).join(known.select("id", "ancestor").hint("merge"), ["id", "ancestor"], "left_anti")
            was = at
            now, _ = stored(once, "ancestors")
            discard(spark, was)
        known, reach = known.unionByName(now), 2 * reach
    return known


def roots(edges: DataFrame) -> DataFrame:
    """(id, root, depth) of every id. An absent parent does not count: the topmost present ancestor is the root; of a cycle it is the smallest id."""
    return climbed(tidy(edges.select("id", "parent"))).select("id", "root", "depth")


def descendants(edges: DataFrame) -> DataFrame:
    """(id, descendant, down) of every id."""
    return ancestors(edges).select(F.col("ancestor").alias("id"), F.col("id").alias("descendant"), F.col("up").alias("down"))


def tidy(nodes: DataFrame) -> DataFrame:
    """One row an id, with its largest parent if that is there, another, and not 0 (which marks a root). Other columns keep their largest value. The result is checkpointed."""
    shared_dir(nodes.sparkSession)
    rest = [c for c in nodes.columns if c not in ("id", "parent")]
    one = nodes.filter("id is not null").groupBy("id").agg(F.max("parent").alias("p"), *[F.max(c).alias(c) for c in rest])
    there = one.filter("id != 0").select(F.col("id").alias("parent"))
    return one.join(there, (F.col("p") == F.col("parent")) & (F.col("p") != F.col("id")), "left").select("id", "parent", *rest).checkpoint()


def _uncycled(tree: DataFrame) -> DataFrame:
    """tree without the links that close its cycles: the smallest id of each becomes a root. After as many doublings as the logarithm of the
    number of nodes, a way that has not ended goes round a cycle and has met its smallest id."""
    now, at = stored(tree.select("id", F.col("parent").alias("up"), F.col("id").alias("least")), "cycles")
    total, steps = tree.count(), 1
    while steps <= 2 * total:
        far = now.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("least").alias("far_least"))
        was = at
        now, at = stored(now.join(far, "up", "left").select("id", F.col("far").alias("up"), F.least("least", "far_least").alias("least")), "cycles")
        discard(tree.sparkSession, was)
        steps *= 2
    round_it = now.filter("up is not null").select(F.col("up").alias("id")).distinct().join(now.select("id", "least"), "id")
    cut = round_it.filter("id = least").select("id", F.lit(True).alias("cut"))
    rest = [c for c in tree.columns if c not in ("id", "parent")]
    return tree.join(cut, "id", "left").select("id", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"), *rest).checkpoint()


def climbed(tree: DataFrame, above: tuple[str, ...] = (), below: tuple[str, ...] = ()) -> DataFrame:
    """tree: tidy (id, parent, numbers) -> id, parent, root, depth, above_x: the sum of x over all nodes above, below_x: over the node and all
    below it. After k rounds a row knows what is within 2**k links of it, upwards by joining the row that it points to, downwards by adding up
    the rows that point to it. A cycle is cut above its smallest id, which parent shows."""
    steps, total = 1, tree.count()
    ups = {f"above_{c}": F.coalesce(F.col(c), F.lit(0)) for c in above} | {"depth": F.lit(1).cast("long")}
    downs = {f"below_{c}": F.coalesce(F.col(c), F.lit(0)) for c in below}
    now, at = stored(tree.select("id", "parent", F.col("parent").alias("up"), F.coalesce("parent", "id").alias("root"), *[v.alias(k) for k, v in {**ups, **downs}.items()]), "climbed")
    while now.filter("up is not null").limit(1).count():
        if steps > 2 * total:
            return climbed(_uncycled(tree), above, below)
        steps *= 2
        far = now.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("root").alias("far_root"), *[F.col(k).alias(f"far_{k}") for k in ups])
        rows = now.join(far, "up", "left")
        if downs:
            adds = now.filter("up is not null").groupBy(F.col("up").alias("to")).agg(*[F.sum(k).alias(f"add_{k}") for k in downs])
            rows = rows.join(adds, F.col("id") == F.col("to"), "left")
        further = rows.select(
            "id", "parent", F.col("far").alias("up"), F.coalesce("far_root", "root").alias("root"),
            *[(F.col(k) + F.coalesce(f"far_{k}", F.lit(0))).alias(k) for k in ups], *[(F.col(k) + F.coalesce(f"add_{k}", F.lit(0))).alias(k) for k in downs],
        )
        was = at
        now, at = stored(further, "climbed")
        discard(tree.sparkSession, was)
    own = tree.select(F.col("id").alias("own"), *[F.coalesce(F.col(c), F.lit(0)).alias(f"own_{c}") for c in above])
    strict = now.join(own, F.col("id") == F.col("own")) if above else now
    return strict.select("id", "parent", "root", (F.col("depth") - 1).alias("depth"), *[(F.col(f"above_{c}") - F.col(f"own_{c}")).alias(f"above_{c}") for c in above], *downs)


def intervals(nodes: DataFrame) -> DataFrame:
    """nodes: (id, parent, date) -> (id, parent, date, root, depth, pre, size): a tree in pre-order, children by (date, id), takes the places 0, 1, ...;
    a node and all below it take pre .. pre + size - 1. A node's place is the sum, over itself and the nodes above, of one more than the sizes of the
    siblings before; those are running sums over all nodes ordered by parent, dealt by range, so that a node with very many children is no one task."""
    tree = tidy(nodes.select("id", "parent", "date"))
    sized = climbed(tree.withColumn("one", F.lit(1).cast("long")), below=("one",)).join(tree.select("id", "date"), "id").checkpoint()
    order = [F.col("parent"), F.col("date").asc_nulls_first(), F.col("id")]
    before = ranged_sum(sized.filter("parent is not null").select("id", "parent", "date", "below_one"), order, "below_one", "before").checkpoint()
    first = before.groupBy(F.col("parent").alias("of")).agg(F.min("before").alias("first"))
    steps = before.join(first, F.col("parent") == F.col("of")).select("id", (1 + F.col("before") - F.col("first")).alias("step"))
    stepped = sized.select("id", "parent").join(steps, "id", "left").checkpoint()
    places = climbed(stepped, above=("step",)).select("id", "above_step").join(stepped.select("id", F.coalesce("step", F.lit(0)).alias("step")), "id")
    return sized.join(places, "id").select("id", "parent", "date", "root", "depth", (F.col("above_step") + F.col("step")).alias("pre"), F.col("below_one").alias("size"))


def subtree_sizes(edges: DataFrame) -> DataFrame:
    """(id, n): how many nodes are below each node that has any."""
    return climbed(tidy(edges.select("id", "parent")).withColumn("one", F.lit(1).cast("long")), below=("one",)).filter("below_one > 1").select("id", (F.col("below_one") - 1).alias("n"))


def keep(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """ids that pruning keeps for the wanted (id): those present, their ancestors present, and their whole subtrees. A node stays if there is a
    wanted one above it, or at or below it."""
    marks = ids.select("id").distinct().withColumn("wanted", F.lit(1).cast("long"))
    tree = tidy(edges.select("id", "parent")).join(marks, "id", "left")
    return climbed(tree, above=("wanted",), below=("wanted",)).filter("above_wanted > 0 or below_wanted > 0").select("id")


def missing(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(edges.select("id"), "id", "left_anti")


def preorder(nodes: DataFrame) -> DataFrame:
    """nodes: (id, parent, date) -> (id, root, depth, pre): ordering by (root's date, root, pre) lists every tree in pre-order, children by (date, id)."""
    return intervals(nodes).select("id", "root", "depth", "pre")


def _jumps(edges: DataFrame) -> list[DataFrame]:
    """(id, up) for 1, 2, 4, ... links, as far as any way goes, or as there are links: a row a node in each."""
    now, _ = stored(_links(edges), "jumps")
    found, steps, total = [now], 2, now.count()
    while steps <= total:
        now, _ = stored(now.join(now.select(F.col("id").alias("up"), F.col("up").alias("far")).hint("merge"), "up").select("id", F.col("far").alias("up")), "jumps")
        if not now.limit(1).count():
            break
        found.append(now)
        steps *= 2
    return found


def _closed(jumps: list[DataFrame], of: DataFrame, upwards: bool) -> DataFrame:
    """of: (grp, id) -> those and all nodes above (or below) them. Rows within 2**k links, and what is 2**k links on from them, are all within 2**(k + 1)."""
    old, new = ("id", "up") if upwards else ("up", "id")
    now, at = stored(of.select("grp", "id").distinct(), "closed")
    for jump in jumps:
        further = now.join(jump.select(F.col(old).alias("id"), F.col(new).alias("to")), "id").select("grp", F.col("to").alias("id"))
        was = at
        now, at = stored(now.unionByName(further).distinct(), "closed")
        discard(of.sparkSession, was)
    return now


def shown(edges: DataFrame, mine: DataFrame) -> DataFrame:
    """edges: (id, parent), mine: (id, grp) -> (grp, id, chain): what is shown around a group's own comments (what they answer and all that
    answers them), chain marking the run from the root down that has one child each and none of the own ones: it is shown collapsed.

    Takes a row a node and round for links of 1, 2, 4, ..., and the rows that are shown; pairs of nodes and ancestors are not listed."""
    configure(edges.sparkSession)
    jumps = _jumps(edges)
    present = edges.select("id").distinct()
    around = _closed(jumps, mine, True).unionByName(_closed(jumps, mine, False)).distinct()
    nodes, _ = stored(around.join(present, "id", "left_semi").select("grp", "id"), "shown")
    linked = nodes.join(edges.groupBy("id").agg(F.max("parent").alias("parent")), "id")
    children = linked.groupBy("grp", F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    # a node is in the chain if neither it nor anything above it is own or has other than one child
    own = mine.select("grp", "id").distinct().withColumn("own", F.lit(True))
    ends = nodes.join(children, ["grp", "id"], "left").join(own, ["grp", "id"], "left").filter("own or coalesce(children, 0) != 1").select("grp", "id")
    stop = _closed(jumps, ends, False).withColumn("stop", F.lit(True))
    return nodes.join(stop, ["grp", "id"], "left").select("grp", "id", F.col("stop").isNull().alias("chain"))
