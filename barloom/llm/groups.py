"""Connected groups from buckets of candidates, without ever emitting all pairs of a bucket.

Everything is a join or an aggregation that combines before its shuffle, so one bucket, hub or group may hold
any share of the rows.  State between rounds is in written tables; the driver sees only counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import Scratch

#: Members of a bucket that are compared with all others of it, by round; the last holds from there on.
LEADERS = (1, 32, 2048)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, comp) for each end of an edge (a, b); comp is the least id that can be reached.

    Each round hooks every root to its least smaller neighbour, flattens the hooks by pointer jumping, and
    replaces the edges' ends by their roots, so that only edges between different roots remain.
    """
    left = scratch.put(f"{name}-e0", edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    roots = None
    k = 0
    while left.count():
        k += 1
        ends = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
        hooks = left.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to"))
        hooks = scratch.put(f"{name}-h{k}-0", ends.join(hooks, "id", "left").select("id", F.coalesce("to", "id").alias("to")))
        j = 0
        while True:
            j += 1
            up = hooks.select(F.col("id").alias("to"), F.col("to").alias("top"))
            hooks = scratch.put(f"{name}-h{k}-{j}", hooks.join(up, "to").select("id", F.col("top").alias("to"), (F.col("top") != F.col("to")).alias("moved")))
            moved = hooks.where("moved").limit(1).count()
            hooks = hooks.drop("moved")
            scratch.drop(f"{name}-h{k}-{j - 1}")
            if not moved:
                break
        if roots is None:
            roots = hooks.select("id", F.col("to").alias("comp"))
        else:
            later = hooks.select(F.col("id").alias("comp"), "to")
            roots = scratch.put(f"{name}-r{k}", roots.join(later, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
        a, b = hooks.select(F.col("id").alias("a"), F.col("to").alias("ra")), hooks.select(F.col("id").alias("b"), F.col("to").alias("rb"))
        left = scratch.put(f"{name}-e{k}", left.join(a, "a").join(b, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
    if roots is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).where(F.lit(False))
    return roots


def active_of(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, id, leader): the members (bucket, id) of all buckets of two ids or more, and the least id of each."""
    size = scratch.put("size", members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1").select("bucket", "leader"))
    active = scratch.put("active-0", members.join(size, "bucket").select("bucket", "id", "leader"))
    scratch.drop("size")
    return active


def merge(groups: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """groups (id, comp), joined by further edges (a, b): only what the edges touch is worked out again."""
    a, b = (groups.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    over = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    roots = components(over, scratch, name)
    moved = groups.join(roots.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return scratch.put(name, moved.unionByName(roots.join(groups, "id", "left_anti")))


def ranks(active: DataFrame, first: int, k: int) -> DataFrame:
    """active (bucket, id, comp) with a rank by hash, new in each round k, and whether the member leads its bucket: about first
    members do, all of a bucket that has no more, and that of least rank in any case."""
    dealt = active.withColumn("rank", F.xxhash64("id", F.lit(k)))
    of = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rank").alias("least"))
    leads = (F.col("n") <= first) | (F.col("rank") == F.col("least")) | (F.pmod(F.xxhash64("id", F.lit(k), F.lit(7)), F.col("n")) < first)
    return dealt.join(of, "bucket").select("bucket", "id", "comp", "rank", leads.alias("leads"))


def link(
    active: DataFrame,
    look: DataFrame,
    screen: Callable[..., Column],
    verify: Callable[[DataFrame, int], DataFrame],
    scratch: Scratch,
    within: Callable[[DataFrame], DataFrame] | None = None,
    leaders: tuple[int, ...] = LEADERS,
) -> DataFrame:
    """(id, comp) of all ids that a verified link joins to another.

    active: the table of ``active_of``; look: (id, facts), facts a struct; screen gives the condition, on two columns of
    facts, that a pair must meet to be worth verifying; with a third column, the bucket, it may have a pair come from one of
    its common buckets alone, in rounds after the first.

    In each round some members of each bucket, its leaders (their number by round; the last holds from there on), are
    compared with all its other members outside their group.  Pairs are screened inside the join, so only likely ones
    leave it; verify gets those (a, b), distinct, and gives the linked ones.  Leaders then leave the bucket, as each of
    their links in it is known, and a bucket whose other members are all of one group is done.  So no link between
    groups is lost, while a bucket of one group costs as many pairs as it has members.

    within, if given, takes the place of all rounds after the first: it gets the open buckets' members (bucket, id,
    comp) and gives every likely pair of theirs from different groups.

    What is grouped is written before it is joined, so that both sides of a join on a hot key come from a shuffle and
    Spark can split them.
    """
    side = lambda x: look.select(F.col("id").alias(x), F.col("facts").alias(f"f{x}"))
    pairs = active.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(screen("fa", "fb"))
    rest = active.where("id <> leader").select("bucket", "id")
    groups, k = None, 0
    while True:
        edges = scratch.put(f"edges-{k}", verify(scratch.put(f"pairs-{k}", pairs.select("a", "b")), k).select("a", "b"))
        if groups is None:
            groups = components(edges, scratch, f"groups-{k}")
        elif edges.count():
            groups = merge(groups, edges, scratch, f"groups-{k}")
        rest = scratch.put(f"rest-{k}", rest.join(groups, "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp")))
        open_ = scratch.put(f"open-{k}", rest.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket"))
        k += 1
        active = scratch.put(f"active-{k}", rest.join(open_, "bucket", "left_semi"))
        scratch.drop(*(f"{x}-{k - 1}" for x in ("active", "rest", "open", "pairs", "ranked")))
        if not active.count():
            return groups
        if within:
            pairs = within(active).select("a", "b").distinct()
            edges = scratch.put(f"edges-{k}", verify(scratch.put(f"pairs-{k}", pairs), k).select("a", "b"))
            return merge(groups, edges, scratch, f"groups-{k}") if edges.count() else groups
        ranked = scratch.put(f"ranked-{k}", ranks(active, leaders[min(k, len(leaders) - 1)], k))
        lead = ranked.where("leads").select("bucket", F.col("id").alias("a"), F.col("comp").alias("of"), F.col("rank").alias("over")).join(side("a"), "a")
        other = ranked.select(F.col("bucket").alias("at"), F.col("id").alias("b"), "comp", "rank", "leads").join(side("b"), "b")
        # of two leaders each meets the other once
        once = ~F.col("leads") | (F.col("rank") > F.col("over")) | ((F.col("rank") == F.col("over")) & (F.col("b") > F.col("a")))
        pairs = other.join(lead, (F.col("at") == F.col("bucket")) & (F.col("comp") != F.col("of")) & once & screen("fa", "fb", "at")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = ranked.where(~F.col("leads")).select("bucket", "id")
