"""Connected components and bounded closures of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.steps import by_key, cut


def components(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """id, component (the least id in reach). nodes: id; None: the ends of edges. edges: a, b in either direction.

    In a round the lesser neighbours of a node are tied to the least of them and ties jump to where their end is tied; paths
    halve. Keys are the greater ends, so that a large component is no large group. Ties are dealt over tasks by their number.
    """
    given = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    ties = given.filter("a <> b")
    while True:
        rows = ties.count()
        dealt = by_key(ties, rows, "a").dropDuplicates(["a", "b"])
        least = cut(dealt.groupBy("a").agg(F.min("b").alias("p")))
        ends = least.select(F.col("a").alias("end"), F.col("p").alias("next"))
        jump = least.join(ends, F.col("p") == F.col("end"), "left").select(F.col("a").alias("_a"), "p", F.coalesce("next", "p").alias("q"), F.col("next").isNotNull().alias("moved"))
        tied = dealt.join(by_key(cut(jump), rows, "_a"), F.col("a") == F.col("_a"))
        tied = cut(tied.select(F.when(F.col("b") == F.col("p"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("q").alias("b"), ((F.col("b") != F.col("p")) | F.col("moved")).alias("changed")))
        ties = tied.select("a", "b")
        if tied.filter("changed").isEmpty():
            break
    stars = ties.select(F.col("a").alias("id"), F.col("b").alias("component"))
    if nodes is not None:
        return nodes.select("id").join(stars, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    own = ties.select(F.col("b").alias("id")).unionByName(given.filter("a = b").select(F.col("a").alias("id"))).distinct().withColumn("component", F.col("id"))
    return by_key(stars.unionByName(own), rows, "id").groupBy("id").agg(F.min("component").alias("component"))


def bounded_closure(edges: DataFrame, roots: DataFrame, hops: int = 3, growth: int = 3, floor: int = 300, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """What each root (id) reaches along edges (a to b): root, id, hop; and the hops that were refused: root, hop, offered.

    A root's hop is refused, and ends its walk, if it offers more than `growth` times what the root has (`floor` at least), or
    with it the root would have more than `most`. All roots walk together, each by its own counts.
    """
    start = roots.select(F.col("id").alias("root"), "id").distinct()
    seen, refused, front = cut(start.withColumn("hop", F.lit(0))), None, start
    for hop in range(1, hops + 1):
        offered = front.join(edges, F.col("id") == F.col("a")).select("root", F.col("b").alias("id")).distinct().join(seen, ["root", "id"], "left_anti")
        offered = cut(offered)
        sizes = offered.groupBy("root").agg(F.count("*").alias("offered")).join(seen.groupBy("root").agg(F.count("*").alias("size")), "root")
        bad = (F.col("offered") > F.greatest(F.col("size"), F.lit(floor)) * growth) | (F.col("size") + F.col("offered") > most)
        over = sizes.filter(bad).select("root", F.lit(hop).alias("hop"), "offered")
        refused = over if refused is None else refused.unionByName(over)
        front = cut(offered.join(over, "root", "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front.withColumn("hop", F.lit(hop))))
    return seen, cut(refused)


def fragments(members: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Exclaves: parts of a group that aren't its largest, with the group that borders them most.

    members: id, group_id; adjacency: a, b. Returns group_id, component, size, share, neighbour; islands, which border no other group, are left out.
    """
    of = members.select(F.col("id").alias("a"), F.col("group_id").alias("group_a"))
    both = adjacency.select("a", "b").unionByName(adjacency.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    known = both.join(of, "a").join(of.withColumnsRenamed({"a": "b", "group_a": "group_b"}), "b")
    parts = components(members, known.filter("group_a = group_b").select("a", "b")).join(members, "id")
    sizes = parts.groupBy("group_id", "component").agg(F.count("*").alias("size"))
    own = Window.partitionBy("group_id")
    order = Window.partitionBy("group_id").orderBy(F.desc("size"), "component")
    small = sizes.withColumn("share", F.col("size") / F.sum("size").over(own)).withColumn("_rn", F.row_number().over(order)).filter("_rn > 1").drop("_rn")
    votes = known.filter("group_a <> group_b").join(parts.select(F.col("id").alias("a"), "component"), "a").groupBy("component", "group_b").agg(F.count("*").alias("votes"))
    best = votes.groupBy("component").agg(F.min_by("group_b", F.struct((-F.col("votes")).alias("v"), "group_b")).alias("neighbour"))
    return small.join(best, "component").select("group_id", "component", "size", "share", "neighbour")
