"""Questions to adjacency lists. A tree is a DataFrame with id and parent_id; roots have a null parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.ranking import first_per
from terrace.operators.steps import cut


def closure(tree: DataFrame) -> DataFrame:
    """node, ancestor, distance (the least; 0 for the node itself).

    Distances double with each join, so a tree of depth d takes log2(d) rounds; several parents and cycles are allowed.
    """
    known = tree.select(F.col("id").alias("node"), F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    edges = tree.filter("parent_id IS NOT NULL AND id <> parent_id").select(F.col("id").alias("node"), F.col("parent_id").alias("ancestor"), F.lit(1).cast("long").alias("distance"))
    known, reach = cut(known.unionByName(edges).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))), 1
    while True:
        near = known.filter(F.col("distance") == reach).select("node", F.col("ancestor").alias("via"))
        on = known.filter("distance > 0").select(F.col("node").alias("via"), "ancestor", (F.col("distance") + reach).alias("distance"))
        step = near.join(on, "via").select("node", "ancestor", "distance")
        known = cut(known.unionByName(step).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        if known.filter(F.col("distance") > reach).isEmpty():
            return known
        reach *= 2


def lineage(tree: DataFrame) -> DataFrame:
    """id, chain: structs of id and name from the root down to the node, of a tree with one parent per node.

    Chains double with each join, and each node is one row throughout: no node's descendants meet in one group. The joined
    side has one row per key, so where many nodes wait for one ancestor Spark may split them.
    """
    start = F.array(F.struct(F.col("id").alias("id"), F.col("name").alias("name")))
    rows = cut(tree.select("id", F.when(F.col("parent_id") != F.col("id"), F.col("parent_id")).alias("up"), start.alias("chain")))
    for _ in range(64):
        if rows.filter("up IS NOT NULL").isEmpty():
            return rows.select("id", "chain")
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("chain").alias("_above"))
        done, waiting = rows.filter("up IS NULL"), rows.filter("up IS NOT NULL")
        # A parent that is no node is a root that isn't shown.
        on = waiting.join(above, "up", "left").select("id", F.col("_up").alias("up"), F.concat(F.coalesce("_above", F.slice("chain", 1, 0)), F.col("chain")).alias("chain"))
        rows = cut(done.unionByName(on))
    raise ValueError("the tree has a cycle")


def paths(lines: DataFrame, separator: str = " > ") -> DataFrame:
    """node, path (names from the root down to the node), depth, of lineage()."""
    return lines.select(F.col("id").alias("node"), F.array_join(F.transform("chain", lambda s: s["name"]), separator).alias("path"), (F.size("chain") - 1).cast("long").alias("depth"))


def beneath(links: DataFrame, marked: DataFrame, own: bool = True) -> DataFrame:
    """node: those with a marked (id) ancestor; own: a marked node counts as its own."""
    return links.filter("distance > 0" if not own else "distance >= 0").join(marked.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("node").distinct()


def above(links: DataFrame, marked: DataFrame, own: bool = True) -> DataFrame:
    """node: those with a marked (id) descendant; own: a marked node counts as its own."""
    found = links.filter("distance > 0" if not own else "distance >= 0").join(marked.select(F.col("id").alias("node")), "node", "left_semi")
    return found.select(F.col("ancestor").alias("node")).distinct()


def coverage_gaps(tree: DataFrame, links: DataFrame, covered: DataFrame) -> DataFrame:
    """Rows of the tree that are neither covered nor hold something covered, under a root's place or a parent that holds something covered."""
    inside, holding = beneath(links, covered), above(links, covered)
    gaps = tree.join(inside, tree.id == inside.node, "left_anti").join(holding, tree.id == holding.node, "left_anti")
    roots = gaps.filter("parent_id IS NULL")
    return roots.unionByName(gaps.join(holding, gaps.parent_id == holding.node, "left_semi"))


def overlaps(tree: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """Divisions under several groups, topmost only: division, groups. members: group_id, division."""
    held = links.select("node", F.col("ancestor").alias("division")).join(members, "division").groupBy("node").agg(F.countDistinct("group_id").alias("groups")).filter("groups > 1")
    parents = tree.select(F.col("id").alias("node"), "parent_id")
    held = held.join(parents, "node")
    return held.join(held.select(F.col("node").alias("parent_id")), "parent_id", "left_anti").select(F.col("node").alias("division"), "groups")


def nearest_ancestor(links: DataFrame, owners: DataFrame) -> DataFrame:
    """node, ancestor, owner: the first ancestor that has an owner. owners: id, owner."""
    found = links.filter("distance > 0").join(owners.select(F.col("id").alias("ancestor"), "owner"), "ancestor")
    return found.groupBy("node").agg(F.min_by(F.struct("ancestor", "owner"), F.struct("distance", "owner")).alias("r")).select("node", "r.ancestor", "r.owner")


def rolled_up(lines: DataFrame, facts: DataFrame, aggregates: list[Column]) -> DataFrame:
    """Aggregates of facts (id, …) over each node's subtree: id, … Facts meet their node's lineage; sums are partial before they are shuffled."""
    held = facts.join(lines, "id").withColumn("_at", F.explode(F.transform("chain", lambda s: s["id"]))).drop("id", "chain")
    return held.groupBy(F.col("_at").alias("id")).agg(*aggregates)


def simplified(members: DataFrame, tree: DataFrame) -> DataFrame:
    """group_id, division: wherever a group has all children of a parent, the parent stands for them; to the fixpoint.

    Each round lifts one level everywhere, so there are at most as many rounds as the tree is deep. Both tables are large,
    though their files may be small: joins are told not to broadcast.
    """
    children = tree.filter("parent_id IS NOT NULL").select(F.col("id").alias("division"), F.col("parent_id").alias("parent"))
    totals = children.groupBy("parent").agg(F.count("*").alias("children"))
    held = cut(members.select("group_id", "division").distinct())
    while True:
        placed = held.join(children.hint("merge"), "division", "left")
        full = placed.groupBy("group_id", "parent").agg(F.count("*").alias("n")).join(totals.hint("merge"), "parent").filter("n = children").select("group_id", "parent")
        full = cut(full)
        if full.isEmpty():
            return held
        rest = placed.join(full.hint("merge"), ["group_id", "parent"], "left_anti").select("group_id", "division")
        held = cut(rest.unionByName(full.select("group_id", F.col("parent").alias("division"))).distinct())


def owner_moves(tree: DataFrame, members: DataFrame) -> DataFrame:
    """Where children of one parent are split over groups, the group with most of them (the lowest of equals) owns them: division, from_group, to_group."""
    placed = members.join(tree.filter("parent_id IS NOT NULL").select(F.col("id").alias("division"), "parent_id"), "division")
    counts = placed.groupBy("parent_id", "group_id").agg(F.count("*").alias("n"))
    owner = first_per(counts, ["parent_id"], [F.desc("n"), F.asc("group_id")]).select("parent_id", F.col("group_id").alias("to_group"))
    return placed.join(owner, "parent_id").filter("group_id <> to_group").select("division", F.col("group_id").alias("from_group"), "to_group")


def flattened(tree: DataFrame, links: DataFrame, dissolved: DataFrame) -> DataFrame:
    """The tree without the dissolved (id) nodes; their children hang on the nearest ancestor that stays."""
    marks = dissolved.select(F.col("id").alias("ancestor")).withColumn("gone", F.lit(True))
    stays = links.filter("distance > 0").join(marks, "ancestor", "left").filter("gone IS NULL")
    parent = stays.groupBy("node").agg(F.min_by("ancestor", "distance").alias("new_parent"))
    kept = tree.join(dissolved.select("id"), "id", "left_anti")
    return kept.join(parent, kept.id == parent.node, "left").select(kept.id, F.col("new_parent").alias("parent_id"), kept.name)


def collapsed(tree: DataFrame) -> DataFrame:
    """An only child with its parent's name goes, and its children hang on the parent; to the fixpoint."""
    tree = cut(tree.select("id", "parent_id", "name"))
    while True:
        only = tree.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count("*").alias("n"), F.first("id").alias("child"), F.first("name").alias("child_name")).filter("n = 1")
        same = only.join(tree.select(F.col("id").alias("parent_id"), F.col("name").alias("child_name")), ["parent_id", "child_name"])
        # Of a chain of equal names only every link whose parent is not itself going is taken in a round.
        going = cut(same.select(F.col("child").alias("gone"), F.col("parent_id").alias("heir")))
        if going.isEmpty():
            return tree
        top = going.join(going.select(F.col("gone").alias("heir")), "heir", "left_anti").select("gone", "heir")
        kept = tree.join(top.select(F.col("gone").alias("id")), "id", "left_anti")
        tree = cut(kept.join(top, kept.parent_id == top.gone, "left").select("id", F.coalesce("heir", "parent_id").alias("parent_id"), "name"))


def from_levels(rows: DataFrame, levels: list[str], separator: str = " > ") -> DataFrame:
    """A tree out of one column per level: path, parent_path, name, depth, has_children. Empty and null levels are skipped."""
    named = F.filter(F.array(*levels), lambda x: x.isNotNull() & (x != ""))
    taken = rows.select(named.alias("n")).distinct()
    prefix = taken.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("n")), lambda k: F.slice("n", F.lit(1), k))).alias("p"), F.size("n").alias("full"), F.col("n"))
    prefix = prefix.filter("size(n) > 0")
    return prefix.groupBy(F.array_join("p", separator).alias("path")).agg(
        F.first(F.when(F.size("p") > 1, F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), separator))).alias("parent_path"),
        F.first(F.element_at("p", -1)).alias("name"), F.first(F.size("p")).cast("long").alias("depth"), F.bool_or(F.col("full") > F.size("p")).alias("has_children"),
    )


def countries(tree: DataFrame) -> DataFrame:
    """country: children of roots, and roots that have none."""
    roots = tree.filter("parent_id IS NULL").select("id")
    below = tree.join(roots.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id", "parent_id")
    return below.select(F.col("id").alias("country")).unionByName(roots.join(below.select(F.col("parent_id").alias("id")), "id", "left_anti").select(F.col("id").alias("country")))


def gap_suggestions(gaps: DataFrame, tree: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """id, action, region: what a gap (id, parent_id) could join. members: division, region.

    A sibling's region takes it (the least); else a region is to be made beside that of the nearest ancestor's sibling.
    """
    held = tree.filter("parent_id IS NOT NULL").select(F.col("id").alias("division"), F.col("parent_id").alias("parent")).join(members, "division")
    # The least region under a parent, and the least but for one child's own, so that no pair of siblings is made.
    by_child = held.groupBy("parent", "division").agg(F.min("region").alias("region"))
    two = first_per(by_child, ["parent"], [F.asc("region"), F.asc("division")], 2)

    def beside(rows: DataFrame) -> DataFrame:
        """region: the least among the other children of parent. rows: parent, division, …"""
        return rows.join(two.select("parent", F.col("division").alias("_d"), "region"), "parent").filter("_d <> division")

    near = beside(gaps.select("id", F.col("id").alias("division"), F.col("parent_id").alias("parent"))).groupBy("id").agg(F.min("region").alias("region"))
    rest = gaps.join(near, "id", "left_anti")
    up = rest.select("id", F.col("parent_id").alias("node")).join(links, "node").select("id", F.col("ancestor").alias("division"), "distance")
    up = up.join(tree.select(F.col("id").alias("division"), F.col("parent_id").alias("parent")), "division").filter("parent IS NOT NULL")
    far = beside(up).groupBy("id").agg(F.min(F.struct("distance", "region")).alias("r")).select("id", "r.region")
    return near.select("id", F.lit("add_member").alias("action"), "region").unionByName(far.select("id", F.lit("create_region").alias("action"), "region"))


def dismissed(tree: DataFrame, links: DataFrame, marked: DataFrame) -> DataFrame:
    """The tree without anything beneath marked (id) nodes, which so become leaves."""
    gone = beneath(links, marked, own=False)
    return tree.join(gone, tree.id == gone.node, "left_anti")


def pruned(tree: DataFrame, links: DataFrame, marked: DataFrame) -> DataFrame:
    """Beneath marked (id) nodes only leaves stay, and hang on the nearest marked node above them."""
    inner = tree.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    tops = links.filter("distance > 0").join(marked.select(F.col("id").alias("ancestor")), "ancestor")
    top = tops.groupBy("node").agg(F.min_by("ancestor", "distance").alias("_top"))
    rows = tree.join(top, tree.id == top.node, "left").join(inner.withColumn("_inner", F.lit(True)), "id", "left").join(marked.select("id").withColumn("_marked", F.lit(True)), "id", "left")
    stays = rows.filter(F.col("_top").isNull() | F.col("_inner").isNull() | F.col("_marked"))
    return stays.select("id", F.coalesce("_top", "parent_id").alias("parent_id"), "name")
