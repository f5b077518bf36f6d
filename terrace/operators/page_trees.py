"""Trees of regions over pages that link to each other.

All open branches are expanded together, a level of pages at a time: redirects and pages are joined to the titles asked for, and
each branch carries the titles above it, so a page may be under several parents but never under itself. Groups of links have no
page; their items are expanded as children of theirs. What adds nothing is taken out from the deepest level up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.steps import cut

PATH = "array<int>"


def expanded(roots: DataFrame, pages: DataFrame, redirects: DataFrame, most: int) -> DataFrame:
    """root, path (places from the root), name, kind (page, leaf, self or group): all nodes before any is taken out.

    roots: title; pages: title, regions (array of name, linked, items); redirects: title, target. A title that is among those
    above it is a leaf (self), as is one at depth `most`; a title without a page is no node.
    """
    front = roots.select(F.col("title").alias("root"), F.array().cast(PATH).alias("path"), "title", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("seen"))
    to, known = redirects.select("title", "target"), pages.select(F.col("title").alias("_page"), "regions")
    done = None
    for depth in range(most + 1):
        front = cut(front)
        if depth and front.isEmpty():
            break
        asked = front.join(to, "title", "left").withColumn("resolved", F.coalesce("target", "title")).join(known, F.col("resolved") == F.col("_page"), "left")
        above = F.array_contains("seen", F.col("title"))
        kind = F.when(above, "self").when(F.lit(depth >= most), "leaf").when(F.col("_page").isNull(), F.lit(None)).when(F.array_contains("seen", F.col("resolved")), "self").otherwise("page")
        # One region that is no group tells nothing that its page doesn't.
        split = (kind == "page") & (F.size("regions") > 0) & ~((F.size("regions") == 1) & (F.size(F.get("regions", F.lit(0))["items"]) == 0))
        rows = cut(asked.select("root", "path", "title", kind.alias("kind"), F.when(split, F.col("regions")).alias("regions"), F.array_union("seen", F.array("title", "resolved")).alias("seen")).filter("kind IS NOT NULL"))
        own = rows.select("root", "path", F.col("title").alias("name"), "kind")
        listed = cut(rows.filter("regions IS NOT NULL").select("root", "path", "seen", F.posexplode("regions").alias("k", "r")).select("root", F.concat("path", F.array("k")).alias("path"), "seen", "r.*"))
        groups = listed.filter("NOT linked").select("root", "path", "name", F.lit("group").alias("kind"))
        done = own.unionByName(groups) if done is None else done.unionByName(own).unionByName(groups)
        linked = listed.filter("linked").select("root", "path", F.col("name").alias("title"), "seen")
        items = listed.filter("NOT linked").select("root", "path", "seen", F.posexplode("items").alias("k", "title")).select("root", F.concat("path", F.array("k")).alias("path"), "title", "seen")
        front = linked.unionByName(items).withColumn("depth", F.lit(depth + 1))
    return cut(done)


def settled(nodes: DataFrame) -> DataFrame:
    """root, path, parent (the path of the node above, null for a root), name, kind: what stays of expanded nodes.

    A group without children goes, one with a single child gives it its place; a page whose only child has none is a leaf.
    """
    length = (nodes.agg(F.max(F.size("path"))).first()[0] or 0) if not nodes.isEmpty() else 0
    state, done = None, None
    for size in range(length, -1, -1):
        here = nodes.filter(F.size("path") == size)
        if state is None:
            found = here.withColumn("_n", F.lit(0).cast("long")).withColumn("_bare", F.lit(0).cast("long"))
        else:
            below = state.filter("alive").groupBy("root", F.slice("path", F.lit(1), F.lit(size)).alias("path")).agg(F.count("*").alias("_n"), F.count_if("bare").alias("_bare"))
            found = here.join(below, ["root", "path"], "left").fillna(0, ["_n", "_bare"])
        group, single = F.col("kind") == "group", (F.col("_n") == 1) & (F.col("_bare") == 1)
        state = cut(found.select(
            "root", "path", "name", "kind", (~group | (F.col("_n") > 0)).alias("alive"), F.when(group, single).otherwise((F.col("_n") == 0) | single).alias("bare"),
            (group & (F.col("_n") == 1)).alias("passes"), (~group & single).alias("closed"),
        ))
        done = state if done is None else done.unionByName(state)
    done = cut(done)
    prefix: Column = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda k: F.slice("path", F.lit(1), k))
    above = done.filter(F.size("path") > 0).select("root", "path", F.explode(prefix).alias("_at"))
    of = done.select("root", F.col("path").alias("_at"), F.col("passes").alias("_passes"), F.col("closed").alias("_closed"))
    upward = above.join(of, ["root", "_at"]).groupBy("root", "path").agg(F.bool_or("_closed").alias("_hidden"), F.max(F.when(~F.col("_passes"), F.struct(F.size("_at").alias("n"), F.col("_at").alias("at")))).alias("_up"))
    kept = done.filter("alive AND NOT passes").join(upward, ["root", "path"], "left").filter("NOT coalesce(_hidden, false)")
    return kept.select("root", "path", F.col("_up.at").alias("parent"), "name", "kind")


def page_trees(roots: DataFrame, pages: DataFrame, redirects: DataFrame, most: int) -> DataFrame:
    return settled(expanded(roots, pages, redirects, most))
