"""Works and the venues that hold them: verdicts, resolving, placing, folding and differences of placements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.geo import EQUATOR_DEGREE, MERIDIAN_DEGREE
from terrace.operators.ranking import first_per
from terrace.operators.steps import cut

#: Metres within which a container on the same site holds a venue, and two venues are one.
CONTAINER, SAME_SPOT = 250.0, 40.0


def verdict(classes: Column, dissolved: Column, lon: Column, lat: Column, killed: list[str], venues: list[str], sites: list[str], arts: list[str]) -> Column:
    """Why a venue doesn't pass, the first reason that holds; null if it passes."""
    any_of = lambda names: F.arrays_overlap(classes, F.array(*map(F.lit, names)))
    return (
        F.when(any_of(killed), "kill-list").when(dissolved.isNotNull(), "dissolved").when(~any_of(venues), "not a museum class")
        .when(any_of(sites) & ~any_of(arts), "site, not a venue").when(lon.isNull() | lat.isNull() | F.isnan(lon) | F.isnan(lat), "no coordinates")
    )


def walk(starts: DataFrame, parents: DataFrame, hops: int = 3) -> DataFrame:
    """start, id, hop: what starts (id) reach along parents (id, parent), each at its first hop; hop 0 is the start."""
    seen = cut(starts.select(F.col("id").alias("start"), "id").distinct().withColumn("hop", F.lit(0)))
    front = seen
    for hop in range(1, hops + 1):
        step = front.select("start", "id").join(parents, "id").select("start", F.col("parent").alias("id")).distinct().join(seen, ["start", "id"], "left_anti")
        front = cut(step.withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return cut(seen)


def resolved(starts: DataFrame, passing: DataFrame, parents: DataFrame, hops: int = 3) -> DataFrame:
    """start, venue, hop, state: the first hop with a passing venue; two there are ambiguous, none is unresolved."""
    reached = walk(starts, parents, hops)
    found = reached.join(passing.select("id"), "id").groupBy("start", "hop").agg(F.count("*").alias("n"), F.min("id").alias("venue"))
    first = first_per(found, ["start"], [F.asc("hop")])
    rows = starts.select(F.col("id").alias("start")).distinct().join(first, "start", "left")
    state = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return rows.select("start", F.when(F.col("n") == 1, F.col("venue")).alias("venue"), F.when(F.col("n") == 1, F.col("hop")).alias("hop"), state.alias("state"))


def current(statements: DataFrame) -> DataFrame:
    """Statements (work, venue, property, rank, ended) that hold: no deprecated or ended ones, and of a property only the preferred if it has any."""
    live = statements.filter(F.col("rank").isin("preferred", "normal") & F.col("ended").isNull()).select("work", "property", "venue", "rank").distinct()
    preferred = F.max((F.col("rank") == "preferred").cast("int")).over(Window.partitionBy("work", "property"))
    return live.withColumn("_p", preferred).filter("_p = 0 OR rank = 'preferred'").select("work", "property", "venue").distinct()


def placed(values: DataFrame, links: DataFrame) -> DataFrame:
    """work, venue: owners and places that agree, being equal or one above the other; else the owners, else the places; the most specific of them.

    values: work, property (owner or place), venue; links: id, above. Venues that are each above the other are a tie and stay.
    """
    own, at = (values.filter(F.col("property") == p).select("work", "venue") for p in ("owner", "place"))
    same = links.select(F.col("id").alias("x"), F.col("above").alias("y")).unionByName(links.select(F.col("above").alias("x"), F.col("id").alias("y"))).distinct()
    equal = own.join(at, ["work", "venue"])
    related = own.withColumnRenamed("venue", "x").join(same, "x").join(at.withColumnRenamed("venue", "y"), ["work", "y"])
    agreed = equal.unionByName(related.select("work", F.col("x").alias("venue"))).unionByName(related.select("work", F.col("y").alias("venue"))).distinct()
    rank = agreed.withColumn("_r", F.lit(0)).unionByName(own.withColumn("_r", F.lit(1))).unionByName(at.withColumn("_r", F.lit(2)))
    chosen = rank.withColumn("_best", F.min("_r").over(Window.partitionBy("work"))).filter("_r = _best").select("work", "venue").distinct()
    return most_specific(chosen, links)


def most_specific(chosen: DataFrame, links: DataFrame) -> DataFrame:
    """Without venues that are strictly above another of the same work."""
    strict = links.join(links.select(F.col("above").alias("id"), F.col("id").alias("above")), ["id", "above"], "left_anti")
    above = chosen.withColumnRenamed("venue", "id").join(strict, "id").select("work", F.col("above").alias("venue")).distinct()
    return chosen.join(above, ["work", "venue"], "left_anti")


def metres(a: str, b: str) -> Column:
    """On a plane at the first one's latitude."""
    x = (F.col(f"{a}.lon") - F.col(f"{b}.lon")) * F.cos(F.radians(F.col(f"{a}.lat"))) * EQUATOR_DEGREE
    y = (F.col(f"{a}.lat") - F.col(f"{b}.lat")) * MERIDIAN_DEGREE
    return F.sqrt(x * x + y * y)


def folds(venues: DataFrame, parents: DataFrame) -> DataFrame:
    """id, into, why: venues folded into their container on the same site, or into a stronger record of the same spot.

    venues: id, lon, lat, works, links; parents: id, parent. Stronger has more works, then links, then the greater id. At one
    spot a venue folds into the strongest one that itself stays there. Cycles lose the fold of their strongest member.
    """
    a, b = venues.alias("a"), venues.alias("b")
    # Venues are many, though their file may be small: joins of them are told not to broadcast.
    near = a.join(parents.alias("p").hint("merge"), F.col("a.id") == F.col("p.id")).join(b.hint("merge"), F.col("p.parent") == F.col("b.id")).filter((F.col("a.id") != F.col("b.id")) & (metres("a", "b") <= CONTAINER))
    inside = near.select(F.col("a.id").alias("id"), F.col("b.id").alias("into"), metres("a", "b").alias("m"))
    inside = cut(first_per(inside, ["id"], [F.asc("m"), F.asc("into")]).select("id", "into", F.lit("container").alias("why")))
    rest = venues.join(inside.select("id").hint("merge"), "id", "left_anti")
    spot = same_spot(rest).withColumn("why", F.lit("same spot"))
    return acyclic(cut(inside.unionByName(spot)), venues)


def same_spot(venues: DataFrame) -> DataFrame:
    """id, into: venues (id, lon, lat, works, links) that fold into the strongest one near them that itself stays.

    Strongest first: who has no stronger open neighbour stays, those near it are no longer open, and so on. Only the strongest
    open venue of a cell asks in a round, and those that stay lie apart: however many venues share a spot, each meets a few.
    """
    size = SAME_SPOT / MERIDIAN_DEGREE
    # Degrees of longitude widen to the poles; a cell's column is as wide as its row needs.
    wide = lambda r: F.lit(size) / F.greatest(F.lit(1e-3), F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs(r * size), F.abs((r + 1) * size))))))
    row = F.floor(F.col("lat") / size).cast("long")
    cells = venues.select("id", "lon", "lat", F.struct("works", "links", "id").alias("s"), row.alias("_row")).withColumn("_col", F.floor(F.col("lon") / wide(F.col("_row"))).cast("long"))
    cells = cut(cells)

    def around(df: DataFrame) -> DataFrame:
        """h (id, lon, lat, s), _row, _col: a row for each cell in which a venue may have neighbours."""
        steps = lambda n: F.array(*[F.lit(d) for d in range(-n, n + 1)])
        rows = df.select(F.struct("id", "lon", "lat", "s").alias("h"), F.explode(F.transform(steps(1), lambda d: F.col("_row") + d)).alias("_row"))
        return rows.withColumn("_col", F.explode(F.transform(steps(2), lambda d: F.floor(F.col("h.lon") / wide(F.col("_row"))).cast("long") + d)))

    def close(x: str, y: str) -> Column:
        """At the latitude of x, the weaker."""
        at = lambda c, side: F.col(f"{side}{c}")
        return F.sqrt(F.pow((at("lon", x) - at("lon", y)) * F.cos(F.radians(at("lat", x))) * EQUATOR_DEGREE, F.lit(2)) + F.pow((at("lat", x) - at("lat", y)) * MERIDIAN_DEGREE, F.lit(2))) < SAME_SPOT

    open_, stays = cells, None
    while True:
        heads = cut(open_.groupBy("_row", "_col").agg(F.max_by(F.struct("id", "lon", "lat", "s"), "s").alias("_h")).select("_h.*", "_row", "_col"))
        if heads.isEmpty():
            break
        beaten = open_.join(around(heads).hint("merge"), ["_row", "_col"]).filter((F.col("s") > F.col("h.s")) & close("h.", "")).select(F.col("h.id").alias("id")).distinct()
        stay = cut(heads.join(beaten.hint("merge"), "id", "left_anti"))
        stays = stay if stays is None else stays.unionByName(stay)
        # What is near one that stays is weaker than it, or it would have been asked for.
        done = open_.join(around(stay).hint("merge"), ["_row", "_col"]).filter((F.col("id") == F.col("h.id")) | ((F.col("s") < F.col("h.s")) & close("", "h."))).select("id").distinct()
        open_ = cut(open_.join(done.hint("merge"), "id", "left_anti"))
    if stays is None:
        return cells.select("id", F.col("id").alias("into")).limit(0)
    found = cells.join(around(stays).hint("merge"), ["_row", "_col"]).filter((F.col("s") < F.col("h.s")) & close("", "h."))
    return found.groupBy("id").agg(F.max("h.s").alias("_s")).select("id", F.col("_s.id").alias("into"))


def acyclic(all_folds: DataFrame, venues: DataFrame) -> DataFrame:
    """Without the fold of the strongest member of each cycle. Every venue has one fold, so whoever reaches itself is on a cycle."""
    reach = walk(all_folds.select("id"), all_folds.select("id", F.col("into").alias("parent")), 64)
    back = reach.alias("r").join(all_folds.alias("f"), (F.col("r.id") == F.col("f.id")) & (F.col("f.into") == F.col("r.start"))).select(F.col("r.start").alias("id")).distinct()
    ring = reach.join(back.withColumnRenamed("id", "start"), "start").join(venues.select("id", F.struct("works", "links", "id").alias("_s")).hint("merge"), "id")
    keeper = ring.groupBy("start").agg(F.max_by("id", "_s").alias("id")).select("id").distinct()
    return all_folds.join(keeper, "id", "left_anti")


def survivors(all_folds: DataFrame) -> DataFrame:
    """id, survivor: what folds lead to; paths halve with each round."""
    now = cut(all_folds.select("id", F.col("into").alias("survivor")))
    while True:
        on = now.select(F.col("id").alias("survivor"), F.col("survivor").alias("_next"))
        nxt = cut(now.join(on, "survivor", "left").select("id", F.coalesce("_next", "survivor").alias("survivor"), F.col("_next").isNotNull().alias("_moved")))
        now = nxt.select("id", "survivor")
        if nxt.filter("_moved").isEmpty():
            return now


def art(has_art_class: Column, paintings: Column, sculptures: Column) -> Column:
    """A venue of an art class, or one whose known works are paintings rather than sculptures."""
    return has_art_class | ((paintings + sculptures > 0) & (paintings >= sculptures))


def placement_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """work, change (moved, gained, lost, dropped): works whose sets of venues differ. Both: work, venue (null for a work without one)."""
    sets = lambda df, name: df.groupBy("work").agg(F.array_join(F.array_sort(F.collect_set("venue")), "|").alias(name))
    rows = sets(before, "was").join(sets(now, "is"), "work", "full").filter("was IS NOT NULL AND NOT was <=> is")
    change = F.when(F.col("is").isNull(), "dropped").when((F.col("was") == ""), "gained").when(F.col("is") == "", "lost").otherwise("moved")
    return rows.select("work", change.alias("change"))


def pooled(works: DataFrame, broad: list[str]) -> DataFrame:
    """One row of each work (id, n, type, image, links): the first narrow type, else the first; the first image there is; the most links. n orders the rows."""
    narrow = ~F.col("type").isin(broad)
    order = F.col("n")
    kind = F.coalesce(F.min_by(F.when(narrow, F.col("type")), F.when(narrow, order)), F.min_by("type", order))
    return works.groupBy("id").agg(kind.alias("type"), F.min_by("image", F.when(F.col("image").isNotNull(), order)).alias("image"), F.max("links").alias("links"))
