"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1, given by knots between which the weight is linear. Its
integral is the source's weight in the mix. Targets share the wanted words by these weights; a target stops at `cap`
times its source's size and the excess is shared again. Within a source, documents follow a hash order; a copy of a
document takes the stretch of cumulative words that it covers, repeats after the whole source. A copy is taken while
its middle lies below the target, and its training position is the time at which the source's cumulative demand reaches
that middle (the schedule's integral inverted). Documents are then range-sorted by position.

The running sum within a source has two levels: about the square root of its documents hash ranges, and the documents
of one range; so a source with a third of all rows is spread as widely as the rest.

Defined cases: null or wordless texts have size 0, are taken 0 words and get no position; a null source is a source of
its own, the last; repeated rows are documents of their own; null ids are ordered by text; a table without words has
targets of 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import cut, ordered_parts, part_offsets, small, text_of, word_count

KNOTS = "array<struct<t:double,w:double,area:double>>"


def ramp(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating by rank; every other source rises from half to one and a half times its weight, the rest fall so."""
    weight = (rank % 3 + 1).cast("double")
    tilt = F.when(rank % 2 == 0, 0.5).otherwise(-0.5)
    return F.array(F.struct(F.lit(0.0).alias("t"), (weight * (1 - tilt)).alias("w")), F.struct(F.lit(1.0).alias("t"), (weight * (1 + tilt)).alias("w")))


def integrated(knots: Column) -> Column:
    """Adds to each knot the area under the schedule up to it."""
    step = lambda acc, k: F.concat(acc, F.array(F.struct(
        k["t"].alias("t"), k["w"].alias("w"),
        F.when(F.size(acc) == 0, F.lit(0.0)).otherwise(F.try_element_at(acc, F.lit(-1))["area"] + (k["t"] - F.try_element_at(acc, F.lit(-1))["t"]) * (k["w"] + F.try_element_at(acc, F.lit(-1))["w"]) / 2).alias("area"),
    )))
    return F.aggregate(knots, F.array().cast(KNOTS), step)


def inverse(knots: Column, area: Column) -> Column:
    """The time at which the integrated schedule reaches an area: within a segment the root of a quadratic."""
    at = F.greatest(F.lit(1), F.least(F.size(F.filter(knots, lambda k: k["area"] <= area)), F.size(knots) - 1))
    a, b = F.element_at(knots, at), F.element_at(knots, at + 1)
    rest, slope = F.greatest(F.lit(0.0), area - a["area"]), F.try_divide(b["w"] - a["w"], b["t"] - a["t"])
    root = F.sqrt(F.greatest(F.lit(0.0), a["w"] * a["w"] + 2 * F.coalesce(slope, F.lit(0.0)) * rest))
    return F.least(b["t"], a["t"] + F.coalesce(F.try_divide(2 * rest, a["w"] + root), F.lit(0.0)))


def source_targets(sized: DataFrame, schedule: Callable[[Column], Column], share: float, cap: float) -> DataFrame:
    """Per source: _source, _source_size, _docs, _knots, _target. sized: _source, _size."""
    sums = sized.groupBy("_source").agg(F.sum("_size").alias("_source_size"), F.count("*").alias("_docs"))
    parts = ordered_parts(sums, [F.col("_source").asc_nulls_last()])
    within = Window.partitionBy("_part").orderBy(F.col("_source").asc_nulls_last())
    rank = F.row_number().over(within) - 1 + F.col("_offset")
    knots = integrated(schedule(F.col("_rank")))
    ranked = parts.join(F.broadcast(part_offsets(parts, F.lit(1))), "_part").withColumn("_rank", rank).withColumn("_knots", knots)
    ranked = cut(ranked.withColumn("_weight", F.element_at("_knots", -1)["area"]).select("_source", "_source_size", "_docs", "_knots", "_weight"))

    # All targets are min(cap * size, level * weight); the level rises as sources reach their caps.
    most = F.col("_source_size") * F.lit(float(cap))
    wanted = (ranked.agg(F.sum("_source_size")).first()[0] or 0) * float(share)
    level = -1.0
    while True:
        full = most <= F.lit(level) * F.col("_weight")
        held, weight = ranked.agg(F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_weight")))).first()
        new = (wanted - held) / weight if weight else level
        if not weight or new <= level:
            break
        level = new
    return ranked.withColumn("_target", F.least(most, F.greatest(F.lit(0.0), F.lit(level) * F.col("_weight")))).drop("_weight")


def planned(docs: DataFrame, size: Column, source: Column, order: list[Column], schedule=ramp, share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """All columns of docs in a struct _row, with _source, _size, _source_size, _target, _copies and _positions, an array of training times.

    order: what breaks ties of the hash order; the first column is hashed.
    """
    rows = docs.select(F.struct("*").alias("_row"), source.alias("_source"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"), F.struct(*order).alias("_tie"))
    rows = rows.withColumn("_u", F.pmod(F.xxhash64(F.lit("mix"), "_tie"), F.lit(1 << 53)) / F.lit(float(1 << 53)))
    sources = small(cut(source_targets(rows.select("_source", "_size"), schedule, share, cap).withColumnRenamed("_source", "_of")))

    def ranged(part: DataFrame) -> DataFrame:
        joined = part.join(sources, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
        return joined.withColumn("_range", F.floor(F.col("_u") * F.ceil(F.sqrt(F.col("_docs").cast("double")))))

    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged(rows.select("_source", "_size", "_u")).groupBy("_source", "_range").agg(F.sum("_size").alias("_in_range"))
    ranges = ranges.select(F.col("_source").alias("_of"), F.col("_range").alias("_at"), F.coalesce(F.sum("_in_range").over(before), F.lit(0)).alias("_before"))
    # About the square root of a source's documents: broadcast if counted small, so that whole rows aren't shuffled for it.
    ranges = small(cut(ranges))
    within = Window.partitionBy("_source", "_range").orderBy("_u", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged(rows).withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    placed = placed.join(ranges, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at"))).drop("_of", "_at")

    middle = F.col("_before") + F.col("_within") + F.col("_size") / 2
    copies = F.when(F.col("_size") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(int(cap)), F.ceil(F.try_divide(F.col("_target") - middle, F.col("_source_size"))))))
    area = F.element_at("_knots", -1)["area"]
    out = placed.withColumn("_copies", copies.cast("int")).withColumn("_middle", middle)
    times = F.transform(F.sequence(F.lit(0), F.col("_copies") - 1), lambda e: inverse(F.col("_knots"), (F.col("_middle") + e * F.col("_source_size")) / F.col("_target") * area))
    return out.withColumn("_positions", F.when(F.col("_copies") > 0, times).otherwise(F.array().cast("array<double>"))).select("_row", "_source", "_size", "_source_size", "_target", "_copies", "_positions", "_u", "_tie")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix: the columns of docs, a row for each copy taken, range-sorted by training position."""
    text = text_of(text_col)
    plan = planned(docs, word_count(text), F.col(source_col), [F.col(id_col), F.xxhash64(text)], **options)
    copies = plan.select("_row", "_tie", F.explode("_positions").alias("_position"))
    return copies.orderBy("_position", "_tie").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Per document, range-sorted by training position (those not taken last): id, size, source_size, target, taken, copies, position of the first copy."""
    text = text_of(text_col)
    sized = cut(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text).alias("_size"), F.xxhash64(text).alias("_hash")))
    plan = planned(sized, F.col("_size"), F.col("_source"), [F.col("_id"), F.col("_hash")], **options)
    first = F.try_element_at("_positions", F.lit(1))
    return plan.orderBy(F.coalesce(first, 1 + F.col("_u")), "_tie").select(
        F.col("_row")["_id"].alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"), first.alias("position"),
    )
