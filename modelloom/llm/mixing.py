"""Mixing sources to target weights.

Every document gets a random key from a hash. The keys are range-sorted within each
source, sizes are summed up in that order, first by partition and then within the one
partition of each source in which its budget ends, and the source is cut exactly there.
Sources whose target exceeds their size are repeated whole before. All that is left of
the order is one cut per source, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelloom.functions import col
from modelloom.llm.common import checkpointed, partitions_for, unclashing

BLANK = r"[\x20\x09-\x0D]"
#: Rows of a partition of the sorted keys, and sources up to which their cuts are broadcast.
ROWS_EACH, BROADCAST_SOURCES = 20_000, 20_000
ADDED = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, f"{BLANK}+"), "")).cast("long"), F.lit(0).cast("long"))


def source_targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``sources(name, source_size)`` with ``target``: shares by weight, none above ``most`` times its size.

    Weights repeat along the names by code point, null last. What lies above a source's
    limit is shared out again by weight; the common rate per weight only rises, so each
    round is one aggregate over the sources until no further source reaches its limit.
    """
    order = [F.col("name").asc_nulls_last()]
    n = sources.count()
    ordered = checkpointed(sources.repartitionByRange(partitions_for(n, ROWS_EACH), *order).sortWithinPartitions(*order))
    ordered = checkpointed(ordered.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # One row per partition of the sort, a window over these.
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("first"))
    ordered = ordered.withColumn("part", part).join(starts, "part")
    place = F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    limited = checkpointed(ordered.withColumn("weight", weight).drop("part", "first").withColumn("limit", F.col("source_size") * F.lit(float(most))))
    rate = -1.0
    while True:
        open_ = F.col("limit") > rate * F.col("weight")
        total, full, left = limited.agg(
            F.sum("source_size"), F.sum(F.when(~open_, F.col("limit"))), F.sum(F.when(open_, F.col("weight")))
        ).first()
        if not left:
            break
        raised = (float(total) - float(full or 0)) / left
        if raised <= rate:
            break
        rate = raised
    return limited.withColumn("target", F.least("limit", F.lit(max(rate, 0.0)) * F.col("weight"))).select("name", "source_size", "target")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    most: float = 3,
    seed: int = 1,
) -> DataFrame:
    """All columns of ``docs`` and ``size``, ``source_size``, ``target``, ``taken`` of every row.

    ``size`` counts the words of the whole text, ``target`` is what the mix should take of
    the row's source, ``taken`` what it takes of the row, repeats counted: whole passes over
    the source, then rows in the order of their keys until the target, rounded to a word, is
    met; the row at the cut gives a part. Null and empty texts have size 0 and are not
    taken. Rows without a source are a source of their own. Equal rows have equal keys and
    share a cut evenly, which may leave out fewer words than there are such rows. Columns
    with the added names give way. An empty table stays empty. Reruns agree.
    """
    key = F.xxhash64(F.lit(seed), col(id_col), col(text_col))
    text = col(text_col).cast("string")
    light = docs.select(col(source_col).cast("string").alias("name"), key.alias("key"), word_count(text).alias("size"))
    light = checkpointed(light)
    sources = light.groupBy("name").agg(F.sum("size").alias("source_size"))
    targets = checkpointed(source_targets(sources, weights, most))
    quota = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("passes", whole).withColumn("rest", quota - F.col("passes") * F.col("source_size"))

    order = ["name", "key"]
    ordered = light.where("size > 0").repartitionByRange(partitions_for(light.count(), ROWS_EACH), *order)
    ordered = checkpointed(ordered.sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())
    sums = ordered.groupBy("name", "part").agg(F.sum("size").alias("part_size"))
    along = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("part_size").over(along), F.lit(0)))
    same = F.col("s.name").eqNullSafe(F.col("t.name"))
    ends = sums.alias("s").join(targets.where("rest > 0").alias("t"), same).where("rest >= before AND rest < before + part_size")
    ends = ends.select(F.col("s.name").alias("end_name"), F.col("part").alias("end_part"), "before", "rest")
    inside = ordered.join(ends, F.col("name").eqNullSafe(F.col("end_name")) & (F.col("part") == F.col("end_part")))
    # Equal keys lie in one partition, and are summed up as one.
    tied = inside.groupBy("name", "key", "before", "rest").agg(F.sum("size").alias("size"), F.count("*").alias("ties"))
    within = Window.partitionBy("name").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("reached", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    share = F.floor((F.col("rest") - F.col("reached")) / F.col("ties"))
    cuts = tied.where("rest >= reached AND rest < reached + size").select("name", F.col("key").alias("cut"), share.alias("part"))
    plan = targets.alias("t").join(cuts.alias("c"), F.col("t.name").eqNullSafe(F.col("c.name")), "left")
    plan = checkpointed(plan.select(F.col("t.name").alias("__name"), "source_size", "target", "passes", "cut", "part"))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    kept = unclashing(docs, ADDED)
    # The inputs are kept under other names until the end, in case their columns give way.
    rows = docs.select(
        *[col(c) for c in kept], col(source_col).cast("string").alias("__source"), key.alias("__key"), word_count(text).alias("size")
    )
    joined = rows.join(plan, F.col("__source").eqNullSafe(F.col("__name")), "left")
    last = F.when(F.col("__key") < F.col("cut"), F.col("size")).when(F.col("__key") == F.col("cut"), F.least("part", "size")).otherwise(0)
    taken = (F.col("passes") * F.col("size") + last).cast("long")
    return joined.select(*[col(c) for c in kept], "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"))


def mixed_rows(mix: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The rows that a mix consists of: whole repeats, and the first words of what is taken in part.

    ``mix`` is a result of ``mix_sources``, whose added columns are dropped. ``chars_col``, if
    given, is set to the length of a text that was cut.
    """
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.array_repeat(part, (part > 0).cast("int")))
    rows = mix.withColumn("__part", F.explode(copies))
    pieces = F.split(col(text_col), f"(?<={BLANK})(?=[^\\x20\\x09-\\x0D])")
    lead = F.col("__pieces")[0].rlike(f"^{BLANK}*$").cast("int")
    cut = F.regexp_replace(F.array_join(F.slice("__pieces", 1, F.col("__part") + lead), ""), f"{BLANK}+$", "")
    rows = rows.withColumn("__pieces", F.when(F.col("__part") > 0, pieces))
    rows = rows.withColumn(text_col, F.when(F.col("__part") > 0, cut).otherwise(col(text_col)))
    if chars_col is not None:
        rows = rows.withColumn(chars_col, F.when(F.col("__part") > 0, F.length(col(text_col)).cast(mix.schema[chars_col].dataType)).otherwise(col(chars_col)))
    return rows.drop("__part", "__pieces", *ADDED)
