"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation again after every turn. Turns are range-sorted; places and a
rolling hash are found within each partition and carried on to the next, so a long
conversation is no hot key. The rolling hash over the turns names each conversation's every beginning; a conversation whose whole hash is the beginning of a
longer one is a snapshot of it. Copies fold into the smallest id first and equal beginnings
are counted once, so neither a conversation that is logged very often nor a common first
turn is a hot key. What an anti-join leaves is maximal, and only that is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelloom.functions import col
from modelloom.llm.common import checkpointed, partitions_for

#: Rows of a partition of the sorted turns.
TURNS_EACH = 20_000
#: How a turn is written; a widely used public convention.
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"


def ordered_turns(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """``conv_id, role, text`` of every turn, its partition ``part`` and a number ``id`` that follows the order.

    Turns are range-sorted by conversation, number, role and text, so that a conversation of
    any length lies in as many partitions as it fills.
    """
    named = turns.select(
        col(conv_col).alias("conv_id"),
        col(turn_col).alias("turn"),
        F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    ).distinct()
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text"]
    ordered = named.repartitionByRange(partitions_for(turns.count(), TURNS_EACH), *order).sortWithinPartitions(*order)
    ordered = checkpointed(ordered.select("conv_id", "role", "text"))
    return ordered.withColumn("part", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id())


def carried(groups: DataFrame, value: str, combine) -> DataFrame:
    """``value`` of a conversation's earlier partitions, for the one conversation that each may carry on."""
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = groups.withColumn("carry", combine(value).over(earlier)).where("carry IS NOT NULL")
    # One row per sort partition at most.
    return F.broadcast(carry.select(F.col("conv_id").alias("c_conv"), F.col("part").alias("c_part"), "carry"))


def rolling_turns(ordered: DataFrame) -> DataFrame:
    """``conv_id, part, place`` of every turn, the hashes ``h1, h2`` of the turns up to it, and whether it ``ends`` its part."""
    within = Window.partitionBy("conv_id", "part").orderBy("id")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("part") == F.col("c_part"))
    light = ordered.select("conv_id", "part", "id", *[F.xxhash64(F.lit(i), "role", "text").alias(f"t{i}") for i in (1, 2)])
    sizes = light.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    local = light.withColumn("place", F.row_number().over(within).cast("long")).withColumn("ends", F.lead("id").over(within).isNull())
    placed = local.join(carried(sizes, "n", F.sum), same, "left")
    placed = placed.withColumn("place", F.col("place") + F.coalesce("carry", F.lit(0))).drop("c_conv", "c_part", "carry")
    for i in (1, 2):
        placed = placed.withColumn(f"t{i}", F.xxhash64(F.lit(i), "place", f"t{i}"))
    placed = checkpointed(placed)
    rolled = placed.withColumns({f"h{i}": F.bit_xor(f"t{i}").over(so_far) for i in (1, 2)})
    for i in (1, 2):
        sums = placed.groupBy("conv_id", "part").agg(F.bit_xor(f"t{i}").alias("sum"))
        rolled = rolled.join(carried(sums, "sum", F.bit_xor), same, "left")
        rolled = rolled.withColumn(f"h{i}", F.col(f"h{i}").bitwiseXOR(F.coalesce("carry", F.lit(0)))).drop("c_conv", "c_part", "carry")
    return checkpointed(rolled.select("conv_id", "part", "place", "h1", "h2", "ends"))


def maximal_conversations(rolled: DataFrame) -> DataFrame:
    """``(conv_id, n_turns)`` of the conversations that are neither a copy nor a beginning of another."""
    last = rolled.groupBy("conv_id").agg(F.max(F.struct("place", "h1", "h2")).alias("last"))
    whole = last.groupBy("last").agg(F.min("conv_id").alias("conv_id"))
    whole = whole.select("conv_id", F.col("last.place").alias("n_turns"), F.col("last.h1").alias("h1"), F.col("last.h2").alias("h2"))
    # Only the last turn of a part can be the last of its conversation; others are beginnings.
    ends = last.select(F.col("conv_id").alias("other"), F.col("last.place").alias("n"))
    same = F.col("conv_id").eqNullSafe(F.col("other")) & (F.col("place") < F.col("n"))
    beginnings = rolled.where("NOT ends").union(rolled.where("ends").join(ends, same, "left_semi"))
    beginnings = beginnings.select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(beginnings, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def format_chats(turns: DataFrame, template: str = TEMPLATE, **columns: str) -> DataFrame:
    """``conv_id, n_turns, rendered`` of every maximal conversation.

    Turns are ordered by number (null last), role and text; rows equal in conversation,
    number, role and text are one turn. Null roles and texts are empty. Turns without a
    conversation id are one conversation, whose id is null. Of equal conversations the
    smallest id stays. Other columns are ignored, and an empty table gives no rows. A rendered
    conversation is one value, also that of turns without an id: its turns are put in order
    and hashed in many tasks and joined to one string of each part there; only these strings
    meet in one task.
    """
    ordered = ordered_turns(turns, **columns)
    rolled = rolling_turns(ordered)
    kept = maximal_conversations(rolled).select(F.col("conv_id").alias("kept_id"), "n_turns")
    same = F.col("conv_id").eqNullSafe(F.col("kept_id"))
    parts = rolled.where("ends").join(kept, same).select("kept_id", F.col("part").alias("kept_part"), "n_turns")
    before, _, rest = template.partition("{role}")
    between, _, after = rest.partition("{text}")
    line = F.concat(F.lit(before), "role", F.lit(between), "text", F.lit(after))
    rows = ordered.join(parts, same & (F.col("part") == F.col("kept_part")))
    lines = F.sort_array(F.collect_list(F.struct("id", line.alias("line"))))
    pieces = rows.groupBy("conv_id", "n_turns", "part").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("piece"))
    pieces = pieces.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("part", "piece"))).alias("pieces"))
    return pieces.select("conv_id", "n_turns", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("rendered"))


SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS place FROM turns),
whole AS (
  SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY place) AS said,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
  FROM placed GROUP BY conv_id),
beginnings AS (SELECT DISTINCT said[1:n] AS said FROM (SELECT said, unnest(range(1, n_turns)) AS n FROM whole)),
single AS (SELECT min(conv_id) AS conv_id, said FROM whole GROUP BY said)
SELECT w.conv_id, w.n_turns, w.rendered
FROM whole w JOIN single s ON w.conv_id IS NOT DISTINCT FROM s.conv_id
WHERE NOT EXISTS (SELECT 1 FROM beginnings b WHERE b.said = w.said)
"""
