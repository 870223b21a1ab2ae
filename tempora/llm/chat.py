"""Multi-party dialogues, rendered once from each participant's place.

Every participant is the assistant in one rendering; the other speakers are
users with their names, system turns stay system turns, and the mask marks the
participant's own turns, header left out.  A rendering is given turn by turn:
`start` is the piece's first character in it and `mask_start` to `mask_end`
the characters to train on, so a long dialogue is never one value.

Turns are in order of turn, null last, then speaker and text; turns with equal
values are interchangeable.  A null role is the speaker "", null text is empty,
and rows with a null conv_id form one dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns whose lengths are summed before positions in the whole dialogue are counted.
STRETCH = 64


def rotate_perspectives(turns: DataFrame, system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """Pieces of every rendering of `turns` (conv_id, turn, role, text)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    system = F.col("role").isin(*system_roles) if system_roles else F.lit(False)
    who = rows.filter(~system).select(F.col("conv_id").alias("of"), F.col("role").alias("participant")).distinct()
    own = F.col("role") == F.col("participant")
    head = F.when(own, F.lit("<|im_start|>assistant\n")).when(system, F.lit("<|im_start|>system\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), F.col("role"), F.lit("\n")))
    stretch = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(2**62))
    seen = (
        rows.join(who, F.col("conv_id").eqNullSafe(F.col("of")))
        .withColumns({"own": own, "head": F.length(head), "piece": F.concat(head, "text", F.lit("<|im_end|>\n")), "stretch": stretch})
        .withColumn("n", F.length("piece").cast("long"))
    )
    keys = ["of", "participant"]
    sums = seen.groupBy("of", "participant", "stretch").agg(F.sum("n").alias("chars"), F.count("*").alias("turns"))
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("of").alias("of_"), F.col("participant").alias("participant_"), F.col("stretch").alias("stretch_"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars"), F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns"))
    joined = seen.join(sums, F.col("of").eqNullSafe(F.col("of_")) & (F.col("participant") == F.col("participant_")) & (F.col("stretch") == F.col("stretch_")))
    order = Window.partitionBy("of", "participant", "stretch").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    inside = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.col("chars") + inside
    placed = joined.withColumns({"seq": F.col("turns") + F.row_number().over(order) - 1, "start": start})
    mask_start = F.when(F.col("own"), F.col("start") + F.col("head"))
    return placed.select("conv_id", "participant", "seq", "turn", "piece", "start", mask_start.alias("mask_start"), F.when(F.col("own"), F.col("start") + F.col("n") - 1).alias("mask_end"))


def op10_perspectives(spark, sf_dir) -> DataFrame:
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP10_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
r AS (SELECT t.*, participant, role = participant AS own,
        CASE WHEN role = participant THEN '<|im_start|>assistant' || chr(10)
             WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
             ELSE '<|im_start|>user name=' || role || chr(10) END AS head
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
q AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM r),
s AS (SELECT *, row_number() OVER w - 1 AS seq,
        coalesce(sum(length(piece)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM q WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn NULLS LAST, role, text))
SELECT conv_id, participant, seq, turn, piece, start,
       CASE WHEN own THEN start + length(head) END AS mask_start,
       CASE WHEN own THEN start + length(piece) - 1 END AS mask_end
FROM s
"""
