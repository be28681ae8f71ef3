"""Chat formatting by cumulative-snapshot collapse. DataFrame functions only.

Chat logs often hold the same conversation many times, each snapshot longer by a turn. Rolling hashes of turn prefixes
identify the snapshots that are a prefix of a longer conversation; anti-joins retain the maximal conversations, of equal ones
the least conv_id; these are rendered with a chat template.

A prefix hash is the exclusive-or of two 64-bit hashes of (rank, role, text) over the turns so far. Ranks and running hashes are
first made within chunks of turns, then carried over chunks, so one very long conversation is dealt to many tasks. Copies
of a conversation meet as one row: they are grouped by hash with partial aggregation before any join.

Defined results: turns are in the order of turn, role, text, a null turn first; null roles and texts count as empty strings in
the output but differ from them in hashes; repeated rows are turns of their own; rows whose conv_id is null are dropped; an empty table
gives an empty result; other columns are ignored. A conversation is one row, rendered by chunks of turns whose texts are then joined; where conversations may be
too long for a row (Spark's limit is 2 GB), turns_a_row cuts them into parts. It is off by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsframe.llm.common import materialise

#: Turns a chunk.
CHUNK = 512
#: The chat template: what opens a turn's role, what follows it, what closes the turn.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _hashes(rank: Column) -> list[Column]:
    one = F.xxhash64(rank, F.col("role"), F.col("text"), F.col("role").isNull(), F.col("text").isNull())
    two = F.xxhash64(F.lit("second"), F.col("text"), F.col("text").isNull(), rank, F.col("role"), F.col("role").isNull())
    return [one, two]


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """Each turn with its rank in the conversation (from 1), the conversation's length, and the hashes h1, h2 of its prefix up to it."""
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 60))))
    sizes = turns.groupBy("conv_id", "chunk").agg(F.count("*").alias("in_chunk"))
    by_conv = Window.partitionBy("conv_id").orderBy("chunk")
    starts = sizes.select("conv_id", "chunk", (F.sum("in_chunk").over(by_conv) - F.col("in_chunk")).alias("before"), F.sum("in_chunk").over(Window.partitionBy("conv_id")).alias("n_turns"))
    in_order = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    local = turns.withColumn("k", F.row_number().over(in_order)).join(starts, ["conv_id", "chunk"])
    local = local.withColumn("rank", (F.col("k") + F.col("before")).cast("long"))
    e1, e2 = _hashes(F.col("rank"))
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rolled = local.withColumns({"e1": e1, "e2": e2}).withColumns({"l1": F.bit_xor("e1").over(so_far), "l2": F.bit_xor("e2").over(so_far)})
    whole = rolled.groupBy("conv_id", "chunk").agg(F.bit_xor("e1").alias("c1"), F.bit_xor("e2").alias("c2"))
    earlier = by_conv.rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(f"c{i}").over(earlier), F.lit(0).cast("long")).alias(f"p{i}") for i in (1, 2)])
    out = rolled.join(carried, ["conv_id", "chunk"])
    return out.select("conv_id", "turn", "role", "text", "rank", "n_turns", F.col("l1").bitwiseXOR(F.col("p1")).alias("h1"), F.col("l2").bitwiseXOR(F.col("p2")).alias("h2"))


def conversation_status(turns: DataFrame) -> DataFrame:
    """Of ranked turns: (conv_id, n_turns, keep_id, maximal): keep_id the least conv_id of equal conversations, maximal if no longer one has it as prefix."""
    key = ["rank", "h1", "h2"]
    prefixes = turns.where("rank < n_turns").select(*key).groupBy(*key).agg(F.lit(1).alias("one")).select(*key)
    ends = turns.where("rank = n_turns").select("conv_id", *key)
    classes = ends.groupBy(*key).agg(F.min("conv_id").alias("keep_id"))
    longest = classes.join(prefixes, key, "left_anti").select("keep_id", F.lit(True).alias("maximal"))
    status = ends.join(classes, key).select("conv_id", F.col("rank").alias("n_turns"), "keep_id")
    return status.join(longest, "keep_id", "left").select("conv_id", "n_turns", "keep_id", F.coalesce("maximal", F.lit(False)).alias("maximal"))


def format_chats(conversations: DataFrame, turns_a_row: int | None = None) -> DataFrame:
    """The maximal conversations rendered: conv_id, part (0, or from 0 where turns_a_row cuts), n_turns (of the part), rendered."""
    turns = materialise(ranked_turns(conversations), "turns")
    stay = conversation_status(turns).where("maximal and conv_id = keep_id").select("conv_id")
    segment = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(AFTER_ROLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    at = F.col("rank") - 1
    part = F.floor(at / turns_a_row) if turns_a_row else F.lit(0).cast("long")
    kept = turns.join(stay, "conv_id", "left_semi").select("conv_id", part.alias("part"), F.floor(at / CHUNK).alias("chunk"), F.struct("rank", segment.alias("s")).alias("r"))
    chunks = kept.groupBy("conv_id", "part", "chunk").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    chunks = chunks.select("conv_id", "part", F.size("rs").cast("long").alias("n"), F.struct("chunk", F.array_join(F.col("rs.s"), "").alias("s")).alias("c"))
    parts = chunks.groupBy("conv_id", "part").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("c")).alias("cs"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.col("cs.s"), "").alias("rendered"))


ORACLE_SQL = """
with t as (
  select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x, coalesce('=' || role, '') || chr(2) || coalesce('=' || text, '') as m,
         row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k
  from conversations where conv_id is not null),
p as (
  select *, string_agg(m || chr(3), '') over (partition by conv_id order by k rows between unbounded preceding and current row) as prefix,
         count(*) over (partition by conv_id) as n
  from t),
ends as (select conv_id, prefix, n from p where k = n),
best as (select min(conv_id) as conv_id from ends where prefix not in (select prefix from p where k < n) group by prefix)
select p.conv_id, cast(0 as bigint) as part, count(*) as n_turns,
       string_agg('<|im_start|>' || r || chr(10) || x || '<|im_end|>' || chr(10), '' order by k) as rendered
from p join best on p.conv_id = best.conv_id group by 1
"""
