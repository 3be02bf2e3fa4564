"""Chat formatting: multi-party perspective rotation (DataFrame functions only).

Every participant of a conversation gets the dialogue rendered with their own turns
as the assistant's and all other turns as those of named users, and the spans of the
assistant's text as its loss mask. A rendering comes in chunks of ``CHUNK`` turns, in
order; joined they are the whole dialogue, so no task and no row holds a conversation
of any length, whatever its turn numbers are: places come from a sort by ranges and
the sizes of the ranges, never from one conversation in one task. Work is turns times
participants of the conversation, which is what the renderings hold.

Defined cases: rows repeated with equal conv_id, turn, role and text count once;
a null turn sorts before all others (as -1); a null role is ``unknown``, a null text
empty; a null conv_id is a conversation of its own; turns of one number are ordered
by role, then by the text's MD5; ``<|`` in a text or a role becomes ``< |``, and a line's end in a
role a space, so that neither can end a turn or open one (roles that are the same after it are one);
roles in ``NOT_SPEAKERS`` are rendered under their own name for everybody and get no
perspective; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

CHUNK = 64
NOT_SPEAKERS = ("system",)
START, END = "<|im_start|>", "<|im_end|>"


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, speaker, text: defined values for nulls, repeated rows once."""
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.translate(F.replace(F.coalesce("role", F.lit("unknown")), F.lit("<|"), F.lit("< |")), "\n\r", "  ").alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    ).distinct()


def placed(own: DataFrame) -> DataFrame:
    """``own`` with each turn's place in its conversation, 0 first."""
    order = ["conv_id", "turn", "speaker", "tie"]
    ordered = own.withColumn("tie", F.md5(F.col("text").cast("binary"))).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    # Of the id the upper bits are the range, the lower 33 the place in it.
    at = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "turns")
    part = lambda c: F.shiftright(c, 33)
    sizes = at.groupBy(part(F.col("at")).alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range: at most the shuffle partitions
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    found = at.join(F.broadcast(offsets), part(F.col("at")) == F.col("part")).withColumn("place", F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1))
    # Written, so that a conversation with very many turns is a skewed join key, which AQE splits.
    firsts = materialize(found.groupBy("conv_id").agg(F.min("place").alias("first")).withColumnRenamed("conv_id", "_c"), "firsts")
    return found.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "speaker", "text", (F.col("place") - F.col("first")).alias("place"))


def rotate(rows: DataFrame) -> DataFrame:
    """conv_id, perspective, chunk, n_turns, n_own, text, spans (start, stop of own text in code points)."""
    own = placed(turns(rows))
    chunks = own.groupBy("conv_id", F.floor(F.col("place") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("place", "speaker", "text"))).alias("turns"))
    speakers = own.where(~F.col("speaker").isin(*NOT_SPEAKERS)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    # A conversation with very many turns is a skewed key here, which AQE splits.
    both = chunks.alias("c").join(speakers.alias("s"), F.col("c.conv_id").eqNullSafe(F.col("s.conv_id"))).select("c.conv_id", "s.perspective", "c.chunk", "c.turns")

    def head(t):
        mine = t["speaker"] == F.col("perspective")
        fixed = t["speaker"].isin(*NOT_SPEAKERS)
        name = F.when(mine, F.lit("assistant")).when(fixed, t["speaker"]).otherwise(F.concat(F.lit("user name="), t["speaker"]))
        return F.concat(F.lit(START), name, F.lit("\n"))

    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["text"].alias("text"), (t["speaker"] == F.col("perspective")).alias("mine")))
    both = both.select("conv_id", "perspective", "chunk", parts.alias("parts"))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))

    def step(state, p):
        start = state["at"] + F.length(p["head"])
        stop = start + F.length(p["text"])
        span = F.struct(start.alias("start"), (stop + len(END)).alias("stop"))
        return F.struct((stop + len(END) + 1).alias("at"), F.when(p["mine"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return both.select(
        "conv_id",
        "perspective",
        "chunk",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["mine"])).cast("long").alias("n_own"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(END + "\n"))), "").alias("text"),
        F.aggregate("parts", empty, step)["spans"].alias("spans"),
    )


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")
    return found.select("conv_id", "perspective", "chunk", "n_turns", "n_own", "text", mask.alias("mask"))


ORACLE = f"""
with own as (
  select distinct cast(conv_id as bigint) conv_id, coalesce(cast(turn as bigint), -1) turn, translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10) || chr(13), '  ') speaker,
    replace(coalesce(text, ''), '<|', '< |') txt
  from conversations
), speakers as (
  select distinct conv_id, speaker perspective from own where speaker <> 'system'
), ranked as (
  select *, row_number() over (partition by conv_id order by turn, speaker, md5(txt)) - 1 place from own
), parts as (
  select o.conv_id, s.perspective, cast(o.place // {CHUNK} as bigint) chunk, o.place, o.speaker, o.txt, o.speaker = s.perspective mine,
    '{START}' || case when o.speaker = s.perspective then 'assistant' when o.speaker = 'system' then o.speaker else 'user name=' || o.speaker end || chr(10) head
  from ranked o join speakers s on o.conv_id is not distinct from s.conv_id
), placed as (
  select *, coalesce(sum(length(head) + length(txt) + {len(END) + 1}) over (partition by conv_id, perspective, chunk order by place rows between unbounded preceding and 1 preceding), 0) before
  from parts
)
select conv_id, perspective, chunk, count(*) n_turns, count(*) filter (mine) n_own,
  string_agg(head || txt || '{END}' || chr(10), '' order by place) as text,
  coalesce(string_agg(cast(before + length(head) as bigint) || '-' || cast(before + length(head) + length(txt) + {len(END)} as bigint), ',' order by place) filter (mine), '') mask
from placed group by conv_id, perspective, chunk
"""
