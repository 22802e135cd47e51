"""Multi-party perspective rotation: each speaker in turn becomes the assistant.

One row per conversation, perspective and part. The perspective's own turns are rendered as
``assistant`` and carry the loss mask; ``system`` turns stay system; every other speaker is a
``user`` with a name. DataFrame functions only.

Defined cases. A conversation's turns are ordered by number (those without one last), role and text (by code point, nulls first) and cut by
that running order into parts of ``turns_per_part``, so one huge conversation is spread over many rows whatever its numbers;
ordinary ones have the single part 0. Parts are slices of one rendering: joined in their order they are the whole dialogue, and ``offset`` is where a part begins in it. Repeated
turns are all rendered; in conversations of several parts copies are counted before the shuffle and dealt to parts by their
count, so no number of them meets in one group. A null text renders empty. A null role is an unnamed user and no perspective; a part
in which a speaker says nothing is still rendered for that speaker. A row with a null conv_id belongs to no dialogue and is one of its own. A
conversation with system turns only has no rows, and so has an empty table. Other columns are ignored. Texts are rendered as
they are: markers inside them are not escaped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidegraph.storage import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def in_parts(turns: DataFrame, turns_per_part: int) -> DataFrame:
    """(conv_id, part, loose, turn, role, text, n): the different turns of each part, with their number of copies in it.

    The running order comes from a range partitioning by conversation and turn, counts within its partitions and sums of
    the partitions before: no task sees a whole conversation.
    """
    order = ["conv_id", "loose", "turn", "role", "text"]
    kinds = turns.groupBy(*order).agg(F.count(F.lit(1)).alias("n"))
    placed = materialize(kinds.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("slice", F.shiftright("at", 33))
    inner = F.sum("n").over(W.partitionBy("slice", "conv_id").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow))
    slices = placed.groupBy("slice", "conv_id").agg(F.sum("n").alias("many"))
    before = F.sum("many").over(W.partitionBy("conv_id").orderBy("slice")) - F.col("many")
    placed = placed.withColumn("upto", inner).join(slices.select("slice", "conv_id", before.alias("before")), ["slice", "conv_id"])
    placed = placed.withColumn("to", F.col("before") + F.col("upto")).withColumn("from", F.col("to") - F.col("n"))
    number = lambda x: F.floor(x / F.lit(turns_per_part)).cast("long")
    cut = placed.withColumn("part", F.explode(F.sequence(number(F.col("from")), number(F.col("to") - 1))))
    copies = F.least("to", (F.col("part") + 1) * turns_per_part) - F.greatest("from", F.col("part") * turns_per_part)
    return cut.select("conv_id", "part", "loose", "turn", "role", "text", copies.cast("int").alias("n"))


def rotate_perspectives(turns: DataFrame, turns_per_part: int = 512) -> DataFrame:
    """(conv_id, perspective, part, n_turns, n_masked, text, mask, offset) of a table (conv_id, turn, role, text).

    mask: code-point spans ``start:end`` of ``text`` (end exclusive, comma-joined) that count for
    the loss: the assistant's words with the closing marker.
    """
    turns = turns.select("conv_id", "turn", "role", "text", F.col("turn").isNull().alias("loose"))
    speaks = F.col("role").isNotNull() & (F.col("role") != "system")
    alone = turns.where(F.col("conv_id").isNull() & speaks)
    turns = turns.where("conv_id is not null")
    speakers = turns.where(speaks).select("conv_id", F.col("role").alias("perspective")).distinct()
    # Only conversations of more than one part need the running order; they are found by counts.
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("many"))
    large = materialize(sizes.where(F.col("many") > turns_per_part).select("conv_id"))
    one = F.lit(1).alias("n")
    in_one = turns.join(large, "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("part"), "loose", "turn", "role", "text", one)
    turn = F.struct("loose", "turn", "role", "text", "n")
    each = F.flatten(F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.array_repeat(t, t["n"])))
    start = F.lit(0).cast("long").alias("offset")
    rendered = in_one.groupBy("conv_id", "part").agg(each.alias("turns")).join(speakers, "conv_id").select("conv_id", "part", "turns", "perspective", start)
    single = alone.withColumn("n", one).select("conv_id", F.lit(0).cast("long").alias("part"), F.array(turn).alias("turns"), F.col("role").alias("perspective"), start)
    rendered = rendered.unionByName(single)
    mine = lambda t: F.coalesce(t["role"] == F.col("perspective"), F.lit(False))
    head = lambda t: F.concat(
        F.lit(OPEN),
        F.when(mine(t), F.lit("assistant")).when(t["role"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user"), F.coalesce(F.concat(F.lit(" name="), t["role"]), F.lit("")))),
        F.lit("\n"),
    )
    body = lambda t: F.concat(F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))
    if not large.isEmpty():
        key = ["conv_id", "part", "perspective"]
        parts = materialize(in_parts(turns.join(large, "conv_id", "left_semi"), turns_per_part).groupBy("conv_id", "part").agg(each.alias("turns"))).join(speakers, "conv_id")
        # Lengths alone, a row a part and speaker, are summed over the parts before.
        length = F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + F.length(head(t)) + F.length(body(t)))
        before = W.partitionBy("conv_id", "perspective").orderBy("part")
        lengths = materialize(parts.select(*key, length.alias("length")))
        offsets = lengths.select(*key, (F.sum("length").over(before) - F.col("length")).alias("offset"))
        rendered = rendered.unionByName(parts.join(offsets, key).select("conv_id", "part", "turns", "perspective", "offset"))
    said = F.transform("turns", lambda t: F.struct(head(t).alias("head"), body(t).alias("body"), mine(t).alias("mine")))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.when(t["mine"], F.array(F.concat(begin.cast("string"), F.lit(":"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], span).alias("spans"))

    return rendered.select("conv_id", "perspective", "part", "offset", said.alias("said")).select(
        "conv_id", "perspective", "part",
        F.size("said").cast("long").alias("n_turns"),
        F.size(F.filter("said", lambda t: t["mine"])).cast("long").alias("n_masked"),
        F.array_join(F.transform("said", lambda t: F.concat(t["head"], t["body"])), "").alias("text"),
        F.array_join(F.aggregate("said", begin, step)["spans"], ",").alias("mask"),
        "offset",
    )


def op10_chat_perspectives(spark, sf_dir):
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH ranked AS (
  SELECT conv_id, turn, role, text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, 1 AS one FROM conversations
), rows AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS rank FROM ranked
), speakers AS (
  SELECT DISTINCT conv_id, lone, role AS perspective FROM rows WHERE role <> 'system'
), said AS (
  SELECT r.conv_id, r.lone, s.perspective, (r.rank - 1) // 512 AS part, r.rank, r.text, coalesce(r.role = s.perspective, false) AS mine,
         '<|im_start|>' || CASE WHEN coalesce(r.role = s.perspective, false) THEN 'assistant' WHEN r.role = 'system' THEN 'system'
                           ELSE 'user' || coalesce(' name=' || r.role, '') END || chr(10) AS head,
         coalesce(r.text, '') || '<|im_end|>' || chr(10) AS body
  FROM rows r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.lone IS NOT DISTINCT FROM s.lone
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, lone, perspective ORDER BY rank ROWS UNBOUNDED PRECEDING) AS whole FROM said
), cut AS (
  SELECT *, min(whole - length(head) - length(body)) OVER (PARTITION BY conv_id, lone, perspective, part) AS start FROM placed
)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (mine) AS n_masked,
       string_agg(head || body, '' ORDER BY rank) AS text,
       coalesce(string_agg(CASE WHEN mine THEN CAST(CAST(whole - start - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(whole - start AS BIGINT) AS VARCHAR) END, ',' ORDER BY rank), '') AS mask,
       CAST(min(start) AS BIGINT) AS "offset"
FROM cut GROUP BY conv_id, lone, perspective, part
"""
