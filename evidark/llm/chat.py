"""Preference formatting; DataFrame operations only.

``preference_rows`` takes pairs of conversations, arrays of (role, text), finds the longest common prefix of whole
turns, renders it once as the prompt, and renders what follows in each as its completion, with the ranges to train on:
the text and end mark of each assistant turn, as code-point ranges "from:to" of the completion, joined by commas.

A null role is "unknown" and a null text is empty; equal turns are equal after that. A null conversation is an empty
one. When one conversation continues the other, or both are equal, the shorter completion is empty. Further columns
stay as they are; one with the name of a result's column gets ``_input`` behind its name. A conversation is one array in
one task, so it must fit there, as any record must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidark.llm.common import table, written

END = "<|end|>\n"
TRAINED = "assistant"
TURNS = "array<struct<role:string,text:string>>"


MADE = ("n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean(turns: Column) -> Column:
    made = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return F.coalesce(made, F.array().cast(TURNS))


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), t["text"], F.lit(END))), "")


def trained_ranges(turns: Column) -> Column:
    """Ranges of ``render(turns)`` that are learnt from."""

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(header(t))
        stop = start + F.length(t["text"]) + F.lit(len(END) - 1)
        said = F.concat(start.cast("string"), F.lit(":"), stop.cast("string"))
        return F.struct((stop + 1).alias("at"), F.when(t["role"] == TRAINED, F.array_append(state["ranges"], said)).otherwise(state["ranges"]).alias("ranges"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("ranges"))
    return F.aggregate(turns, start, step, lambda s: F.array_join(s["ranges"], ","))


def preference_rows(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with prompt, n_prompt_turns, and text and mask of both completions in place of the conversations."""
    kept, taken = [], {*MADE, *pairs.columns}
    for c in pairs.columns:
        if c in (chosen, rejected):
            continue
        name = c
        while name in MADE or (name != c and name in taken):
            name += "_input"
        taken.add(name)
        kept.append(quoted(c).alias(name))
    kept = F.struct(*kept) if kept else F.lit(None)
    rows = pairs.select(kept.alias("kept"), clean(quoted(chosen)).alias("c"), clean(quoted(rejected)).alias("r"))
    others = ["kept.*"] if len(pairs.columns) > len({chosen, rejected}) else []
    differ = F.array_position(F.zip_with("c", "r", lambda a, b: a.eqNullSafe(b)), False)
    n = F.when(differ > 0, differ - 1).otherwise(F.size("c")).cast("int")  # none differ: equal, and of one length
    rows = rows.withColumn("n", n)
    after = [F.slice(x, F.col("n") + 1, F.greatest(F.size(x), F.lit(1))).alias(x) for x in ("c", "r")]
    rows = rows.select("kept", "n", F.slice("c", 1, F.col("n")).alias("p"), *after)
    return rows.select(*others, F.col("n").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"), trained_ranges(F.col("c")).alias("chosen_mask"), trained_ranges(F.col("r")).alias("rejected_mask"))


def reply_pairs(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Pairs from single conversations: conv_id, chosen, rejected.

    Chosen is the conversation up to its last assistant turn (all of it, if there is none); rejected is the same with
    that turn replaced by the last assistant turn of its mate, the conversation whose id differs in the lowest bit
    (left out if there is none). Repeated rows count once; turns are ordered by turn, role and text. Rows without a
    conversation id belong to no conversation.
    """
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))  # one record: its own turns
    is_reply = F.transform("turns", lambda t: t["role"] == TRAINED)
    last = F.size("turns") + 1 - F.array_position(F.reverse(is_reply), True)
    whole = whole.select("conv_id", "turns", F.when(F.array_contains(is_reply, True), last).cast("int").alias("last"))
    whole = written(spark, whole.select("conv_id", F.when(F.col("last").isNull(), F.col("turns")).otherwise(F.slice("turns", 1, F.col("last") - 1)).alias("head"), F.when(F.col("last").isNotNull(), F.array(F.try_element_at("turns", F.col("last")))).alias("reply")), "conversations")
    mates = whole.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply").alias("other"))
    both = whole.join(mates, "conv_id", "left")
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    bare = lambda c: F.transform(F.concat("head", F.coalesce(c, none)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return both.select("conv_id", bare(F.col("reply")).alias("chosen"), bare(F.col("other")).alias("rejected"))


def op5_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_rows(reply_pairs(spark, table(spark, sf_dir, "conversations")))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM t),
l AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN n END) AS last FROM n GROUP BY conv_id),
reply AS (SELECT n.conv_id, n.text FROM n JOIN l ON n.conv_id = l.conv_id AND n.n = l.last),
pair AS (SELECT l.conv_id, l.last, own.text AS own, mate.text AS mate FROM l LEFT JOIN reply own ON own.conv_id = l.conv_id LEFT JOIN reply mate ON mate.conv_id = xor(l.conv_id, 1)),
shown AS (SELECT p.conv_id, any_value(p.own) AS own, any_value(p.mate) AS mate,
    count(n.n) FILTER (p.last IS NULL OR n.n < p.last OR (n.n = p.last AND p.own = p.mate)) AS n_prompt_turns,
    string_agg('<|' || n.role || '|>' || chr(10) || n.text || '<|end|>' || chr(10), '' ORDER BY n.n) FILTER (p.last IS NULL OR n.n < p.last OR (n.n = p.last AND p.own = p.mate)) AS prompt
  FROM pair p JOIN n USING (conv_id) GROUP BY p.conv_id),
done AS (SELECT *, CASE WHEN own = mate THEN NULL ELSE own END AS c, CASE WHEN own = mate THEN NULL ELSE mate END AS r FROM shown)
SELECT conv_id, CAST(n_prompt_turns AS INTEGER) AS n_prompt_turns, coalesce(prompt, '') AS prompt,
  coalesce('<|assistant|>' || chr(10) || c || '<|end|>' || chr(10), '') AS chosen,
  coalesce('<|assistant|>' || chr(10) || r || '<|end|>' || chr(10), '') AS rejected,
  coalesce('14:' || CAST(14 + length(c) + 7 AS VARCHAR), '') AS chosen_mask,
  coalesce('14:' || CAST(14 + length(r) + 7 AS VARCHAR), '') AS rejected_mask
FROM done
"""
