"""Preference formatting (operator 6, DataFrame functions only).

A chosen and a rejected conversation are arrays of (role, text) turns. Their longest common
prefix of turns is rendered once as the prompt, and what follows it on either side is a
completion with its loss mask: the code point spans, relative to the completion, of the
assistants' texts and their end marks. Headers and other roles' turns carry no loss.

Defined cases: a null conversation counts as one without turns; null roles and texts equal
only nulls and render as empty; equal conversations have empty completions; turns are
ordered by turn (nulls first), role and text, so repeated rows are repeated turns; a
conversation without an assistant's turn gives no pair in ``last_reply_pairs``; an empty
table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "<|end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def loss_spans(turns: Column) -> Column:
    """'start:end,...' of what is trained on in render(turns)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        begin = acc["at"] + F.length(_header(turn))
        end = begin + F.length(_body(turn))
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["spans"]), ",")


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in both."""
    n = F.least(F.size(a), F.size(b))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: ~(F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"])))
    return F.coalesce(F.array_min(differ), n)


_RESULTS = ("n_common", "prompt", "chosen_text", "chosen_spans", "rejected_text", "rejected_spans")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with prompt, n_common, chosen_text, chosen_spans, rejected_text and rejected_spans."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    turns = lambda c: F.coalesce(F.transform(F.col(f"`{c}`"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), none)
    taken, own = {c.lower() for c in (*pairs.columns, *_RESULTS)}, []
    for c in pairs.columns:
        name = c
        if c.lower() in _RESULTS:
            while name.lower() in taken:
                name += "_in"
            taken.add(name.lower())
        own.append(F.col(f"`{c}`").alias(name))
    # own columns travel in a struct, so that none meets a working column's name
    p = pairs.select(F.struct(*own).alias("own"), turns(chosen).alias("a"), turns(rejected).alias("b")).withColumn("n_common", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(F.col(c), F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    p = p.select("own", "n_common", render(F.slice(F.col("a"), F.lit(1), F.col("n_common"))).alias("prompt"), rest("a").alias("a"), rest("b").alias("b"))
    p = p.withColumns({"chosen_text": render(F.col("a")), "chosen_spans": loss_spans(F.col("a")), "rejected_text": render(F.col("b")), "rejected_spans": loss_spans(F.col("b"))})
    return p.select("own.*", *_RESULTS)


def last_reply_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) from (conv_id, turn, role, text).

    Chosen is the conversation up to its last reply; rejected has in that place the reply
    before it (a stale answer), or an empty one where there is none. The table holds no
    judged pairs, so the worse answer comes from the conversation itself.
    """
    key = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    conv = turns.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(key)).alias("t"))
    places = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.coalesce(F.get(F.col("t"), i - 1)["role"] == "assistant", F.lit(False)))
    conv = conv.withColumn("r", places).filter(F.size("r") > 0).withColumn("last", F.element_at("r", -1))
    pick = F.transform(F.slice("t", F.lit(1), F.col("last")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    conv = conv.withColumn("chosen", pick)
    stale = F.coalesce(F.get(F.col("t"), F.get(F.col("r"), F.size("r") - 2) - 1)["text"], F.lit(""))
    worse = F.concat(F.slice(F.col("chosen"), F.lit(1), F.col("last") - 1), F.array(F.struct(F.lit("assistant").alias("role"), stale.alias("text"))))
    return conv.withColumn("rejected", worse).select("conv_id", "chosen", "rejected")


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = format_preferences(last_reply_pairs(turns))
    return out.select("conv_id", "n_common", "prompt", "chosen_text", "chosen_spans", "rejected_text", "rejected_spans")


OP6_SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT conv_id, i, text, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM t WHERE role = 'assistant'),
c AS (SELECT conv_id, max(CASE WHEN k = 1 THEN i END) AS last, coalesce(max(CASE WHEN k = 2 THEN text END), '') AS stale, max(CASE WHEN k = 1 THEN text END) AS reply FROM r GROUP BY conv_id),
s AS (SELECT *, reply IS NOT DISTINCT FROM stale AS same FROM c),
p AS (SELECT t.conv_id, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY i) AS prompt
  FROM t JOIN s ON t.conv_id = s.conv_id AND t.i < s.last + CASE WHEN same THEN 1 ELSE 0 END GROUP BY t.conv_id)
SELECT s.conv_id, (last - CASE WHEN same THEN 0 ELSE 1 END)::INTEGER AS n_common, coalesce(prompt, '') AS prompt,
  CASE WHEN same THEN '' ELSE '<|assistant|>' || chr(10) || coalesce(reply, '') || '<|end|>' || chr(10) END AS chosen_text,
  CASE WHEN same THEN '' ELSE '14:' || (14 + length(coalesce(reply, '')) + 8) END AS chosen_spans,
  CASE WHEN same THEN '' ELSE '<|assistant|>' || chr(10) || stale || '<|end|>' || chr(10) END AS rejected_text,
  CASE WHEN same THEN '' ELSE '14:' || (14 + length(stale) + 8) END AS rejected_spans
FROM s LEFT JOIN p ON s.conv_id = p.conv_id"""
