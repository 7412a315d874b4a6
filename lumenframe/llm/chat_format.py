"""Preference pairs: the common turns of a chosen and a rejected conversation once, and what differs as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): a conversation's turns in order, each with role and text.

    Null roles and texts are empty; a null turn number comes first, and ties are in order of role and text. Rows
    without conv_id belong to no conversation. Other columns are ignored.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return held.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def rendered(turns: Column) -> Column:
    """Turns as text: a line with the role between marks, the text, and a line end."""
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n"))), "")


def masked(turns: Column) -> Column:
    """The parts of rendered(turns) that count for a loss: [start, end) of each assistant turn's text, in characters."""

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["role"]) + 5
        end = start + F.length(x["text"])
        return F.struct((end + 1).alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, empty, add, lambda a: a["spans"])


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """Rows of (chosen, rejected), arrays of turns, with n_common, prompt, two completions and the two loss masks.

    The prompt is the longest common prefix of whole turns (role and text equal), rendered once. Equal conversations
    have empty completions; null conversations are empty ones, and null roles and texts (and turns) have empty ones. Other
    columns stay as they are; those named like the results are an error. An empty table gives no rows.
    """
    if clash := {"n_common", "prompt", "chosen_completion", "rejected_completion", "chosen_mask", "rejected_mask"} & set(pairs.columns):
        raise ValueError(f"the table already has {sorted(clash)}")
    none = F.array().cast("array<struct<role:string,text:string>>")
    plain = lambda c: F.transform(F.coalesce(c, none), lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))
    d = pairs.withColumn("chosen", plain("chosen")).withColumn("rejected", plain("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    d = d.withColumn("n_common", F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    d = d.withColumn("prompt", rendered(F.slice("chosen", F.lit(1), F.col("n_common")))).withColumn("__a", rest("chosen")).withColumn("__b", rest("rejected"))
    d = d.withColumn("chosen_completion", rendered(F.col("__a"))).withColumn("rejected_completion", rendered(F.col("__b")))
    d = d.withColumn("chosen_mask", masked(F.col("__a"))).withColumn("rejected_mask", masked(F.col("__b")))
    return d.drop("chosen", "rejected", "__a", "__b")


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as preference pairs; one without its partner is paired with none."""
    c = conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumn("pair_id", F.shiftright(F.col("conv_id").cast("long"), 1))
    pick = lambda k: F.max(F.when(F.pmod("conv_id", F.lit(2)) == k, F.struct("conv_id", "turns")))
    pairs = c.groupBy("pair_id").agg(pick(0).alias("a"), pick(1).alias("b"))
    out = preference_pairs(pairs.select("pair_id", F.col("a.conv_id").alias("chosen_id"), F.col("b.conv_id").alias("rejected_id"), F.col("a.turns").alias("chosen"), F.col("b.turns").alias("rejected")))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("pair_id", "chosen_id", "rejected_id", "n_common", "prompt", "chosen_completion", "rejected_completion", text("chosen_mask").alias("chosen_mask"), text("rejected_mask").alias("rejected_mask"))


_TURNS = "list_transform({0}, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || chr(10))"
OP7_SQL = f"""
WITH c AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (
  SELECT (coalesce(a.conv_id, b.conv_id) - (coalesce(a.conv_id, b.conv_id) & 1)) // 2 AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, coalesce(a.t, []) AS a, coalesce(b.t, []) AS b
  FROM (SELECT * FROM c WHERE conv_id & 1 = 0) a FULL JOIN (SELECT * FROM c WHERE conv_id & 1 = 1) b ON a.conv_id + 1 = b.conv_id),
n AS (
  SELECT *, coalesce((SELECT min(i) - 1 FROM range(1, greatest(len(a), len(b)) + 1) r(i) WHERE a[i] IS DISTINCT FROM b[i]), len(a)) AS k FROM p),
s AS (SELECT *, a[k + 1:] AS ra, b[k + 1:] AS rb FROM n),
m AS (
  SELECT *,
    list_transform(range(1, len(ra) + 1), lambda i: coalesce(list_sum(list_transform(ra[:i - 1], lambda x: len(x.role) + len(x.text) + 6)), 0) + len(ra[i].role) + 5) AS sa,
    list_transform(range(1, len(rb) + 1), lambda i: coalesce(list_sum(list_transform(rb[:i - 1], lambda x: len(x.role) + len(x.text) + 6)), 0) + len(rb[i].role) + 5) AS sb
  FROM s)
SELECT pair_id, chosen_id, rejected_id, CAST(k AS INTEGER) AS n_common,
  coalesce(array_to_string({_TURNS.format("a[:k]")}, ''), '') AS prompt,
  coalesce(array_to_string({_TURNS.format("ra")}, ''), '') AS chosen_completion,
  coalesce(array_to_string({_TURNS.format("rb")}, ''), '') AS rejected_completion,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(ra) + 1), lambda i: ra[i].role = 'assistant'), lambda i: CAST(sa[i] AS BIGINT) || '-' || CAST(sa[i] + len(ra[i].text) AS BIGINT)), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(rb) + 1), lambda i: rb[i].role = 'assistant'), lambda i: CAST(sb[i] AS BIGINT) || '-' || CAST(sb[i] + len(rb[i].text) AS BIGINT)), ','), '') AS rejected_mask
FROM m
"""
