"""Chat formatting with cumulative-snapshot collapse.

Method: logs often hold one conversation several times, each snapshot a turn longer. Every
turn is hashed with its position; the running XOR of a conversation's turn hashes is the
rolling hash of each of its prefixes (two independent 64-bit hashes, with the length).
A conversation whose whole-length hash is a proper prefix hash of another is dropped by
an anti-join; of equal conversations the smallest conv_id stays, by another. What is left
is maximal and is rendered.

Defined cases: turns are ordered by turn (null first), then role and text, so ties and
repeated rows have one order; a null role or text counts as empty; rows with a null
conv_id are left out; an empty table gives an empty result; other columns are ignored.

Scale: the window that numbers and hashes turns is the size of one conversation and
spills. Only distinct prefix hashes take part in the anti-join, so a first turn that a
third of all conversations share is one row there. Texts are shuffled once, for the
conversations that stay, and rendering needs one conversation at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with nth, and h1, h2 of the prefix that ends there."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    rows = rows.withColumn("nth", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    for i in (1, 2):
        rows = rows.withColumn(f"h{i}", F.bit_xor(F.xxhash64(F.lit(i), "nth", "role", F.char_length("role"), "text")).over(upto))
    return rows


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no other extends."""
    rows = common.materialise(prefixes(turns).select("conv_id", "nth", "h1", "h2"), "prefixes")
    whole = rows.groupBy("conv_id").agg(F.max(F.struct("nth", "h1", "h2")).alias("w")).select("conv_id", "w.*")
    proper = rows.join(whole.select("conv_id", F.col("nth").alias("n")), "conv_id").where("nth < n").select("nth", "h1", "h2").distinct()
    first = whole.groupBy("nth", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    return first.join(proper, ["nth", "h1", "h2"], "left_anti").select("conv_id", F.col("nth").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations."""
    keep = common.materialise(maximal(turns), "maximal")
    rows = turns.select("conv_id", F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).join(keep.select("conv_id"), "conv_id", "left_semi")
    texts = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    # array_sort puts a null turn last inside structs of equal rank only; order it first as the window does.
    ordered = F.concat(F.filter("t", lambda x: x["turn"].isNull()), F.filter("t", lambda x: x["turn"].isNotNull()))
    said = F.transform(ordered, lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END + "\n")))
    return keep.join(texts.select("conv_id", F.array_join(said, "").alias("rendered")), "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")


def op2_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations of the log, rendered."""
    return render(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, nth,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY nth) AS prefix
  FROM t),
w AS (SELECT conv_id, max(nth) AS n, arg_max(prefix, nth) AS rendered FROM p GROUP BY conv_id),
proper AS (SELECT DISTINCT p.nth, md5(p.prefix) AS h FROM p JOIN w USING (conv_id) WHERE p.nth < w.n)
SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, rendered
FROM w WHERE NOT EXISTS (SELECT 1 FROM proper WHERE proper.nth = w.n AND proper.h = md5(w.rendered))
GROUP BY n, rendered
"""
