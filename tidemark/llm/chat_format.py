"""Chat formatting: logged conversations that prefix longer ones collapse into the longest.

Turns are put in order and each prefix gets a rolling hash: hash of the previous prefix's hash and
the turn.  A conversation whose whole hash is a proper prefix of another is a snapshot of it; an
anti-join on (length, hash) leaves the maximal ones.  Of equal conversations the smallest conv_id
stays.  Those that stay are rendered in a chat markup.

Exactly repeated rows count once; turns of one number are ordered by role and text, null turns come
first.  Null roles and texts are empty.  Rows without a conv_id belong to no conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import apart


def logged(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: its turns in order."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text"))).alias("turns"))


def hashed(conversations: DataFrame) -> DataFrame:
    """conv_id, number of turns, and the hashes of all prefixes."""
    turn = F.transform("turns", lambda t: F.sha2(F.concat_ws("\n", F.length(t["role"]).cast("string"), t["role"], t["text"]), 256))
    d = apart(logged(conversations), own=turn)
    rolling = F.aggregate("own", F.array().cast("array<string>"), lambda done, h: F.concat(done, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")), h), 256))))
    d = apart(d.select("conv_id", "turns", "own"), prefixes=rolling)
    return d.select("conv_id", "turns", F.size("turns").alias("n_turns"), "prefixes", F.element_at("prefixes", -1).alias("whole"))


def render(turns: str = "turns"):
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_collapsed (equal conversations beside it) and the rendered text of each maximal conversation."""
    h = hashed(conversations)
    prefixes = h.where("n_turns > 1").select(F.posexplode(F.slice("prefixes", F.lit(1), F.col("n_turns") - 1))).select((F.col("pos") + 1).alias("n_turns"), F.col("col").alias("whole")).distinct()
    kept = h.groupBy("n_turns", "whole").agg(F.min("conv_id").alias("conv_id"), (F.count(F.lit(1)) - 1).alias("n_collapsed")).join(prefixes, ["n_turns", "whole"], "left_anti")
    return logged(conversations).join(kept, "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_collapsed", render().alias("rendered"))
