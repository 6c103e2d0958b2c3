"""Chat formatting after the collapse of cumulative snapshots.

A service that logs a conversation after every turn leaves each snapshot as a prefix of the next. Rolling hashes over the
turns name every prefix; conversations whose whole hash is a proper prefix of another are dropped by an anti-join, of equal
ones the least conv_id stays, and what is left is rendered. Texts are shuffled once, those of the conversations that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, staged


def _turns(turns: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return turns.filter("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))


def _named(rows: DataFrame) -> DataFrame:
    """Turns with two hashes of what they say."""
    return rows.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64("text", F.lit("|"), "role")})


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (1 ..), total and the hash h1, h2 of the first `place` turns, for every turn of every conversation.

    Turns are ordered by number (null first), those of one number by role and text; rows that repeat all three count once.
    The scan carries hashes only: texts are compared just where one number has several turns.
    """
    rows = _named(_turns(turns)).select("conv_id", "turn", "a", "b").repartition("conv_id").distinct()
    tied = staged(rows.groupBy("conv_id", "turn").count().filter("count > 1").select("conv_id", F.coalesce("turn", F.lit(-(1 << 63))).alias("turn")), "tied")
    rows = rows.withColumn("rank", F.lit(0))
    if not tied.isEmpty():
        # the turns of tied numbers, ordered by what they say
        said = _named(_turns(turns)).withColumn("turn", F.coalesce("turn", F.lit(-(1 << 63))))
        said = said.join(tied, ["conv_id", "turn"], "left_semi").distinct()
        ranks = said.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))).select("conv_id", "turn", "a", "b", "rank")
        rows = rows.drop("rank").withColumn("turn", F.coalesce("turn", F.lit(-(1 << 63)))).join(ranks, ["conv_id", "turn", "a", "b"], "left")
    order = Window.partitionBy("conv_id").orderBy("turn", "rank")
    rows = rows.select("conv_id", "turn", "rank", "a", "b", F.row_number().over(order).alias("place"))
    so_far = lambda c: F.bit_xor(c).over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.count("*").over(Window.partitionBy("conv_id"))
    return rows.select("conv_id", "place", total.cast("int").alias("total"), so_far(F.xxhash64("place", "a")).alias("h1"), so_far(F.xxhash64("b", "place")).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that no other prolongs, one of each set of equal ones."""
    named = staged(prefixes(turns), "prefixes")
    whole = named.filter("place = total").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    longer = named.filter("place < total").select("place", "h1", "h2").distinct()
    return whole.join(longer, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text of every maximal conversation, a row each, however long.

    Turns follow each other by number, role and text; repeated rows count once. Null roles and texts are empty; rows with a
    null conv_id belong to no conversation and are left out; rows without a turn number come first. An empty table gives no
    rows; other columns play no part. A conversation is one value of a row, so it has to fit one (2 GB).
    """
    kept = staged(maximal(turns), "maximal")
    rows = join_small(_turns(turns), kept, "conv_id")
    lines = F.array_sort(F.collect_set(F.struct("turn", "role", "text")))
    whole = rows.groupBy("conv_id").agg(F.first("n_turns").cast("long").alias("n_turns"), F.first("n_copies").alias("n_copies"), lines.alias("lines"))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: turn_text(x["role"], x["text"])), "").alias("rendered"))
