"""L1: the tier of a turn is a function of its reverse rank, so tiers are one window over a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memoquarry.functions import text as T


def tiers(turns: DataFrame, k: int, m: int) -> DataFrame:
    """``turns`` with r (1 = newest), tier, and the turn whose arrival pushed it out (null if still held)."""
    session = Window.partitionBy("conv_id")
    r = F.row_number().over(session.orderBy(F.desc("turn")))
    tier = F.when(F.col("r") <= k, "window").when(F.col("r") <= k + m, "segment").otherwise("overflow")
    return turns.withColumn("r", r).withColumn("tier", tier).withColumn("overflowed_at", F.lead("turn", k + m).over(session.orderBy("turn")))


def recent(turns: DataFrame, n: int) -> DataFrame:
    return turns.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("r") <= n)


def budget_context(rows: DataFrame, budget: int) -> DataFrame:
    """Segments, then window turns, oldest first; each tier stops at its first item over the budget."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    held = rows.filter("tier <> 'overflow'")
    of = lambda tier: F.coalesce(F.sum(F.when(F.col("tier") == tier, F.col("tokens"))).over(order), F.lit(0))
    held = held.withColumn("used", of("segment"))
    spent = F.coalesce(F.max(F.when((F.col("tier") == "segment") & (F.col("used") <= budget), F.col("used"))).over(Window.partitionBy("conv_id")), F.lit(0))
    held = held.withColumn("used", F.when(F.col("tier") == "segment", F.col("used")).otherwise(spent + of("window")))
    return held.filter(F.col("used") <= budget)


def merge_segments(turns: DataFrame) -> DataFrame:
    """One segment of the turns (turn, tokens, entities, tags) of each session: range, count, tokens up to 200, entities and tags once."""
    names = F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list("entities")), F.flatten(F.collect_list("tags")))))
    return turns.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n_turns"), F.least(F.sum("tokens"), F.lit(200)).alias("tokens"), F.array_join(names, ",").alias("entities"))


def recall(rows: DataFrame) -> DataFrame:
    """Relevance of each older held turn to the newest one of its session, weighted by tier; over 0.05 before that.  ``rows``: tiers of turns."""
    rows = rows.withColumn("low", F.lower("text")).withColumn("t", T.tokenize(F.col("low")))
    rows = rows.select("conv_id", "turn", "r", "tier", "low", F.array_distinct("t").alias("tokens"), F.array_distinct(T.ngrams(F.col("low"), F.col("t"))).alias("grams"))
    asked = rows.filter("r = 1").select("conv_id", F.col("low").alias("q"), F.col("tokens").alias("qt"), F.col("grams").alias("qg"))
    raw = T.relevance(F.col("q"), F.col("low"), F.col("qg"), F.col("grams"), F.col("qt"), F.col("tokens"))
    found = rows.filter("r > 1 and tier <> 'overflow'").join(asked, "conv_id").withColumn("raw", raw).filter("raw > 0.05")
    return found.select("conv_id", "turn", (F.col("raw") * F.when(F.col("tier") == "window", 0.8).otherwise(0.6)).alias("score"))
