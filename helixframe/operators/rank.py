"""Ranks, qualities and filters of placements (read_id, mate, strand, seq_idx, r_start, r_end, q_start, q_end, sw_score, …)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores

KEY = ["read_id", "mate"]


def distinct_results(a: DataFrame) -> DataFrame:
    return a.dropDuplicates([*KEY, "strand", "seq_idx", "r_start", "r_end", "q_start", "q_end", "sw_score"])


def dense_ranks(a: DataFrame) -> DataFrame:
    return a.withColumn("sw_rank", F.dense_rank().over(Window.partitionBy(*KEY).orderBy(F.col("sw_score").desc())) - 1)


def best_and_second(ranked: DataFrame) -> DataFrame:
    """Per read best and second distinct score and how many share each; a plain aggregate over ranks."""
    at = lambda k, x: F.when(F.col("sw_rank") == k, x)
    return ranked.groupBy(*KEY).agg(F.max("sw_score").alias("best"), F.coalesce(F.max(at(1, F.col("sw_score"))), F.lit(0)).alias("second"), F.count(at(0, F.lit(1))).alias("n_best"), F.count(at(1, F.lit(1))).alias("n_second"))


def with_quality(a: DataFrame, read_length: int, cap: int = 60) -> DataFrame:
    """Quality of each read's best placement; shared best scores give 0."""
    b = best_and_second(dense_ranks(a))
    q = scores.quality(F.col("best"), F.col("second"), F.col("n_second"), F.lit(read_length), F.lit(cap))
    return b.withColumn("mapq", F.when(F.col("n_best") == 1, q).otherwise(0).cast("int"))


def filter_results(a: DataFrame, min_score: int, drop: int, min_matches: int) -> DataFrame:
    best = F.max("sw_score").over(Window.partitionBy(*KEY))
    return a.withColumns({"below_abs": (F.col("sw_score") < min_score) | (F.col("n_match") < min_matches), "below_rel": F.col("sw_score") < best - drop})


def prune_contained(a: DataFrame) -> DataFrame:
    """Without placements inside an earlier one (by start, longer first) whose score they don't beat."""
    w = Window.partitionBy(*KEY, "seq_idx", "strand").orderBy("r_start", F.col("r_end").desc(), F.col("sw_score").desc(), "q_start", "q_end").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce((F.max("r_end").over(w) >= F.col("r_end")) & (F.max("sw_score").over(w) >= F.col("sw_score")), F.lit(False))
    return a.withColumn("_in", inside).where("NOT _in").drop("_in")


def interval_union(iv: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping or adjoining closed intervals (lo, hi), merged."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    r = iv.withColumn("_new", F.coalesce(F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)))
    r = r.withColumn("_g", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*by, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")
