"""Matching quality against labelled pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..policy import AUTO_MATCH, NO_MATCH, REVIEW_DECISION

DECISIONS = [AUTO_MATCH, REVIEW_DECISION, NO_MATCH]


def check_observations(observations: DataFrame) -> DataFrame:
    """Duplicate ids and negative or missing counts, with their reason."""
    twice = observations.groupBy("id").count().where("count > 1").select("id", F.lit("DUPLICATE_CASE").alias("reason"))
    bad = observations.where("candidate_count IS NULL OR candidate_count < 0").select("id", F.lit("INVALID_CANDIDATE_COUNT").alias("reason"))
    return twice.unionByName(bad)


def confusion(observations: DataFrame) -> DataFrame:
    """Counts by true identity and decision."""
    return observations.groupBy("same_identity").pivot("decision", DECISIONS).count().fillna(0, DECISIONS)


def quality_rates(observations: DataFrame) -> DataFrame:
    """Counts and rates over all pairs; a rate without cases is null. Reviews abstain: they are no automatic match."""
    same, auto, review = F.col("same_identity"), F.col("decision") == AUTO_MATCH, F.col("decision") == REVIEW_DECISION
    counts = observations.agg(
        F.count("*").alias("evaluated_pairs"), F.count_if(same & auto).alias("tp"), F.count_if(~same & auto).alias("false_positives"),
        F.count_if(same & (F.col("decision") == NO_MATCH)).alias("false_negatives"), F.count_if(same & review).alias("deferred_positives"),
        F.count_if(same).alias("positives"), F.count_if(~same).alias("negatives"), F.count_if(review).alias("reviews"),
        F.count_if(same & (F.col("candidate_count") > 0)).alias("found"),
    )
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    rows = counts.withColumns({"auto": F.col("tp") + F.col("false_positives"), "resolved": F.col("evaluated_pairs") - F.col("reviews")})
    return rows.select(
        "evaluated_pairs", "false_positives", "false_negatives", "deferred_positives",
        rate("tp", "auto").alias("precision"), rate("tp", "positives").alias("recall"), rate("false_positives", "negatives").alias("false_positive_rate"),
        rate("reviews", "evaluated_pairs").alias("review_rate"), rate("resolved", "evaluated_pairs").alias("auto_resolution_rate"),
        rate("found", "positives").alias("positive_candidate_recall"),
    )
