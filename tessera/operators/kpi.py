"""Segment table, headline figures, scatter frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def risk_level(churned_share: Column) -> Column:
    return (
        F.when(churned_share < F.lit(1) / 3, "low").when(churned_share < F.lit(2) / 3, "medium").otherwise(F.lit("high"))
    )


def segment_table(customers: DataFrame, segment: str, value: str, churned: str) -> DataFrame:
    """segment, customers, avg_ltv, churn_risk from one row per customer."""
    return customers.groupBy(segment).agg(
        F.count("*").alias("customers"),
        F.avg(value).alias("avg_ltv"),
        risk_level(F.avg(F.col(churned).cast("double"))).alias("churn_risk"),
    )


def segment_kpis(segments: DataFrame) -> DataFrame:
    """One row: customers, segments, mean of the segment averages, customers in high-risk segments."""
    return segments.agg(
        F.sum("customers").alias("total_customers"),
        F.count("*").alias("active_segments"),
        F.avg("avg_ltv").alias("avg_ltv"),
        F.sum(F.when(F.col("churn_risk") == "high", F.col("customers")).otherwise(F.lit(0))).alias("high_risk_customers"),
    )


def scatter_frame(labels: DataFrame, row_id: str, x: str, y: str, cluster: str) -> DataFrame:
    """id, x, y, cluster: two measures of every customer, by cluster."""
    return labels.select(
        F.col(row_id).alias("id"),
        F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
        F.col(cluster).alias("cluster"),
    )
