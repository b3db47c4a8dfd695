"""Effectiveness report over the recall log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recall_lines(log: DataFrame, tenant: str | None = None) -> DataFrame:
    """Recall events, optionally of one tenant; malformed lines have no event and drop out."""
    rows = log.where(F.col("event") == "recall")
    return rows.where(F.col("tenant") == tenant) if tenant else rows


def order_statistics(lines: DataFrame, column: str, places: dict[str, Column]) -> DataFrame:
    """One row (n, names...): the values at given places of the sorted non-null values, null where there is none.

    ``places`` maps names to 0-based indices as expressions over ``n``, the number of values. Equal values are counted
    before they are shuffled, then sorted in ranges over the cluster; a range's place comes from the counts of the
    ranges before it, one row a range. No task has all values.
    """
    vals = lines.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    parts = vals.groupBy("v").agg(F.count(F.lit(1)).alias("c")).repartitionByRange("v").select("v", "c", F.spark_partition_id().alias("p"))
    sums = parts.groupBy("p").agg(F.sum("c").alias("s"))
    until = F.sum("s").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, W.currentRow))
    before = sums.withColumn("before", until - F.col("s")).drop("s")  # one row a range
    total = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n"))
    within = F.sum("c").over(W.partitionBy("p").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = parts.withColumn("end", within).join(F.broadcast(before), "p").join(F.broadcast(total), how="cross").withColumn("end", F.col("before") + F.col("end"))
    at = lambda i: (F.col("end") > i) & (F.col("end") - F.col("c") <= i)
    hit = placed.agg(*[F.max(F.when(at(i), F.col("v"))).alias(name) for name, i in places.items()])
    return total.join(hit, how="cross")  # one row each


def overall(lines: DataFrame) -> DataFrame:
    """One row (recalls, empty_rate, latency_p50_ms, latency_p95_ms, avg_top_score).

    The median is the mean of the middle two; the 95th percentile is the value at index int(0.95 n) of
    the sorted latencies, null for two or fewer. Rates are rounded to 3, latencies to 1, scores to 5 digits.
    """
    one = lines.agg(
        F.count(F.lit(1)).alias("recalls"),
        F.round(F.try_divide(F.count_if(F.coalesce("empty", F.lit(False))), F.count(F.lit(1))), 3).alias("empty_rate"),
        F.round(F.avg("top_score"), 5).alias("avg_top_score"),
    )
    n = F.col("n")
    at = order_statistics(lines, "latency_ms", {"lower": F.floor((n - 1) / 2), "upper": F.floor(n / 2), "high": F.floor(n * F.lit(0.95))})
    at = at.select(F.round((F.col("lower") + F.col("upper")) / 2, 1).alias("latency_p50_ms"), F.round(F.when(n > 2, F.col("high")), 1).alias("latency_p95_ms"))
    return one.join(at, how="cross").select("recalls", "empty_rate", "latency_p50_ms", "latency_p95_ms", "avg_top_score")  # one row each


def by_tenant(lines: DataFrame) -> DataFrame:
    """(tenant, n): recalls of each tenant, ``?`` for lines without one."""
    return lines.groupBy(F.coalesce("tenant", F.lit("?")).alias("tenant")).agg(F.count(F.lit(1)).alias("n"))


def recent_misses(lines: DataFrame, n: int = 8) -> DataFrame:
    """The last n empty recalls in log order: (line_no, query), the query cut to 70 characters."""
    return lines.where("empty").orderBy(F.desc("line_no")).limit(n).select("line_no", F.substring("query", 1, 70).alias("query")).orderBy("line_no")


def busiest_tenants(lines: DataFrame, n: int | None = None) -> DataFrame:
    """(tenant, n): tenants by falling number of recalls, equal ones by name; the first ``n`` of them if given."""
    rows = by_tenant(lines).orderBy(F.desc("n"), F.asc("tenant"))
    return rows if n is None else rows.limit(n)
