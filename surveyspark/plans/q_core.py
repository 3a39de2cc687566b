"""Flagship slice: weighted and plain failure rate per region."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.operators import aggregate as A
from surveyspark.operators import clean as C
from surveyspark.plans.registry import query
from surveyspark.plans.tables import OBS_SQL, observations, supplier_region


def rate_by_region(spark, sf):
    """SRC-1 -> FLT-4 -> DRV-1/2/3 -> PRJ-14 -> AGG-10, ordered by rate."""
    obs = C.keep_range(observations(spark, sf), ["l_extendedprice"], 1000.0, 100000.0)
    reg = supplier_region(spark, sf)
    g = A.by_group(obs.join(reg, "cluster"), "region_name", "y", "p", "w")
    return g.select("region_name", "total", "alerts",
                    F.round("mean_score", 6).alias("mean_score"),
                    F.round("alert_rate", 6).alias("alert_rate"),
                    F.round("weighted_rate", 6).alias("weighted_rate"))


RATE_BY_REGION_SQL = f"""
SELECT n.n_name AS region_name, COUNT(*) AS total, CAST(SUM(o.y) AS BIGINT) AS alerts,
  ROUND(AVG(o.p), 6) AS mean_score, ROUND(AVG(CAST(o.y AS DOUBLE)), 6) AS alert_rate,
  ROUND(SUM(o.w * o.y) / SUM(o.w), 6) AS weighted_rate
FROM {OBS_SQL} o JOIN supplier s ON o.cluster = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE o.l_extendedprice BETWEEN 1000.0 AND 100000.0
GROUP BY n.n_name
"""

query("agg10_rate_by_region", RATE_BY_REGION_SQL)(rate_by_region)
