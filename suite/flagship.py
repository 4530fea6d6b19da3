"""The configured run: enrich, filter, validate and aggregate lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmill.plans.value_add import run
from suite.registry import query, table

CONFIG = {
    "enrichment": [
        {"type": "calculate", "target": "revenue", "expression": "l_extendedprice * (1 - l_discount)"},
        {"type": "category_map", "target": "size_class", "source": "l_quantity",
         "ranges": [[0, 10], [11, 25], [26, 40]], "labels": ["small", "medium", "large"]},
        {"type": "conditional", "target": "late_flag", "condition": "l_shipdate >= date '2000-01-01'",
         "true_value": "late", "false_value": "early"},
    ],
    "transformation": [{"type": "filter", "condition": "l_quantity > 5"}],
    "validation": [
        {"type": "required", "field": "l_returnflag"},
        {"type": "range", "field": "l_discount", "min": 0, "max": 0.08},
        {"type": "range", "field": "l_extendedprice", "min": 1000},
    ],
    "aggregation": {
        "group_by": ["l_returnflag", "l_linestatus", "size_class", "late_flag"],
        "aggregations": {"sum_revenue": "sum,revenue", "n": "count", "avg_qty": "mean,l_quantity",
                         "median_price": "median,l_extendedprice"},
    },
}

_ENRICHED = """
  SELECT *, l_extendedprice * (1 - l_discount) AS revenue,
         CASE WHEN l_quantity BETWEEN 0 AND 10 THEN 'small' WHEN l_quantity BETWEEN 11 AND 25 THEN 'medium'
              WHEN l_quantity BETWEEN 26 AND 40 THEN 'large' WHEN l_quantity >= 40 THEN 'large' END AS size_class,
         CASE WHEN l_shipdate >= DATE '2000-01-01' THEN 'late' ELSE 'early' END AS late_flag
  FROM lineitem WHERE l_quantity > 5
"""


@query("config_run", f"""
WITH e AS ({_ENRICHED})
SELECT l_returnflag, l_linestatus, size_class, late_flag, round(sum(revenue), 4) AS sum_revenue,
       CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 4) AS avg_qty,
       round(median(l_extendedprice), 4) AS median_price
FROM e GROUP BY ALL""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = run(table(spark, sf_dir, "lineitem"), CONFIG).records
    return result.withColumns({"sum_revenue": F.round("sum_revenue", 4), "avg_qty": F.round("avg_qty", 4),
                               "median_price": F.round("median_price", 4)})


@query("config_run_errors", f"""
WITH e AS ({_ENRICHED}),
v AS (SELECT 'l_discount' AS field, 'l_discount above maximum: 0.08' AS message FROM e WHERE l_discount > 0.08
      UNION ALL SELECT 'l_extendedprice', 'l_extendedprice below minimum: 1000' FROM e WHERE l_extendedprice < 1000)
SELECT field, message, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY ALL""")
def config_run_errors(spark, sf_dir):
    errors = run(table(spark, sf_dir, "lineitem"), CONFIG).errors
    return errors.groupBy("field", "message").agg(F.count(F.lit(1)).alias("n"))
