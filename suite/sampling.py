"""Sampling, index and top-k queries (T, W rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.operators import sampling as s
from rowmill.operators.index import global_index
from rowmill.operators.joins import first_per_key
from rowmill.plans.sample_report import sample_with_analysis
from suite.registry import query, table

_META = ["_sample_index", "_sample_strategy"]


@query("global_index", """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index FROM orders""")
def index_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return global_index(orders, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_index")


@query("sample_random", """SELECT event_id, value, 'random' AS _sample_strategy,
row_number() OVER (ORDER BY md5('42:' || event_id), event_id) - 1 AS _sample_index FROM events QUALIFY _sample_index < 500""")
def sample_random(spark, sf_dir):
    return s.sample(table(spark, sf_dir, "events"), 500, "event_id", "no_such_strategy").select("event_id", "value", *_META)


@query("sample_with_replacement", """
WITH n AS (SELECT count(*) AS n FROM customer), d AS (SELECT i AS _sample_index,
  CAST('0x' || substr(md5('42:' || i), 1, 15) AS BIGINT) % n AS pos FROM range(400) t(i), n),
c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT c_custkey, _sample_index, 'random' AS _sample_strategy FROM d JOIN c ON d.pos = c.pos WHERE (SELECT n FROM n) > 400
UNION ALL SELECT c_custkey, pos, 'random' FROM c WHERE (SELECT n FROM n) <= 400""")
def sample_with_replacement(spark, sf_dir):
    out = s.sample(table(spark, sf_dir, "customer"), 400, "c_custkey", allow_duplicates=True)
    return out.select("c_custkey", *_META)


@query("sample_stratified", """
WITH e AS (SELECT *, nullif(event_type, 'error') AS kind FROM events),
q AS (SELECT kind, least(count(*), greatest(1, round_even(303 * (count(*) / (SELECT count(*) FROM e)), 0))) AS quota
      FROM e GROUP BY kind),
r AS (SELECT event_id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || event_id), event_id) AS k FROM e)
SELECT r.event_id, r.kind, 'stratified' AS _sample_strategy,
       row_number() OVER (ORDER BY r.kind NULLS FIRST, md5('42:' || event_id), event_id) - 1 AS _sample_index
FROM r JOIN q ON r.kind IS NOT DISTINCT FROM q.kind WHERE k <= quota""")
def sample_stratified(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("kind", F.expr("nullif(event_type, 'error')"))
    return s.sample(events, 303, "event_id", "stratified", stratify_by="kind").select("event_id", "kind", *_META)


@query("sample_systematic", """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id, i // (n // 130) AS _sample_index, 'systematic' AS _sample_strategy FROM d
WHERE i % (n // 130) = 0 AND i // (n // 130) < 130""")
def sample_systematic(spark, sf_dir):
    return s.sample(table(spark, sf_dir, "documents"), 130, "doc_id", "systematic").select("doc_id", *_META)


@query("sample_time_based", """
WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN ts END AS t FROM events),
r AS (SELECT event_id, row_number() OVER (ORDER BY t NULLS FIRST, event_id) - 1 AS i FROM e),
w AS (SELECT k AS _sample_index, CAST(floor(k * (CAST((SELECT count(*) FROM e) AS DOUBLE) / 700)) AS BIGINT) AS i FROM range(700) x(k))
SELECT event_id, _sample_index, 'time_based' AS _sample_strategy FROM r JOIN w ON r.i = w.i""")
def sample_time_based(spark, sf_dir):
    stamp = F.when(F.col("event_type") == "error", "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    events = table(spark, sf_dir, "events").withColumn("stamp", stamp)
    return s.sample(events, 700, "event_id", "time_based", timestamp_field="stamp").select("event_id", *_META)


@query("sample_cluster", """
WITH o AS (SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS b,
                  md5('42:' || o_orderkey) AS h FROM orders),
q AS (SELECT b, greatest(1, floor(1003 * (count(*) / (SELECT count(*) FROM o)))) AS quota FROM o GROUP BY b),
r AS (SELECT o_orderkey, b, h, row_number() OVER (PARTITION BY b ORDER BY h, o_orderkey) AS k FROM o),
n AS (SELECT o_orderkey, row_number() OVER (ORDER BY r.b, h, o_orderkey) - 1 AS _sample_index FROM r JOIN q ON r.b = q.b WHERE k <= quota)
SELECT o_orderkey, _sample_index, 'cluster' AS _sample_strategy FROM n WHERE _sample_index < 1003""")
def sample_cluster(spark, sf_dir):
    return s.sample(table(spark, sf_dir, "orders"), 1003, "o_orderkey", "cluster").select("o_orderkey", *_META)


@query("sample_custom", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS _sample_index,
'custom' AS _sample_strategy FROM orders WHERE o_totalprice > 400000 QUALIFY _sample_index < 250""")
def sample_custom(spark, sf_dir):
    out = s.sample(table(spark, sf_dir, "orders"), 250, "o_orderkey", "custom", predicate="o_totalprice > 400000")
    return out.select("o_orderkey", *_META)


@query("sample_fraction", """SELECT o_orderkey FROM (
SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) AS k FROM orders)
WHERE k <= (SELECT ceil(0.035 * count(*)) FROM orders)""")
def sample_fraction(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return s.sample(orders, s.fraction_size(orders.count(), 0.035), "o_orderkey", seed=7).select("o_orderkey")


@query("sample_confidence", """SELECT o_orderkey FROM (
SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS k FROM orders)
WHERE k <= (SELECT ceil(2401.0 / (1 + 2400.0 / count(*))) FROM orders)""")
def sample_confidence(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return s.sample(orders, s.confidence_size(orders.count(), 0.02), "o_orderkey").select("o_orderkey")


@query("topk_head", """SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents)
WHERE k = 1 ORDER BY doc_id LIMIT 10""")
def topk_head(spark, sf_dir):
    return s.head(first_per_key(table(spark, sf_dir, "documents"), "text", "doc_id"), "doc_id").select("doc_id", "source")


_SAMPLE = """s AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
  ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 2000)"""


@query("sample_with_analysis", f"""WITH {_SAMPLE}
SELECT 'o_orderkey' AS name, 'integer' AS type, count(DISTINCT o_orderkey) = count(*) AS "unique",
  CAST(count(DISTINCT o_orderkey) AS BIGINT) AS cardinality FROM s
UNION ALL SELECT 'o_orderstatus', 'string', count(DISTINCT o_orderstatus) = count(*), count(DISTINCT o_orderstatus) FROM s
UNION ALL SELECT 'o_totalprice', 'float', count(DISTINCT o_totalprice) = count(*), count(DISTINCT o_totalprice) FROM s""")
def sample_analysis(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sample_with_analysis(orders, 2000, "o_orderkey").fields.select("name", "type", "unique", "cardinality")


@query("sample_noise_report", f"""WITH {_SAMPLE}, z AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d FROM s),
l AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM s) WHERE k > 1
  UNION ALL SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_totalprice ORDER BY o_orderkey) AS k FROM s) WHERE k > 1
  UNION ALL SELECT o_orderkey FROM s, z WHERE abs((o_totalprice - m) / d) > 3)
SELECT (SELECT count(*) FROM s) AS total_records, (SELECT count(*) FROM l) AS label_count,
  (SELECT count(DISTINCT o_orderkey) FROM l) AS noisy_records,
  round((SELECT count(*) FROM l) / (SELECT count(*) FROM s), 6) AS label_rate""")
def sample_noise(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    report = sample_with_analysis(orders, 2000, "o_orderkey", detect_noise=True).noise
    return report.select("total_records", "label_count", "noisy_records", F.round("label_rate", 6).alias("label_rate"))
