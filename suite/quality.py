"""Profile, classification and noise queries (C, N rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowmill.functions.text import PATTERNS
from rowmill.operators import classify, noise, profile
from suite.registry import query, table

# ---- profiles -------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.expr("nullif(event_type, 'error')").alias("kind"), "value")


_E = "e AS (SELECT event_id, user_id, nullif(event_type, 'error') AS kind, value FROM events)"
_FIELDS = [("event_id", "integer"), ("user_id", "integer"), ("kind", "string"), ("value", "float")]


def _per_field(template: str, fields=_FIELDS) -> str:
    return " UNION ALL ".join(template.format(f=f, t=t) for f, t in fields)


@query("profile_fields", f"WITH {_E} " + _per_field("""
SELECT '{f}' AS name, '{t}' AS type, count({f}) < count(*) AS nullable, count(DISTINCT {f}) = count({f}) AS "unique",
  CAST(count(DISTINCT {f}) AS BIGINT) AS cardinality, round(count(DISTINCT {f}) / count({f}), 6) AS cardinality_ratio FROM e"""))
def profile_fields(spark, sf_dir):
    out = profile.field_profiles(_events(spark, sf_dir))
    return out.select("name", "type", "nullable", "unique", "cardinality", F.round("cardinality_ratio", 6).alias("cardinality_ratio"))


@query("profile_statistics", """SELECT count(*) AS total_records, CAST(4 AS BIGINT) AS total_fields,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS duplicate_records FROM documents""")
def profile_statistics(spark, sf_dir):
    return profile.dataset_statistics(table(spark, sf_dir, "documents").drop("doc_id"))


@query("profile_missing", f"WITH {_E} SELECT 'kind' AS name, count(*) AS missing FROM e WHERE kind IS NULL HAVING count(*) > 0")
def profile_missing(spark, sf_dir):
    return profile.missing_values(_events(spark, sf_dir))


def _texts(spark, sf_dir):
    """Text forms of the orders: booleans, integers, decimals, times, dates, mixed text."""
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "0").otherwise("").alias("flag"),
        F.concat(F.lit(" +"), F.col("o_custkey").cast("string")).alias("whole"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string"))
        .otherwise(F.format_string("%.2fe1", "o_totalprice")).alias("decimal"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("euro_day"),
        F.date_format("o_orderdate", "HH:mm").alias("clock"),
        F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(F.col("o_orderkey").cast("string")).alias("mixed"),
        F.lit(None).cast("string").alias("nothing"))


_T = """t AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN '0' ELSE '' END AS flag, ' +' || o_custkey AS whole,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) ELSE printf('%.2fe1', o_totalprice) END AS decimal,
  strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%d/%m/%Y') AS euro_day, strftime(o_orderdate, '%H:%M') AS clock,
  CASE WHEN o_orderstatus = 'F' THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) END AS mixed, CAST(NULL AS VARCHAR) AS nothing FROM orders)"""
_JUDGE = """SELECT '{f}' AS name, CASE WHEN count(nullif({f}, '')) = 0 THEN 'null'
  WHEN bool_and(lower({f}) IN ('true', 'false', 'yes', 'no', '1', '0')) FILTER ({f} <> '') THEN 'boolean'
  WHEN bool_and(regexp_full_match({f}, '\\s*[+-]?[0-9]+\\s*')) FILTER ({f} <> '') THEN 'integer'
  WHEN bool_and(try_cast({f} AS DOUBLE) IS NOT NULL) FILTER ({f} <> '') THEN 'float'
  WHEN bool_and(regexp_full_match({f}, '[0-9]{{4}}-.*') AND try_strptime({f}, '%Y-%m-%d') IS NOT NULL) FILTER ({f} <> '') THEN 'datetime'
  WHEN bool_and(coalesce(try_strptime({f}, '%d/%m/%Y'), try_strptime({f}, '%m/%d/%Y')) IS NOT NULL) FILTER ({f} <> '') THEN 'date'
  WHEN bool_and(regexp_full_match({f}, '[0-9]+:[0-9]+')) FILTER ({f} <> '') THEN 'time' ELSE 'string' END AS type,
  count(nullif({f}, '')) < count(*) AS nullable, min(length(nullif({f}, ''))) AS shortest FROM t"""
_TEXTS = [(c, "") for c in ("flag", "whole", "decimal", "day", "euro_day", "clock", "mixed", "nothing")]


@query("profile_types", f"WITH {_T}, j AS (" + _per_field(_JUDGE, _TEXTS) + """)
SELECT name, type, nullable, CAST(CASE WHEN type = 'string' THEN shortest WHEN type = 'null' THEN 0 END AS INTEGER) AS min_length FROM j""")
def profile_types(spark, sf_dir):
    return profile.field_profiles(_texts(spark, sf_dir)).select("name", "type", "nullable", "min_length")


def _contacts(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    digest = F.md5(key)
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@mail.example.com")).alias("email"),
        F.concat(F.lit("https://shop.example.com/"), key).alias("url"),
        F.format_string("+49 (%d) %d-11", F.col("c_nationkey"), F.col("c_custkey")).alias("phone"),
        F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]).alias("uuid"),
        F.format_string("10.%d.%d.7", F.col("c_nationkey"), F.col("c_custkey") % 250).alias("address"),
        F.col("c_name").alias("name"))


_C = """t AS (SELECT lower(replace(c_name, '#', '.')) || '@mail.example.com' AS email, 'https://shop.example.com/' || c_custkey AS url,
  printf('+49 (%d) %d-11', c_nationkey, c_custkey) AS phone, substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) || '-' ||
  substr(md5(CAST(c_custkey AS VARCHAR)), 9, 4) || '-' || substr(md5(CAST(c_custkey AS VARCHAR)), 13, 4) || '-' ||
  substr(md5(CAST(c_custkey AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST(c_custkey AS VARCHAR)), 21, 12) AS uuid,
  printf('10.%d.%d.7', c_nationkey, c_custkey % 250) AS address, c_name AS name FROM customer)"""
_MATCH = ("SELECT '{f}' AS name, CASE " + " ".join(
    f"WHEN bool_and(regexp_matches({{f}}, '{p.replace('{', '{{').replace('}', '}}')}')) THEN '{n}'" for n, p in PATTERNS)
    + " END AS pattern, CAST(min(length({f})) AS INTEGER) AS min_length, CAST(max(length({f})) AS INTEGER) AS max_length FROM t")


@query("profile_patterns", f"WITH {_C} " + _per_field(_MATCH, [(c, "") for c in ("email", "url", "phone", "uuid", "address", "name")]))
def profile_patterns(spark, sf_dir):
    return profile.field_profiles(_contacts(spark, sf_dir)).select("name", "pattern", "min_length", "max_length")


_TYPES = f"""WITH p AS (
  SELECT 'o_custkey' AS name, 'integer' AS source_type, CASE WHEN min(o_custkey) >= -32768 AND max(o_custkey) <= 32767 THEN 'SMALLINT'
    WHEN max(o_custkey) <= 2147483647 THEN 'INTEGER' ELSE 'BIGINT' END AS target_type, count(DISTINCT o_custkey) = count(*) AS u FROM orders
  UNION ALL SELECT 'o_orderkey', 'integer', CASE WHEN max(o_orderkey) <= 32767 THEN 'SMALLINT' WHEN max(o_orderkey) <= 2147483647
    THEN 'INTEGER' ELSE 'BIGINT' END, count(DISTINCT o_orderkey) = count(*) FROM orders
  UNION ALL SELECT 'o_orderdate', 'datetime', 'TIMESTAMP', count(DISTINCT o_orderdate) = count(*) FROM orders
  UNION ALL SELECT 'o_orderstatus', 'string', 'VARCHAR(' || max(length(o_orderstatus)) || ')', count(DISTINCT o_orderstatus) = count(*) FROM orders
  UNION ALL SELECT 'o_totalprice', 'float', 'DOUBLE PRECISION', count(DISTINCT o_totalprice) = count(*) FROM orders)"""


def _order_profile(spark, sf_dir):
    return profile.field_profiles(table(spark, sf_dir, "orders").drop("o_orderpriority"))


_ALL_TYPES = _TYPES[:-1] + """
  UNION ALL SELECT 'o_orderpriority', 'string', 'VARCHAR(' || max(length(o_orderpriority)) || ')', count(DISTINCT o_orderpriority) = count(*) FROM orders)"""


@query("profile_all_target_types", _ALL_TYPES + """SELECT name, source_type, target_type,
CASE WHEN u THEN 'NOT NULL UNIQUE' ELSE 'NOT NULL' END AS constraints, false AS nullable FROM p""")
def profile_all_target_types(spark, sf_dir):
    return profile.target_types(profile.field_profiles(table(spark, sf_dir, "orders")), "postgresql")


@query("profile_create_whole_table", _ALL_TYPES + """SELECT 'CREATE TABLE orders (' || chr(10) || string_agg('  ' || name || ' ' || target_type ||
CASE WHEN u THEN ' NOT NULL UNIQUE' ELSE ' NOT NULL' END, ',' || chr(10) ORDER BY name) || chr(10) || ');' AS create_sql FROM p""")
def profile_create_whole_table(spark, sf_dir):
    return profile.create_table_text(profile.target_types(profile.field_profiles(table(spark, sf_dir, "orders")), "postgresql"), "orders")


@query("profile_index_hints", f"""WITH {_E}, p AS (""" + _per_field("""SELECT '{f}' AS field, count(DISTINCT {f}) = count({f}) AS "unique",
count(DISTINCT {f}) / count({f}) AS ratio FROM e""") + """)
SELECT 'idx_' || field AS name, field, "unique", CASE WHEN "unique" THEN 'Unique field' ELSE 'High cardinality' END AS reason
FROM p WHERE "unique" OR ratio > 0.9""")
def profile_index_hints(spark, sf_dir):
    return profile.index_hints(profile.field_profiles(_events(spark, sf_dir)))


@query("profile_samples", f"WITH {_E} " + _per_field("""
SELECT '{f}' AS name, row_number() OVER (ORDER BY event_id) - 1 AS position, CAST({f} AS VARCHAR) AS value FROM e
WHERE {f} IS NOT NULL QUALIFY position < 10"""))
def profile_samples(spark, sf_dir):
    return profile.sample_values(_events(spark, sf_dir), "event_id")


@query("profile_hints", """SELECT 'discount' AS name, count(nullif(l_discount, 0)) < count(*) / 2 AS mostly_null, false AS enum_check FROM lineitem
UNION ALL SELECT 'rare', count(CASE WHEN l_quantity > 40 THEN l_returnflag END) < count(*) / 2, true FROM lineitem
UNION ALL SELECT 'l_linestatus', false, count(DISTINCT l_linestatus) <= 20 FROM lineitem""")
def profile_hints(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.expr("nullif(l_discount, 0)").alias("discount"), F.expr("CASE WHEN l_quantity > 40 THEN l_returnflag END").alias("rare"),
        "l_linestatus")
    return profile.profile_hints(profile.field_profiles(lines))


@query("profile_type_conflicts", f"""WITH {_T} SELECT 'mixed' AS name, CASE WHEN mixed = 'n/a' THEN 'string' ELSE 'integer' END AS value_type,
count(*) AS values FROM t GROUP BY ALL
UNION ALL SELECT 'decimal', CASE WHEN decimal LIKE '%e1' THEN 'float' ELSE 'integer' END, count(*) FROM t GROUP BY ALL
UNION ALL SELECT 'flag', CASE WHEN flag = 'Yes' THEN 'string' ELSE 'integer' END, count(*) FROM t WHERE flag <> '' GROUP BY ALL""")
def profile_type_conflicts(spark, sf_dir):
    return profile.type_conflicts(_texts(spark, sf_dir))


@query("profile_nested", """SELECT 'embedding' AS name, 'array' AS type, count(embedding) < count(*) AS nullable FROM embeddings
UNION ALL SELECT 'label', 'integer', count(label) < count(*) FROM embeddings
UNION ALL SELECT 'pair', 'object', count(vec_id) < count(*) FROM embeddings""")
def profile_nested(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("embedding", "label", F.struct("vec_id", "label").alias("pair"))
    return profile.field_profiles(vectors).select("name", "type", "nullable")


# ---- classification -------------------------------------------------------------------------------


def _json_events(spark, sf_dir):
    """Events as JSON lines whose keys differ: kind, value and extra occur in some only."""
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(
        "event_id", F.col("user_id").cast("string").alias("user_id"), F.expr("nullif(event_type, 'error')").alias("kind"),
        F.expr("CASE WHEN value > 12 THEN cast(value as string) END").alias("value"),
        F.expr("CASE WHEN value > 200 THEN 'high' END").alias("extra"))).alias("line"))


_J = """j AS (SELECT event_id, 'event_id' || CASE WHEN value > 200 THEN ',extra' ELSE '' END ||
  CASE WHEN event_type <> 'error' THEN ',kind' ELSE '' END || ',user_id' || CASE WHEN value > 12 THEN ',value' ELSE '' END AS fields FROM events)"""


@query("classify_variants", f"WITH {_J} SELECT fields, count(*) AS count FROM j GROUP BY fields")
def classify_variants(spark, sf_dir):
    out = classify.variant_counts(_json_events(spark, sf_dir), "line", "event_id")
    return out.select(F.array_join("fields", ",").alias("fields"), "count")


@query("classify_category", f"""WITH {_J}, v AS (SELECT fields, count(*) AS n FROM j GROUP BY fields)
SELECT 'mixed' AS category, round(least(0.9, greatest(0.5, max(n) / sum(n))), 6) AS confidence, CAST(sum(n) AS BIGINT) AS records,
count(*) AS variants, CAST(2 AS BIGINT) AS common_keys,
(SELECT count(DISTINCT k) FROM (SELECT unnest(string_split(fields, ',')) AS k FROM v)) AS all_keys FROM v""")
def classify_category(spark, sf_dir):
    out = classify.category(_json_events(spark, sf_dir), "line", "event_id")
    return out.withColumn("confidence", F.round("confidence", 6))


@query("classify_route", """SELECT 'success' AS status, 'mixed' AS category, event_id, CAST(user_id AS BIGINT) AS user_id,
nullif(event_type, 'error') AS kind, CASE WHEN value > 12 THEN value END AS value FROM events""")
def classify_route(spark, sf_dir):
    routed = classify.route(_json_events(spark, sf_dir), "line", "event_id")
    out = routed.data.select("event_id", "user_id", "kind", "value")
    return out.select(F.lit(routed.status).alias("status"), F.lit(routed.category).alias("category"), "*")


@query("unify_dominant", """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
nullif(event_type, 'error') AS kind, CASE WHEN value > 12 THEN CAST(value AS VARCHAR) END AS value FROM events""")
def unify_dominant(spark, sf_dir):
    return classify.unify_dominant(_json_events(spark, sf_dir), "line", "event_id").select("event_id", "user_id", "kind", "value")


@query("unify_types", """SELECT page_id, CAST(page_id * 3 AS BIGINT) AS whole, CASE WHEN lower(url) LIKE 'https%' THEN CAST(page_id AS DOUBLE)
ELSE page_id + 0.5 END AS number, url AS name FROM pages""")
def unify_types(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", (F.col("page_id") * 3).cast("string").alias("whole"),
        F.when(F.lower("url").startswith("https"), F.col("page_id").cast("string"))
        .otherwise(F.concat(F.col("page_id").cast("string"), F.lit(".5"))).alias("number"), F.col("url").alias("name"))
    return classify.unify_types(pages, ["whole", "number", "name"])


def _dates(spark, sf_dir):
    """Order dates in several shapes."""
    layout = {"1-URGENT": "MM/dd/yyyy", "2-HIGH": "dd-MM-yyyy", "3-MEDIUM": "dd.MM.yyyy", "5-LOW": "MMM d yyyy"}
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    for priority, pattern in layout.items():
        day = F.when(F.col("o_orderpriority") == priority, F.date_format("o_orderdate", pattern)).otherwise(day)
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"))


_D = """d AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%m/%d/%Y')
  WHEN '2-HIGH' THEN strftime(o_orderdate, '%d-%m-%Y') WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%d.%m.%Y')
  WHEN '5-LOW' THEN strftime(o_orderdate, '%b %-d %Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'MM/DD/YYYY' WHEN '2-HIGH' THEN 'DD-MM-YYYY' WHEN '3-MEDIUM' THEN 'DD.MM.YYYY'
  WHEN '5-LOW' THEN 'unknown' ELSE 'YYYY-MM-DD' END AS format, o_orderdate FROM orders)"""


@query("unify_dates", f"""WITH {_D} SELECT o_orderkey, CASE WHEN format = 'unknown' THEN day
ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM d""")
def unify_dates(spark, sf_dir):
    return classify.unify_dates(_dates(spark, sf_dir), ["day"])


@query("noise_formats", f"WITH {_D} SELECT o_orderkey, day, format FROM d")
def noise_formats(spark, sf_dir):
    return noise.value_formats(_dates(spark, sf_dir), "day")


@query("noise_date_inconsistent", f"""WITH {_D} SELECT o_orderkey, 'day' AS field, day AS value, 'unknown' AS detected_format,
'format_inconsistent' AS noise_type FROM d WHERE format = 'unknown'""")
def noise_date_inconsistent(spark, sf_dir):
    return noise.date_inconsistencies(_dates(spark, sf_dir), "day", "o_orderkey")


# ---- noise ----------------------------------------------------------------------------------------


@query("noise_missing", """SELECT event_id FROM events WHERE event_type IN ('error', 'view')""")
def noise_missing(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn(
        "kind", F.when(F.col("event_type") == "view", " \t ").otherwise(F.expr("nullif(event_type, 'error')")))
    return events.where(noise.is_missing(events, "kind")).select("event_id")


def _flagged(df, tests, *keep):
    return df.where(tests[0].flag()).select(*keep)


@query("noise_outlier_zscore", """SELECT event_id, value FROM events WHERE abs((value - (SELECT avg(value) FROM events)) /
(SELECT stddev_samp(value) FROM events)) > 3""")
def noise_outlier_zscore(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return _flagged(events, noise.zscore_tests(events, ["value"]), "event_id", "value")


@query("noise_outlier_mad", """WITH m AS (SELECT median(value) AS m FROM events), d AS (SELECT median(abs(value - m)) AS d FROM events, m)
SELECT event_id, value FROM events, m, d WHERE 0.6745 * abs(value - m) / d > 2.5""")
def noise_outlier_mad(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return _flagged(events, noise.mad_tests(events, ["value"]), "event_id", "value")


@query("noise_outlier_iqr", """WITH s AS (SELECT list_sort(list(value)) AS v, count(*) AS n FROM events),
q AS (SELECT v[n // 4 + 1] AS q1, v[3 * n // 4 + 1] AS q3 FROM s)
SELECT event_id, value FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def noise_outlier_iqr(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return _flagged(events, noise.iqr_tests(events, ["value"]), "event_id", "value")


@query("noise_exact_duplicates", """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (
PARTITION BY text, lang, source, n_chars ORDER BY doc_id) AS k FROM documents) WHERE k > 1""")
def noise_exact_duplicates(spark, sf_dir):
    return noise.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id").select("doc_id")


@query("noise_key_duplicates", """SELECT event_id FROM (SELECT event_id, row_number() OVER (
PARTITION BY user_id, nullif(event_type, 'error') ORDER BY event_id) AS k FROM events) WHERE k > 1""")
def noise_key_duplicates(spark, sf_dir):
    return noise.key_duplicates(_events(spark, sf_dir), ["user_id", "kind"], "event_id").select("event_id")


@query("noise_field_duplicates", """
SELECT o_orderkey, 'o_custkey' AS field, CAST(o_custkey AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k > 1
UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM (SELECT *, row_number() OVER (
  PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders) WHERE k > 1""")
def noise_field_duplicates(spark, sf_dir):
    return noise.field_duplicates(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey")


_LABELS = f"""{_E}, z AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM e),
labels_ AS (SELECT event_id, 'kind' AS field, 'missing_value' AS noise_type, 'medium' AS severity, CAST(NULL AS VARCHAR) AS original_value,
  'impute or remove' AS suggested_action FROM e WHERE kind IS NULL
UNION ALL SELECT event_id, 'value', 'outlier', 'high', CAST(value AS VARCHAR), 'investigate or cap' FROM e, z WHERE abs((value - m) / d) > 3
UNION ALL """ + " UNION ALL ".join(f"""SELECT event_id, '{f}', 'duplicate', 'high', v, 'deduplicate' FROM (
  SELECT event_id, CAST({f} AS VARCHAR) AS v, row_number() OVER (PARTITION BY {f} ORDER BY event_id) AS k FROM e WHERE {f} IS NOT NULL) WHERE k > 1"""
                                   for f in ("user_id", "kind", "value")) + ")"


def _labels(spark, sf_dir):
    return noise.noise_labels(_events(spark, sf_dir), "event_id")


@query("noise_labels", f"WITH {_LABELS} SELECT * FROM labels_")
def noise_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


@query("noise_by_type", f"""WITH {_LABELS} SELECT noise_type, count(*) AS label_count,
string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM labels_ GROUP BY ALL""")
def noise_by_type(spark, sf_dir):
    return noise.counts_by_type(_labels(spark, sf_dir)).withColumn("fields", F.array_join("fields", ","))


@query("noise_by_field", f"WITH {_LABELS} SELECT field, count(*) AS label_count FROM labels_ GROUP BY ALL")
def noise_by_field(spark, sf_dir):
    return noise.counts_by_field(_labels(spark, sf_dir))


@query("noise_report", f"""WITH {_LABELS} SELECT (SELECT count(*) FROM e) AS total_records, count(*) AS label_count,
round(count(*) / (SELECT count(*) FROM e), 6) AS label_rate, count(DISTINCT event_id) AS noisy_records,
round(count(DISTINCT event_id) / (SELECT count(*) FROM e), 6) AS noisy_rate FROM labels_""")
def noise_report(spark, sf_dir):
    events = _events(spark, sf_dir)
    out = noise.noise_report(events, noise.noise_labels(events, "event_id"), "event_id")
    return out.withColumns({c: F.round(c, 6) for c in ("label_rate", "noisy_rate")})


@query("noise_clean", f"WITH {_LABELS} SELECT event_id, user_id, kind, value FROM e WHERE event_id NOT IN (SELECT event_id FROM labels_)")
def noise_clean(spark, sf_dir):
    events = _events(spark, sf_dir)
    return noise.clean(events, noise.noise_labels(events, "event_id"), "event_id")


@query("noise_rules_text", """
WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority, o_custkey,
  CASE o_orderkey % 3 WHEN 0 THEN '555-123-4567' WHEN 1 THEN 'ext ' || o_custkey ELSE NULL END AS phone,
  o_orderpriority || CASE o_orderkey % 4 WHEN 0 THEN chr(7) WHEN 1 THEN chr(9) ELSE '' END AS note,
  CASE o_orderkey % 5 WHEN 0 THEN 'caf' || chr(195) || chr(169) WHEN 1 THEN o_custkey || chr(65533) WHEN 2 THEN 'caf' || chr(233) END AS place FROM orders)
SELECT o_orderkey, 'day' AS field, 'future_date' AS noise_type, 'high' AS severity, day AS original_value, 'review manually' AS suggested_action
FROM o WHERE day > '1996-06-30'
UNION ALL SELECT o_orderkey, 'phone', 'phone_format_inconsistent', 'low', phone, 'review manually' FROM o WHERE o_orderkey % 3 = 1
UNION ALL SELECT o_orderkey, 'note', 'invalid_char', 'low', note, 'sanitize or remove' FROM o WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'place', 'encoding_issue', 'low', place, 're-encode' FROM o WHERE o_orderkey % 5 < 2""")
def noise_rules_text(spark, sf_dir):
    at = lambda n: F.col("o_orderkey") % n
    customer = F.col("o_custkey").cast("string")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(at(3) == 0, "555-123-4567").when(at(3) == 1, F.concat(F.lit("ext "), customer)).alias("phone"),
        F.concat("o_orderpriority", F.when(at(4) == 0, "\x07").when(at(4) == 1, "\t").otherwise("")).alias("note"),
        F.when(at(5) == 0, "caf\u00c3\u00a9").when(at(5) == 1, F.concat(customer, F.lit("\ufffd"))).when(at(5) == 2, "caf\u00e9").alias("place"))
    return noise.rule_labels(orders, "o_orderkey", [
        ("day", "future_date", noise.future_date("day", F.lit("1996-06-30").cast("timestamp"))),
        ("phone", "phone_format_inconsistent", noise.phone_mismatch("phone")),
        ("note", "invalid_char", noise.invalid_characters("note")),
        ("place", "encoding_issue", noise.encoding_issue("place"))])


@query("noise_rules_extra", """
WITH c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE replace(c_name, '#', '.') || '@x.example' END AS mail,
  CASE WHEN c_nationkey < 5 THEN 'n' || c_nationkey ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer)
SELECT c_custkey, 'c_acctbal' AS field, 'negative_number' AS noise_type, 'high' AS severity, CAST(c_acctbal AS VARCHAR) AS original_value,
  'review manually' AS suggested_action FROM c WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'mail', 'invalid_email', 'medium', mail, 'review manually' FROM c WHERE NOT regexp_matches(mail, '^[\\w\\.-]+@[\\w\\.-]+\\.\\w+$')
UNION ALL SELECT c_custkey, 'nation', 'type_mismatch', 'low', nation, 'convert or coerce' FROM c WHERE try_cast(nation AS BIGINT) IS NULL""")
def noise_rules_extra(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).otherwise(
            F.concat(F.regexp_replace("c_name", "#", "."), F.lit("@x.example"))).alias("mail"),
        F.when(F.col("c_nationkey") < 5, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).otherwise(
            F.col("c_nationkey").cast("string")).alias("nation"))
    return noise.rule_labels(customers, "c_custkey", [
        ("c_acctbal", "negative_number", noise.negative_number("c_acctbal")),
        ("mail", "invalid_email", noise.invalid_email("mail")),
        ("mail", "invalid_char", noise.invalid_characters("mail")),
        ("mail", "encoding_issue", noise.encoding_issue("mail")),
        ("nation", "type_mismatch", noise.type_mismatch("nation", "bigint"))])
