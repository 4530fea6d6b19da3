"""Queries of the operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_minhash_near_dedup", r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT c.a, c.b FROM common c JOIN sets p ON p.doc_id = c.a JOIN sets q ON q.doc_id = c.b
          WHERE 100 * c.n >= 85 * (len(p.s) + len(q.s) - c.n)),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
smallest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sets s JOIN smallest m USING (doc_id)""")
def op9(spark, sf_dir):
    from rowmill.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("of", "component_of").withColumnRenamed("id", "doc_id")


def _ids_text(ids):
    return F.array_join(ids.cast("array<string>"), " ")


@query("op5_byte_bpe")
def op5(spark, sf_dir):
    import public_tokenizers

    from rowmill.llm.bpe import encode

    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                   starts=None, decoded="decoded", keep_text=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(_ids_text(F.col("ids")), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_line_dedup", r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
    SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op10(spark, sf_dir):
    from rowmill.llm.lines import drop_lines

    docs = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_merkle_fingerprints", r"""
WITH ordered AS (
    SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS after,
           first_value(coalesce(text, '')) OVER (ORDER BY doc_id) AS first FROM documents),
texts AS (
    SELECT doc_id, t, coalesce(after, first) AS n, CAST(length(t) // 4 AS BIGINT) AS k FROM ordered),
edited AS (SELECT doc_id, t, n, left(t, length(t) - k) || left(n, k) AS e FROM texts),
cut AS (
    SELECT doc_id, t, e,
           list_transform(string_split(t, chr(10) || chr(10)), lambda s: string_split(s, chr(10))) AS a,
           list_transform(string_split(e, chr(10) || chr(10)), lambda s: string_split(s, chr(10))) AS b,
           list_transform(string_split(n, chr(10) || chr(10)), lambda s: string_split(s, chr(10))) AS c FROM edited),
hashed AS (
    SELECT doc_id, t, e, a, b,
           sha256(array_to_string(list_transform(a, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(list_transform(regexp_extract_all(p, '(?s).{8,64}?(?:[.!?。！？।؟、，…]+|[\x20\x09])[\x20\x09]*|.{1,64}'), lambda x: md5(x)), ''))), ''))), '')) AS ra,
           sha256(array_to_string(list_transform(b, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(list_transform(regexp_extract_all(p, '(?s).{8,64}?(?:[.!?。！？।؟、，…]+|[\x20\x09])[\x20\x09]*|.{1,64}'), lambda x: md5(x)), ''))), ''))), '')) AS rb,
           sha256(array_to_string(list_transform(c, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(list_transform(regexp_extract_all(p, '(?s).{8,64}?(?:[.!?。！？।؟、，…]+|[\x20\x09])[\x20\x09]*|.{1,64}'), lambda x: md5(x)), ''))), ''))), '')) AS rc,
           list_distinct(flatten(list_transform(flatten(a), lambda p: regexp_extract_all(p, '(?s).{8,64}?(?:[.!?。！？।؟、，…]+|[\x20\x09])[\x20\x09]*|.{1,64}')))) AS ma,
           list_distinct(flatten(list_transform(flatten(b), lambda p: regexp_extract_all(p, '(?s).{8,64}?(?:[.!?。！？।؟、，…]+|[\x20\x09])[\x20\x09]*|.{1,64}')))) AS mb,
           list_distinct(flatten(list_transform(flatten(c), lambda p: regexp_extract_all(p, '(?s).{8,64}?(?:[.!?。！？।؟、，…]+|[\x20\x09])[\x20\x09]*|.{1,64}')))) AS mc FROM cut)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(e) AS edited_sha256, ra AS fingerprint, rb AS edited_fingerprint,
       CASE WHEN ra = rb THEN 1.0::DOUBLE ELSE coalesce(2.0::DOUBLE * coalesce(list_sum(list_transform(list_intersect(ma, mb), lambda x: length(x))), 0) / nullif(coalesce(list_sum(list_transform(ma, lambda x: length(x))), 0) + coalesce(list_sum(list_transform(mb, lambda x: length(x))), 0), 0), 0.0::DOUBLE) END AS near_edited,
       CASE WHEN ra = rc THEN 1.0::DOUBLE ELSE coalesce(2.0::DOUBLE * coalesce(list_sum(list_transform(list_intersect(ma, mc), lambda x: length(x))), 0) / nullif(coalesce(list_sum(list_transform(ma, lambda x: length(x))), 0) + coalesce(list_sum(list_transform(mc, lambda x: length(x))), 0), 0), 0.0::DOUBLE) END AS near_next,
       CAST(list_sum(list_transform(range(greatest(len(a), len(b))), lambda i: len(list_filter(
           range(greatest(coalesce(len(a[i + 1]), 1), coalesce(len(b[i + 1]), 1))), lambda j: a[i + 1][j + 1] IS DISTINCT FROM b[i + 1][j + 1])))) AS BIGINT) AS n_differing
FROM hashed""")
def op3(spark, sf_dir):
    from rowmill.llm.merkle import differing, likeness, marks, root, tree, with_next

    docs = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)))
    docs = docs.select("id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sections",
                       tree(F.col("edited")).alias("edited_sections"), "next_sections")
    docs = docs.select("*", *[f(F.col(f"{c}sections")).alias(f"{c}{k}") for c in ("", "edited_", "next_") for k, f in (("root", root), ("marks", marks))])
    near = [likeness(F.col("root"), F.col("marks"), F.col(f"{c}root"), F.col(f"{c}marks")).alias(f"near_{n}") for c, n in (("edited_", "edited"), ("next_", "next"))]
    return docs.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", F.col("root").alias("fingerprint"),
                       F.col("edited_root").alias("edited_fingerprint"), *near,
                       F.size(differing(F.col("sections"), F.col("edited_sections"))).cast("long").alias("n_differing"))


@query("op7_orc_token_files")
def op7(spark, sf_dir):
    import public_tokenizers

    from rowmill.llm.tokenfiles import checksum, read_tokens, write_tokens
    from rowmill.session import staged_path

    path = staged_path(spark, "tokens.orc")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return checksum(read_tokens(spark, path))


@query("op8_ordinal_quality")
def op8(spark, sf_dir):
    from rowmill.llm.labelled import remainder
    from rowmill.llm.quality import grade, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), use=remainder("doc_id", 5) != 0)
    graded = grade(docs.select("doc_id", "text"), model)
    return graded.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                         "expected_grade", "tail_probability", F.col("selected").alias("kept"))


@query("op1_toxicity")
def op1(spark, sf_dir):
    from rowmill.llm.labelled import remainder
    from rowmill.llm.staging import stage
    from rowmill.llm.toxicity import calibrate, toxicity, train

    docs, labels, use = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0
    model = train(docs, labels, use=use)
    scored = stage(toxicity(docs.select("doc_id", "lang", "text"), model).drop("text"), "toxicity")
    thresholds = calibrate(scored, labels, use=use)
    limit = F.lit(thresholds[None])
    for lang, value in sorted((k, v) for k, v in thresholds.items() if k is not None):
        limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), limit.alias("lang_threshold"),
                         (F.col("score") >= limit).alias("flagged"))


@query("op6_language_id")
def op6(spark, sf_dir):
    from rowmill.llm.labelled import remainder
    from rowmill.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, remainder("doc_id", 4) != 2)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score",
                        F.size("spans").alias("n_spans"))


@query("op4_embedding_near_dedup", """
WITH RECURSIVE finite AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) AS most FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
fine AS (
    SELECT vec_id, label, CASE WHEN most BETWEEN 1e-100 AND 1e100 THEN v
        ELSE list_transform(v, lambda x: x / power(2::DOUBLE, greatest(floor(log2(most)), -1022))) END AS v FROM finite),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
smallest AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, s.component_id, e.vec_id = s.component_id AS kept
FROM embeddings e JOIN smallest s USING (vec_id) LEFT JOIN counts c USING (vec_id)""")
def op4(spark, sf_dir):
    from rowmill.llm.hnsw import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op2_temperature_mixing")
def op2(spark, sf_dir):
    from rowmill.llm.mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, max_repeats=1.25, budget_share=1.0)[0].select("doc_id", "source", "n_tokens", "weight", "pass", "position")


@query("op13_url_filters", r"""
WITH urls AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(r_host, r_path, r_verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
    SELECT DISTINCT host, path, r_host || r_path AS rule, r_verdict, row_number() OVER (
        PARTITION BY host, path ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS place
    FROM (SELECT DISTINCT host, path FROM urls) JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)),
bad AS (
    SELECT doc_id AS page_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) AS bad FROM labels
    WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY 1),
counted AS (SELECT host, count(b.bad) AS n, coalesce(sum(b.bad), 0) AS k FROM urls LEFT JOIN bad b USING (page_id) GROUP BY 1),
named AS (SELECT host, n, k, regexp_replace(host, '(?s)^.*@|:[0-9]*$', '', 'g') AS name FROM counted),
cut AS (
    SELECT *, array_to_string(string_split(name, '.')[-2:], '.') AS two, regexp_matches(name, '^[0-9.]+$') OR starts_with(name, '[') AS numbers,
           array_to_string(string_split(name, '.')[-2:], '.') IN (
               'co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'ne.jp', 'or.jp', 'com.br', 'com.cn',
               'com.tr', 'com.mx', 'co.in', 'co.kr', 'co.za') AS long FROM named),
hosts AS (
    SELECT host, n, k, CASE WHEN numbers THEN name WHEN long THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE two END AS domain,
           CASE WHEN numbers THEN '#' WHEN long THEN two ELSE string_split(name, '.')[-1] END AS suffix FROM cut),
domains AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY 1),
levels AS (
    SELECT 'host' AS level, domain AS parent, n, k FROM hosts UNION ALL SELECT 'domain', suffix, n, k FROM domains
    UNION ALL SELECT 'suffix', '', n, k FROM suffixes),
sums AS (
    SELECT level, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k, count(*) AS m, sum(CAST(k AS DOUBLE) * k / n) AS q,
           sum(CAST(n AS DOUBLE) * n) AS nn FROM levels WHERE n > 0 GROUP BY level, parent),
worth AS (
    SELECT level, 1 / least(greatest(CASE WHEN sum(k / n * (1 - k / n) * (n - nn / n - (m - 1))) > 1e-9
        THEN sum(q - k * k / n - k / n * (1 - k / n) * (m - 1)) / sum(k / n * (1 - k / n) * (n - nn / n - (m - 1))) ELSE 0.05 END, 1e-4), 0.5) - 1 AS s
    FROM sums GROUP BY level),
w AS (
    SELECT coalesce((SELECT s FROM worth WHERE level = 'host'), 19.0) AS w_host, coalesce((SELECT s FROM worth WHERE level = 'domain'), 19.0) AS w_domain,
           coalesce((SELECT s FROM worth WHERE level = 'suffix'), 19.0) AS w_suffix,
           (SELECT (coalesce(sum(k), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) FROM suffixes) AS top),
s1 AS (SELECT suffix, (k + w_suffix * top) / (n + w_suffix) AS above FROM suffixes, w),
d1 AS (SELECT d.domain, (k + w_domain * above) / (n + w_domain) AS above FROM domains d JOIN s1 USING (suffix), w),
h1 AS (SELECT h.host, n, k + w_host * above AS a, n - k + w_host * (1 - above) AS b FROM hosts h JOIN d1 USING (domain), w),
known AS (SELECT host, n, greatest(a / (a + b) - 1.2816 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)), 0) AS bound FROM h1)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.r_verdict, CASE WHEN bound >= 0.3 THEN 'block' ELSE 'allow' END) AS verdict, k.n AS n_labelled,
       CAST(round(bound, 6) AS DOUBLE) AS bad_bound
FROM urls u JOIN known k USING (host) LEFT JOIN fits f ON f.host = u.host AND f.path = u.path AND f.place = 1""")
def op13(spark, sf_dir):
    from rowmill.llm.urls import judge_urls

    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")],
                                  "host string, path string, verdict string")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    out = judge_urls(table(spark, sf_dir, "pages"), labels, rules)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "n_labelled", F.round("bad_bound", 6).alias("bad_bound"))


@query("op12_conversation_repair", r"""
WITH RECURSIVE coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
fated AS (
    SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS fate
    FROM coded),
rows AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
           CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM fated WHERE fate <> 0),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role) || md5(text)) AS r,
           CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS code, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS cut
    FROM rows),
faulty AS (
    SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 THEN 'duplicate'
                   WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(code) OVER (PARTITION BY conv_id ORDER BY r) AS prior FROM ordered),
counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (prior IS NOT NULL AND prior || code NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
best(conv_id, r, b) AS (
    SELECT conv_id, n, [{'c': 0, 'a': ''}, {'c': 10, 'a': 'II'}, {'c': 5, 'a': 'I'}, {'c': 0, 'a': ''}] FROM counts
    UNION ALL
    SELECT conv_id, r, [list_min([e[1], {'c': e[3].c + 5, 'a': 'I' || e[3].a}, {'c': e[4].c + 10, 'a': 'II' || e[4].a}]),
                        list_min([e[2], {'c': e[3].c + 5, 'a': 'I' || e[3].a}, {'c': e[4].c + 10, 'a': 'II' || e[4].a}]),
                        list_min([e[3], {'c': e[4].c + 5, 'a': 'I' || e[4].a}]), list_min([e[4], {'c': e[3].c + 5, 'a': 'I' || e[3].a}])]
    FROM (
        SELECT b.conv_id, b.r - 1 AS r, list_transform([1, 2, 3, 4], lambda q: list_min([
            {'c': b[q].c + 2, 'a': 'D' || b[q].a},
            {'c': CASE WHEN f.fault IN ('blank', 'duplicate') THEN 1000000 ELSE 1 + CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END + b[CASE q WHEN 3 THEN 4 ELSE 3 END].c END,
             'a': 'R' || b[CASE q WHEN 3 THEN 4 ELSE 3 END].a},
            {'c': CASE WHEN f.fault IN ('blank', 'duplicate') THEN 1000000 WHEN code = 's' AND q = 1 OR code = 'u' AND q <> 3 OR code = 'a' AND q = 3
                  THEN CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END + b[CASE code WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c ELSE 1000000 END,
             'a': 'K' || b[CASE code WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a}])) AS e
        FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.r = b.r)),
found AS (SELECT conv_id, b[1].c AS cost, b[1].a AS audit FROM best WHERE r = 0),
walk(conv_id, i, r, q, audit, lines) AS (
    SELECT conv_id, 0, 0, 1, audit, CAST([] AS VARCHAR[]) FROM found
    UNION ALL
    SELECT conv_id, i + 1, r2, CASE WHEN x = 'D' THEN q WHEN x = 'K' THEN CASE code WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END WHEN q = 3 THEN 4 ELSE 3 END, audit,
           CASE x WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                ELSE list_append(lines, CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END || CASE WHEN x = 'R' THEN text ELSE '' END) END
    FROM (
        SELECT w.conv_id, w.i, w.q, w.audit, w.lines, w.audit[w.i + 1] AS x, w.r + CASE WHEN w.audit[w.i + 1] = 'I' THEN 0 ELSE 1 END AS r2, f.role, f.text, f.code
        FROM walk w LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.r = w.r + 1 AND w.audit[w.i + 1] <> 'I' WHERE w.i < length(w.audit))),
ends AS (SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS sha FROM walk WHERE i = length(audit))
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""")
def op12(spark, sf_dir):
    from rowmill.llm.conversations import conv_key, damage, message_digests, repair

    rows = table(spark, sf_dir, "conversations")
    found, messages = repair(damage(rows))
    out = rows.select("conv_id").distinct().withColumn("conv", conv_key(F.col("conv_id"))).join(found, "conv", "left").join(
        message_digests(messages), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op11_ranked_search", r"""
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
held AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM docs WHERE len(t) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM held),
postings AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM held) GROUP BY r, term),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, total GROUP BY term, all_docs),
items AS (
    SELECT item_id, row_number() OVER () AS i, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
scores AS (
    SELECT i, r, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_docs) // all_terms)))) AS BIGINT) AS score
    FROM items JOIN weights USING (term) JOIN postings USING (term), total GROUP BY i, r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10""")
def op11(spark, sf_dir):
    from rowmill.llm.lexical import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
