"""Thresholds of toxicity scores count every labelled document that is set aside."""

from pyspark.sql import functions as F

from rowmill.llm import toxicity


def test_thresholds_count_all_documents_set_aside(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id").where(toxicity.set_aside())
    n = ids.count()
    assert n > toxicity.TRAIN_ROWS  # more than a sample of the fit would hold
    # Only 1 in 40 is toxic; those reach 0.31, the others 0.3 in German and 0.7 in English, null has no threshold of its own.
    docs = ids.withColumn("toxic", (F.col("doc_id") % 40 < 1).cast("int")).withColumn("lang", F.element_at(F.array(
        F.lit("de"), F.lit("en"), F.lit(None).cast("string")), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) + 1).cast("int")))
    score = F.when(F.col("toxic") == 1, F.when(F.col("lang") == "en", 0.75).otherwise(0.31)).when(F.col("lang") == "en", 0.7).otherwise(0.3)
    scored = docs.select("doc_id", "lang", score.alias("score"))
    labels = docs.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    found = toxicity.calibrate(scored, labels)
    assert set(found) == {None, "de", "en"} and found["en"] in (0.72, 0.74)

    rows, grid = [tuple(r) for r in scored.join(labels, "doc_id").select("lang", "score", "toxic").collect()], [k / 50 for k in range(1, 50)]

    def plain(some):
        toxic = sum(t for _, _, t in some)
        f1 = [2 * sum(t for _, s, t in some if s >= x) / (sum(s >= x for _, s, _ in some) + toxic) for x in grid]
        return min((x for x, f in zip(grid, f1) if f >= max(f1) - 1e-12), key=lambda x: abs(x - 0.5))

    assert abs(found[None] - plain(rows)) < 1e-9 and all(abs(found[x] - plain([r for r in rows if r[0] == x])) < 1e-9 for x in ("de", "en"))
    assert toxicity.calibrate(scored, labels.limit(0)) == {None: 0.5}
    assert toxicity.calibrate(scored, labels, use=F.col("doc_id") < 0) == {None: 0.5}
