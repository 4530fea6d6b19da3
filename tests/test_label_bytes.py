"""Labels of long categories."""

from pyspark.sql import functions as F

from rowmill.operators import encoding, joins
from tests.conftest import plan_of, rows


def test_categories_beyond_the_byte_bound_are_indexed(spark, monkeypatch):
    df = spark.range(60).select("id", F.when(F.col("id") % 5 > 0, F.repeat(F.chr(F.col("id") % 5 + 96), F.lit(500))).alias("long"))
    few = rows(encoding.label_encode(df, "long"), "id", "long_encoded")
    assert few == sorted([(i, i % 5) for i in range(60)], key=repr)
    monkeypatch.setattr(joins.fits_in_memory, "__defaults__", (joins.MAX_BROADCAST_ROWS, 1000))
    many = encoding.label_encode(df, "long")
    assert "_slot" in plan_of(many) and rows(many, "id", "long_encoded") == few
