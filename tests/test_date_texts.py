"""Dates written in text."""

import datetime

import pytest
from pyspark.sql import functions as F

from rowmill.functions.dates import moment

DAY = datetime.datetime(2024, 1, 5)
CASES = {
    "2024-01-05": DAY, "01/05/2024": DAY, "1/5/2024": DAY, "01.05.2024": DAY, "01-05-2024": DAY, "2024/01/05": DAY, "20240105": DAY,
    "Jan 5, 2024": DAY, "5 January 2024": DAY, "January 5th 2024": DAY, "Friday, 5 jan 2024": DAY, "5-Jan-2024": DAY, "2024.01.05 7:08": DAY.replace(hour=7, minute=8),
    "13/05/2024": datetime.datetime(2024, 5, 13), "31.12.2023": datetime.datetime(2023, 12, 31), "May 2024": datetime.datetime(2024, 5, 1),
    "01/05/2024 17:08:09": DAY.replace(hour=17, minute=8, second=9), "2024-01-05T07:08:09": DAY.replace(hour=7, minute=8, second=9),
    "13/13/2024": None, "30/02/2024": None, "Jam 5, 2024": None, "anf 5 2024": None, "5 Jan 6 2024": None, "soon": None, "": None, None: None,
}


@pytest.fixture(scope="module")
def found(spark):
    texts = spark.createDataFrame([(t,) for t in CASES], "t string")
    return {r["t"]: r["m"] for r in texts.select("t", F.to_timestamp_ntz(moment(F.col("t")).cast("string")).alias("m")).collect()}


@pytest.mark.parametrize("text", list(CASES))
def test_moment(found, text):
    assert found[text] == CASES[text]
