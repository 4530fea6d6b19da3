"""Texts that are one JSON value, and texts that are not."""

import pytest
from pyspark.sql import functions as F

from rowmill.functions.text import is_json, json_in_text

WHOLE = ['{"a":1}', ' 7 ', '"key"', "null", "[1, [2]]", '{"a":1,"a":2}', '{"a":{"b":1,"b":2}}', "[]", "{}", "true", "-1.5e3"]
NOT = ['"key":7,"name":"x"}', '"a" junk', "5 6", '{"a":1} {"b":2}', '{"a":1}}', "[1] 2", "[1,2]]", '"a":1', "1,2", '{"a":1,"a":2} x', "nul", "",
       '{"a":1,"a":2},"k":{"b":1}', "0]}", "1}}", "{'a': 1}", '{"a":']


@pytest.fixture(scope="module")
def found(spark):
    texts = spark.createDataFrame([(t,) for t in [*WHOLE, *NOT, None, 'x {"a":1} {"b":2} y', '{"a":1} [2']], "t string")
    return {r["t"]: (r["whole"], r["part"]) for r in texts.select("t", is_json(F.col("t")).alias("whole"), json_in_text(F.col("t")).alias("part")).collect()}


@pytest.mark.parametrize("text", WHOLE)
def test_one_value(found, text):
    assert found[text][0] is True


@pytest.mark.parametrize("text", NOT)
def test_no_single_value(found, text):
    assert found[text][0] is False


def test_values_inside_text(found):
    assert found[None] == (None, None)
    assert found['x {"a":1} {"b":2} y'][1] is None
    assert found['{"a":1} [2'] == (False, '{"a":1}')
