import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from gatelens.functions.lexicon import strict_parse_json
from gatelens.plans import fixtures as fx


def test_streams_come_from_one_pass_over_the_turns(spark):
    """The conversations used to be read three times, for the lines, the blank lines and the broken ones."""
    plan = fx.stream_lines(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_a_line_is_one_json_value(spark):
    texts = ['{"a": 1}', " [1, 2] ", "null", "1 2", "1, 2", "", "{broken json", '{"a": 1} junk', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r["v"] and json.loads(r["v"]) for r in df.select("id", F.to_json(strict_parse_json(F.col("text"))).alias("v")).orderBy("id").collect()]
    assert got == [{"a": 1}, [1, 2], None, None, None, None, None, None, None]
    assert [r["id"] for r in df.filter(strict_parse_json(F.col("text")).isNotNull()).orderBy("id").collect()] == [0, 1, 2]
