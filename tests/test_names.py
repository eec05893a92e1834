"""Natural order and nested search beyond any fixed size."""

from pyspark.sql import functions as F

from stripline.functions.names import natural_key
from stripline.streaming.events import nested_search


def test_natural_order_of_long_numbers(spark):
    names = ["page-9.png", "page-10.png", "page-0011.png", "page-12345678901234567890.png", "page-123456789012345678901.png", "page-x.png"]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "name string")
    assert [r.name for r in df.orderBy(natural_key("name")).collect()] == names


def test_nested_search_at_any_depth(spark):
    body = '{"a":{"b":{"c":{"d":{"e":{"f":["x", {"Term_key": 1}, "my TERM here", 42]}}}}}}'
    body = body + "}" * (body.count("{") - body.count("}"))
    df = spark.createDataFrame([(1, body), (2, '"term"'), (3, "not json {"), (4, None)], "id long, body string")
    got = sorted((r.id, r.path, r.value) for r in nested_search(df, "body", "term", ["id"]).collect())
    assert got == [(1, "$.a.b.c.d.e.f[1].Term_key", "Term_key"), (1, "$.a.b.c.d.e.f[2]", "my TERM here"), (2, "$", "term")]
