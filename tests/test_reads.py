"""Contract examples, edge cases, and random requests against plain Python."""

import math
import random

import pytest
from pyspark.sql import types as T

from tempora.model import AggregateRequest, Aggregator, Compare, DownsampleRequest, LatestRequest, Names, RangeRequest, Span, ValueFilter
from tempora.operators import reads

START = 1693274400000
SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("s", T.StringType()),
        T.StructField("i", T.IntegerType()),
        T.StructField("d", T.DoubleType()),
    ]
)
AVG, MAX = Aggregator.AVG, Aggregator.MAX


def series(spark, values, key="V"):
    return spark.createDataFrame([(key, START + 1000 * n, "", v, float(v)) for n, v in enumerate(values)], SCHEMA)


def rows(df):
    return sorted(tuple(r)[1:] for r in df.collect())


def test_maximum_at_the_lower_bound(spark):
    df = series(spark, [10, 11, 13, 15, 17, 19, 21, 20, 18, 16])
    request = AggregateRequest("i", MAX, Span(START + 155, START + 10235), "V")
    assert rows(reads.aggregate(df, request)) == [(START + 155, 21)]


@pytest.mark.parametrize(
    "where, lower, expected",
    [
        (ValueFilter(Compare.GREATER, 11), 183, [(183, 16.0), (5183, 18.75)]),
        (ValueFilter(Compare.EQUAL, 20), 183, [(183, -math.inf), (5183, 20.0)]),
        (ValueFilter(Compare.GREATER, 10), 10000, []),
    ],
)
def test_windows_of_the_contract(spark, where, lower, expected):
    df = series(spark, [15, 11, 13, 15, 17, 19, 21, 20, 18, 16])
    span = Span(START + lower, START + lower + 10000)
    found = rows(reads.downsample(df, DownsampleRequest("i", AVG, span, 5000, where, "V")))
    assert found == [(START + t, v) for t, v in expected]


def test_edges(spark):
    nan, low = math.nan, -2147483648
    data = [("a", 0, "", low, -5.0), ("a", 1000, "x" * 300, 3, nan), ("a", 9000, "é", 4, -7.0), ("b", 5, "", 1, nan)]
    df = spark.createDataFrame([(k, START + t, s, i, d) for k, t, s, i, d in data], SCHEMA)
    span = Span(START - 5000, START + 15000)
    ask = lambda c, agg, where=None, iv=5000, key="a": rows(reads.downsample(df, DownsampleRequest(c, agg, span, iv, where, key)))
    assert ask("d", MAX) == [(START, -5.0), (START + 5000, -7.0)]
    assert ask("i", MAX, ValueFilter(Compare.EQUAL, low)) == [(START, low), (START + 5000, low)]
    assert ask("d", MAX, ValueFilter(Compare.GREATER, 1)) == [(START, -math.inf), (START + 5000, -math.inf)]
    assert ask("d", MAX, ValueFilter(Compare.GREATER, -6.0)) == [(START, -5.0), (START + 5000, -math.inf)]
    assert len(ask("d", AVG, None, 500)) == 3
    assert rows(reads.aggregate(df, AggregateRequest("d", MAX, span, "b"))) == []
    assert rows(reads.latest(df, LatestRequest(("b", "a", "b", "none"), ("i",)))) == [(START + 5, 1), (START + 5, 1), (START + 9000, 4)]
    assert len(reads.time_range(df, RangeRequest("a", Span(START, START + 9000))).collect()) == 2
    assert reads.time_range(df, RangeRequest("a", span)).columns == SCHEMA.names
    for bad in (
        lambda: DownsampleRequest("i", MAX, span, 3),
        lambda: Span(2, 2),
        lambda: reads.aggregate(df, AggregateRequest("s", MAX, span)),
        lambda: reads.aggregate(df, AggregateRequest("none", MAX, span)),
        lambda: ask("s", MAX),
        lambda: reads.value_filter(df, "s", ValueFilter(Compare.GREATER, "a")),
    ):
        with pytest.raises(ValueError):
            bad()


def test_random_requests(spark):
    draw = random.Random(5)
    data = [(draw.choice("abc"), START + draw.randrange(0, 60_000), "", draw.randrange(-9, 9), draw.uniform(-3, 3)) for _ in range(400)]
    df = spark.createDataFrame(data, SCHEMA).cache()
    for _ in range(6):
        lower, width, n = START + draw.randrange(-9000, 30_000), draw.choice([700, 1000, 5000]), draw.randrange(1, 9)
        span, key = Span(lower, lower + width * n), draw.choice("abcd")
        column, place = draw.choice([("i", 3), ("d", 4)])
        literal = draw.choice([0, 2, -100]) if column == "i" else draw.choice([0.0, 2.5])
        op, agg = draw.choice(list(Compare)), draw.choice(list(Aggregator))
        windows: dict = {}
        for r in data:
            if r[0] == key and span.lower <= r[1] < span.upper:
                hit = r[place] == literal if op is Compare.EQUAL else r[place] > literal
                windows.setdefault(lower + (r[1] - lower) // width * width, []).extend([r[place]] if hit else [])
        none = -2147483648 if agg is not AVG and column == "i" else -math.inf
        fold = {MAX: max, Aggregator.MIN: min, AVG: lambda v: sum(v) / len(v)}[agg]
        expected = [(t, fold(v) if v else none) for t, v in sorted(windows.items())]
        found = rows(reads.downsample(df, DownsampleRequest(column, agg, span, width, ValueFilter(op, literal), key)))
        assert [t for t, _ in found] == [t for t, _ in expected]
        assert all(a == b or abs(a - b) < 1e-9 for (_, a), (_, b) in zip(found, expected, strict=True))


def test_time_predicate_reaches_the_scan(spark, tmp_path):
    series(spark, range(50)).write.parquet(str(tmp_path / "t"))
    plan = reads.time_range(spark.read.parquet(str(tmp_path / "t")), RangeRequest("V", Span(START, START + 9)), ).select("ts")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "EqualTo(key,V)" in plan
