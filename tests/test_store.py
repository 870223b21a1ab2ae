import pytest
from pyspark.sql import types as T

from tempora.model import AggregateRequest, Aggregator, DownsampleRequest, LatestRequest, Names, RangeRequest, Span
from tempora.operators import reads
from tempora.plans.engine import Engine
from tempora.sources import store
from tempora.sources.csv import read_csv, rejected_lines
from tempora.streaming.ingest import append_stream, downsample_stream

SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("d", T.DoubleType())])


def some(spark, lo, hi):
    return spark.createDataFrame([(f"k{n % 3}", n * 700, n, n / 3) for n in range(lo, hi)], SCHEMA)


def test_lifecycle(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Engine(spark, str(tmp_path / "none"))
    engine = Engine(spark, str(tmp_path))
    table = engine.create_table("t", SCHEMA, buckets=4, block_ms=10_000)
    assert engine.read("t").count() == 0
    with pytest.raises(ValueError):
        engine.create_table("t", SCHEMA)
    with pytest.raises(ValueError):
        engine.write("t", some(spark, 0, 2).drop("d"))
    engine.write("t", some(spark, 0, 60))
    assert engine.read("t").count() == 60
    table.compact()
    engine.write("t", some(spark, 60, 100))
    again = Engine(spark, str(tmp_path))
    assert again.connect() == ["t"] and spark.table("t").count() == 100
    assert again.schema_text("t").splitlines()[0] == "d double"
    direct = some(spark, 0, 100)
    span = Span(3100, 61_000)
    for compacted in (False, True):
        if compacted:
            again.shutdown()
        for agg in Aggregator:
            for column in ("i", "d"):
                for key in ("k1", None):
                    request = AggregateRequest(column, agg, span, key)
                    ours, plain = (sorted(map(tuple, x.collect())) for x in (again.aggregate("t", request), reads.aggregate(direct, request)))
                    assert len(ours) == len(plain) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(ours, plain, strict=True))
        assert sorted(r.i for r in again.latest("t", LatestRequest()).collect()) == [97, 98, 99]
        assert again.time_range("t", RangeRequest("k2", span)).count() == reads.time_range(direct, RangeRequest("k2", span)).count()
        request = DownsampleRequest("i", Aggregator.MAX, Span(0, 70_000), 7000, None, "k0")
        assert sorted(map(tuple, again.downsample("t", request).collect())) == sorted(map(tuple, reads.downsample(direct, request).collect()))
    for read in (again.time_range("t", RangeRequest("k2", span)), again.latest("t", LatestRequest(("k2",)))):
        assert "PartitionFilters: [isnotnull(tempora_bucket" in read._jdf.queryExecution().toString()


def test_dedupe_and_csv(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.create_table("t", SCHEMA)
    engine.write("t", some(spark, 0, 5).union(some(spark, 0, 5)), dedupe=True)
    assert engine.read("t").count() == 5
    (tmp_path / "in.csv").write_text("k1,5,7,1.5\nshort,1\nk2,x,1,2.0\nk3,6,8,2.5\n")
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "in.csv"), SCHEMA).collect())) == [("k1", 5, 7, 1.5), ("k3", 6, 8, 2.5)]
    assert [r.key for r in read_csv(spark, str(tmp_path / "in.csv"), SCHEMA).select("key").orderBy("key").collect()] == ["k1", "k3"]
    assert sorted(r.line for r in rejected_lines(spark, str(tmp_path / "in.csv"), SCHEMA).collect()) == ["k2,x,1,2.0", "short,1"]


def test_names_that_a_store_uses(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    own = T.StructType([*SCHEMA.fields, T.StructField("Tempora_bucket", T.IntegerType())])
    with pytest.raises(ValueError):
        engine.create_table("t", own)
    wide = T.StructType([*SCHEMA.fields, *(T.StructField(c, T.IntegerType()) for c in ("bkt", "block", "rows", "n", "row"))])
    engine.create_table("t", wide, buckets=2, block_ms=1000)
    engine.write("t", spark.createDataFrame([("a", 5, 1, 1.0, 7, 9, 11, 13, 15), ("a", 5000, 1, 1.0, 8, 8, 8, 8, 8)], wide))
    engine.shutdown()
    assert sorted(tuple(r)[4:] for r in engine.read("t").collect()) == [(7, 9, 11, 13, 15), (8, 8, 8, 8, 8)]
    for column, most in (("bkt", 8), ("block", 9), ("rows", 11)):
        assert engine.aggregate("t", AggregateRequest(column, Aggregator.MAX, Span(0, 10_000), "a")).first()[2] == most
    assert engine.connect() == ["t"] and spark.table("t").columns == wide.names


def test_concurrent_writers_and_torn_files(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    engine = Engine(spark, str(tmp_path))
    table = engine.create_table("t", SCHEMA, buckets=2)
    (tmp_path / "t/_manifest/.half").write_text("")
    (tmp_path / "t/_manifest/none.json").write_text("{")
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda n: engine.write("t", some(spark, 10 * n, 10 * n + 10).coalesce(1)), range(16)))
    assert sorted(r.i for r in engine.read("t").collect()) == list(range(160))
    assert len(list((tmp_path / "t/_manifest").glob("0*.json"))) <= store.MANIFESTS
    before = engine.read("t")
    table.compact()
    assert before.count() == 160  # a reader that began before keeps its files
    table.compact(retain=0)
    assert not list((tmp_path / "t/staged").iterdir()) and engine.read("t").count() == 160


def test_runs_are_merged_by_level(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "STAGED", 2)
    engine = Engine(spark, str(tmp_path))
    table = engine.create_table("t", SCHEMA, buckets=2, block_ms=7000)
    for n in range(10):
        engine.write("t", some(spark, 10 * n, 10 * n + 10).coalesce(1))
    assert sorted(r["level"] for r in table.snapshot().state["runs"]) == [0, 1] and not table.snapshot().state["staged"]
    first = {r["path"] for r in table.snapshot().state["runs"]}
    engine.write("t", some(spark, 100, 110))
    table.compact()
    assert first < {r["path"] for r in table.snapshot().state["runs"]}  # what was there is not written again
    engine.write("t", some(spark, 110, 115))
    direct, span = some(spark, 0, 115), Span(3100, 61_000)
    for aggregator in Aggregator:
        request = AggregateRequest("i", aggregator, span)
        assert sorted(map(tuple, engine.aggregate("t", request).collect())) == sorted(map(tuple, reads.aggregate(direct, request).collect()))
    for keys in (None, ("k1", "k1", "none"), ("k2",)):
        request = LatestRequest(keys, ("i", "d"))
        assert sorted(map(tuple, engine.latest("t", request).collect())) == sorted(map(tuple, reads.latest(direct, request).collect()))


def test_latest_settles_ties(spark, monkeypatch):
    rows = [("a", 5, 9, 1.0), ("a", 5, 3, 2.0), ("a", 5, 3, 1.5), ("a", 4, 0, 0.0), ("b", None, 1, 1.0), (None, 9, 1, 1.0), ("c", 1, None, 1.0), ("c", 1, 0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, reads.latest(df, LatestRequest()).collect())) == [("a", 5, 3, 1.5), ("c", 1, None, 1.0)]
    monkeypatch.setattr(reads, "FEW_KEYS", 1)
    assert sorted(map(tuple, reads.latest(df, LatestRequest(("a", "c", "a", "z"), ("i",))).collect()), key=str) == [("a", 5, 3), ("a", 5, 3), ("c", 1, None)]
    assert reads.latest(df, LatestRequest(())).collect() == []


def test_stream(spark, tmp_path):
    for d in ("root", "land"):
        (tmp_path / d).mkdir()
    engine = Engine(spark, str(tmp_path / "root"))
    table = engine.create_table("t", SCHEMA, Names())
    again = some(spark, 0, 30).union(some(spark, 0, 5))  # rows of one key and time are kept unless dedupe is asked for
    again.write.mode("append").parquet(str(tmp_path / "land"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "land"))
    append_stream(stream(), table, str(tmp_path / "c")).awaitTermination()
    assert engine.read("t").count() == 35
    some(spark, 30, 40).write.mode("append").parquet(str(tmp_path / "land"))
    append_stream(stream(), table, str(tmp_path / "c")).awaitTermination()
    assert engine.read("t").count() == 45
    # A batch that comes again is not added again.
    name, number = next(iter(table.snapshot().state["streams"].items()))
    for n in (number, number - 1):
        table.append(some(spark, 0, 3), once=(name, n))
    assert engine.read("t").count() == 45 and len(list((tmp_path / "root/t/staged").iterdir())) == 2
    direct = spark.read.schema(SCHEMA).parquet(str(tmp_path / "land"))
    for kind in ("ts", "timestamp_millis(ts) AS ts", "CAST(timestamp_millis(ts) AS TIMESTAMP_NTZ) AS ts"):
        for key in ("k0", None):
            request = DownsampleRequest("i", Aggregator.MAX, Span(1400, 15_400), 7000, None, key)
            rows = stream().selectExpr("key", kind, "i", "d")
            query = downsample_stream(rows, request, "1 second").writeStream.format("memory").queryName("w").outputMode("complete")
            query.trigger(availableNow=True).start().awaitTermination()
            assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, reads.downsample(direct, request).collect()))
