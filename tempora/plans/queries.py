"""One query for each operator over the events table as series, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.predicates import in_span, key_is, value_filter
from tempora.model import AggregateRequest, Aggregator, Compare, DownsampleRequest, LatestRequest, Names, RangeRequest, Span, ValueFilter
from tempora.operators import reads
from tempora.plans.engine import Engine
from tempora.sources.csv import read_csv, rejected_lines
from tempora.sources.folders import new_folder
from tempora.streaming.ingest import append_stream, downsample_stream

NAMES = Names("user_id", "ts")
DAY = 86_400_000
#: 2024-01-01 00:00:00.183, off every whole second.
LOWER = 1_704_067_200_183
SPAN, DAYS, FUTURE = Span(LOWER, LOWER + 20 * DAY), Span(LOWER, LOWER + 10 * DAY), Span(LOWER + 4000 * DAY, LOWER + 4001 * DAY)
HOUR, KEY = 3_600_000, 7
AVG, MAX, MIN = Aggregator.AVG, Aggregator.MAX, Aggregator.MIN


def events(spark, sf_dir: str) -> DataFrame:
    """Events with an integer column `k` taken from their properties."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))


_EVENTS = "(SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"


def _sql_time(ms: int) -> str:
    return f"make_timestamp({ms}::BIGINT * 1000)"


def _sql_where(span: Span, key=None) -> str:
    mine = "" if key is None else f"user_id = {key} AND "
    return f"{mine}ts >= {_sql_time(span.lower)} AND ts < {_sql_time(span.upper)}"


def _sql_fold(column: str, aggregator: Aggregator, where: str) -> str:
    if aggregator is not AVG:
        return f"{aggregator.value}({column}) FILTER (WHERE {where})"
    if column == "k":
        return f"round(sum(k) FILTER (WHERE {where})::DOUBLE / nullif(count(k) FILTER (WHERE {where}), 0), 6)"
    return f"round(avg({column}) FILTER (WHERE {where}), 6)"


def _rounded(df: DataFrame, column: str) -> DataFrame:
    """Averages to six decimals: sums of doubles differ in the last digits with their order."""
    return df.withColumn(column, F.round(column, 6))


def _aggregate(column, aggregator, span=DAYS, key=KEY):
    def run(spark, sf_dir):
        out = reads.aggregate(events(spark, sf_dir), AggregateRequest(column, aggregator, span, key), NAMES)
        return _rounded(out, column) if aggregator is AVG else out

    group = "user_id"
    sql = f"SELECT {group}, {span.lower}::BIGINT AS ts, {_sql_fold(column, aggregator, 'true')} AS {column} FROM {_EVENTS} WHERE {_sql_where(span, key)} GROUP BY {group}"
    return run, sql


def _downsample(column, aggregator, where=None, interval=HOUR, span=SPAN, key=KEY):
    def run(spark, sf_dir):
        out = reads.downsample(events(spark, sf_dir), DownsampleRequest(column, aggregator, span, interval, where, key), NAMES)
        return _rounded(out, column) if aggregator is AVG else out

    kind = {"k": int, "value": float}[column]
    test = "true" if where is None else "false" if type(where.literal) is not kind else f"{column} {where.op.value} {where.literal}"
    none = "(-2147483648)::INTEGER" if aggregator is not AVG and column == "k" else "'-infinity'::DOUBLE"
    start = f"({span.lower}::BIGINT + ((epoch_us(ts) - {span.lower}::BIGINT * 1000) // ({interval}::BIGINT * 1000)) * {interval}::BIGINT)"
    sql = f"SELECT user_id, {start} AS ts, coalesce({_sql_fold(column, aggregator, test)}, {none}) AS {column} FROM {_EVENTS} WHERE {_sql_where(span, key)} GROUP BY ALL"
    return run, sql


def _range(span, key=KEY, columns=()):
    def run(spark, sf_dir):
        return reads.time_range(events(spark, sf_dir), RangeRequest(key, span, columns), NAMES)

    names = ", ".join(["user_id", "ts", *columns]) if columns else "*"
    return run, f"SELECT {names} FROM {_EVENTS} WHERE {_sql_where(span, key)}"


def _latest(keys=None, columns=()):
    def run(spark, sf_dir):
        return reads.latest(events(spark, sf_dir), LatestRequest(keys, columns), NAMES)

    names = ", ".join(["user_id", "ts", *columns]) if columns else "* EXCLUDE (nth)"
    asked = "" if keys is None else f" JOIN (VALUES {', '.join(f'({k})' for k in keys)}) AS asked(user_id) USING (user_id)"
    return run, f"SELECT {names} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS nth FROM {_EVENTS}){asked} WHERE nth = 1"


def _bounds():
    """Bounds on existing times: the lower one is included, the upper one is not."""

    def run(spark, sf_dir):
        df = events(spark, sf_dir)
        ms = F.date_trunc("millisecond", "ts").cast("timestamp_ntz")
        on = df.filter(F.col("user_id") == KEY).withColumn("ts", ms)
        times = on.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
        both = times.select(*(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c}) div 1000").alias(c) for c in "ab")).first()
        if both.a is None or both.a >= both.b:
            return on.limit(0).select("user_id", "ts", "value")
        return reads.time_range(on, RangeRequest(KEY, Span(both.a, both.b), ("value",)), NAMES)

    sql = (
        f"WITH e AS (SELECT user_id, date_trunc('milliseconds', ts) AS ts, value FROM events WHERE user_id = {KEY}) "
        f"SELECT * FROM e WHERE ts >= (SELECT min(ts) FROM e) AND ts < (SELECT max(ts) FROM e)"
    )
    return run, sql


def _scratch(spark) -> str:
    """A new folder in the cluster's shared one."""
    folder = new_folder(spark, "store")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


SERIES = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)
_SERIES_SQL = f"SELECT user_id, ts, event_type, k, value FROM {_EVENTS}"


def _stored(spark, sf_dir: str, compact: bool, staged: bool) -> Engine:
    engine = Engine(spark, _scratch(spark))
    engine.create_table("events", SERIES, NAMES, buckets=16, block_ms=DAY)
    rows = events(spark, sf_dir).select(SERIES.names)
    half = F.pmod(F.xxhash64("ts"), F.lit(2)) == 0
    engine.write("events", rows.filter(half))
    if compact and staged:
        engine.table("events").compact()
    engine.write("events", rows.filter(~half))
    if compact and not staged:
        engine.table("events").compact()
    return engine


def _round_trip(compact: bool, staged: bool):
    return lambda spark, sf_dir: _stored(spark, sf_dir, compact, staged).read("events").select(SERIES.names), _SERIES_SQL


def _rolled_up(column, aggregator, key=None):
    def run(spark, sf_dir):
        out = _stored(spark, sf_dir, True, False).aggregate("events", AggregateRequest(column, aggregator, DAYS, key))
        return _rounded(out, column) if aggregator is AVG else out

    return run, _aggregate(column, aggregator, DAYS, key)[1]


def _stored_downsample():
    request = DownsampleRequest("value", AVG, SPAN, HOUR, ValueFilter(Compare.GREATER, 100.0), KEY)
    return lambda spark, sf_dir: _rounded(_stored(spark, sf_dir, True, True).downsample("events", request), "value"), _downsample("value", AVG, request.where)[1]


def _runs(spark, sf_dir: str) -> Engine:
    """Three parts, each compacted to a run but the last, which stays beside them."""
    engine = Engine(spark, _scratch(spark))
    engine.create_table("events", SERIES, NAMES, buckets=16, block_ms=DAY)
    third = F.pmod(F.xxhash64("ts"), F.lit(3))
    rows = events(spark, sf_dir).select(SERIES.names)
    for i in range(3):
        engine.write("events", rows.filter(third == i))
        if i < 2:
            engine.table("events").compact()
    return engine


def _beside(column, aggregator, key=None):
    def run(spark, sf_dir):
        out = _runs(spark, sf_dir).aggregate("events", AggregateRequest(column, aggregator, DAYS, key))
        return _rounded(out, column) if aggregator is AVG else out

    return run, _aggregate(column, aggregator, DAYS, key)[1]


def _stored_latest(keys=None):
    def run(spark, sf_dir):
        return _runs(spark, sf_dir).latest("events", LatestRequest(keys, ("value", "k", "event_type")))

    return run, _latest(keys, ("value", "k", "event_type"))[1]


def _stored_range():
    def run(spark, sf_dir):
        return _runs(spark, sf_dir).time_range("events", RangeRequest(KEY, DAYS))

    return run, f"SELECT user_id, ts, event_type, k, value FROM {_EVENTS} WHERE {_sql_where(DAYS, KEY)}"


def _connected():
    def run(spark, sf_dir):
        engine = _stored(spark, sf_dir, False, True)
        assert Engine(spark, engine.data_path).connect() == ["events"]
        return spark.sql("SELECT * FROM events")

    return run, _SERIES_SQL


def _schema_text():
    def run(spark, sf_dir):
        engine = Engine(spark, _scratch(spark))
        engine.create_table("events", SERIES, NAMES)
        return spark.createDataFrame([(engine.schema_text("events"),)], "text string")

    return run, "SELECT concat_ws(chr(10), 'event_type string', 'k int', 'ts timestamp_ntz', 'user_id bigint', 'value double') AS text"


_MS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000"


def _streamed(spark, sf_dir: str) -> DataFrame:
    """The events as a stream; its source is a folder of them."""
    folder = f"{_scratch(spark)}/land"
    events(spark, sf_dir).select(SERIES.names).write.parquet(folder)
    return spark.readStream.schema(SERIES).option("maxFilesPerTrigger", 1).parquet(folder)


def _stream_append():
    def run(spark, sf_dir):
        engine = Engine(spark, _scratch(spark))
        table = engine.create_table("events", SERIES, NAMES, buckets=16, block_ms=DAY)
        append_stream(_streamed(spark, sf_dir), table, f"{_scratch(spark)}/checkpoint").awaitTermination()
        return engine.read("events")

    return run, _SERIES_SQL


def _stream_downsample(key=KEY):
    request = DownsampleRequest("value", AVG, SPAN, HOUR, ValueFilter(Compare.GREATER, 100.0), key)

    def run(spark, sf_dir):
        folder, windows = _scratch(spark), downsample_stream(_streamed(spark, sf_dir), request, "1 day", NAMES)
        done = []

        def put(batch: DataFrame, number: int) -> None:
            batch.write.parquet(f"{folder}/batch-{number}")
            done.append(number)

        writer = windows.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
        return _rounded(spark.read.parquet(f"{folder}/batch-{done[-1]}"), "value")

    return run, _downsample("value", AVG, request.where, key=key)[1]


def _odd(aggregator, where, interval=HOUR, key=None):
    """Values with NaN, null and negative zero among them."""
    request = DownsampleRequest("value", aggregator, SPAN, interval, where, key)
    odd = "CASE WHEN k % 7 = 0 THEN {nan} WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN -0.0{d} WHEN k % 2 = 0 THEN 0.0{d} ELSE value END"

    def run(spark, sf_dir):
        rows = events(spark, sf_dir).withColumn("value", F.expr(odd.format(nan="double('NaN')", d="D")))
        # Adding zero makes both zeros one.
        return reads.downsample(rows, request, NAMES).withColumn("value", F.col("value") + 0.0)

    sql = _downsample("value", aggregator, None, interval, key=key)[1].replace("value) FILTER (WHERE true)", "value) FILTER (WHERE {})")
    test = "NOT isnan(value)" + ("" if where is None else f" AND value {where.op.value} {where.literal}")
    view = f"(SELECT * REPLACE ({odd.format(nan=chr(39) + 'nan' + chr(39) + '::DOUBLE', d='::DOUBLE')} AS value) FROM {_EVENTS})"
    return run, f"SELECT user_id, ts, value + 0.0 AS value FROM ({sql.format(test).replace(_EVENTS, view)})"


def _csv_folder(spark, sf_dir: str) -> str:
    folder = f"{_scratch(spark)}/csv"
    rows = events(spark, sf_dir).withColumn("ts", F.expr(_MS)).select(SERIES.names)
    # Every line whose k is a multiple of ten lacks a field; of those with k 1 the time is no number.
    line = F.concat_ws(",", "user_id", F.when(F.col("k") == 1, F.lit("noon")).otherwise(F.col("ts").cast("string")), "event_type", "k")
    rows.select(F.when(F.col("k") % 10 == 0, line).otherwise(F.concat_ws(",", line, "value"))).write.text(folder)
    return folder


_SERIES_MS = T.StructType([f if f.name != "ts" else T.StructField("ts", T.LongType()) for f in SERIES])


def _csv_rejected():
    def run(spark, sf_dir):
        return rejected_lines(spark, _csv_folder(spark, sf_dir), _SERIES_MS, NAMES).agg(F.count("*").alias("n"))

    return run, f"SELECT count(*) AS n FROM {_EVENTS} WHERE k % 10 = 0 OR k = 1"


def _csv_mixed():
    def run(spark, sf_dir):
        return read_csv(spark, _csv_folder(spark, sf_dir), _SERIES_MS, NAMES)

    return run, f"SELECT user_id, epoch_us(ts) // 1000 AS ts, event_type, k, value FROM {_EVENTS} WHERE k % 10 <> 0 AND k <> 1"


def _csv():
    schema = _SERIES_MS

    def run(spark, sf_dir):
        folder = f"{_scratch(spark)}/csv"
        rows = events(spark, sf_dir).withColumn("ts", F.expr(_MS)).select(SERIES.names)
        rows.write.csv(folder)
        return read_csv(spark, folder, schema, NAMES)

    return run, f"SELECT user_id, epoch_us(ts) // 1000 AS ts, event_type, k, value FROM {_EVENTS}"


def _filtered(column, where):
    def run(spark, sf_dir):
        df = events(spark, sf_dir)
        return df.filter(value_filter(df, column, where)).select("user_id", "ts", column)

    literal = f"'{where.literal}'" if isinstance(where.literal, str) else where.literal
    return run, f"SELECT user_id, ts, {column} FROM {_EVENTS} WHERE {column} {where.op.value} {literal}"


def _plain(build, sql):
    return (lambda spark, sf_dir: build(events(spark, sf_dir))), sql


_GREAT, _SAME = Compare.GREATER, Compare.EQUAL
_ALL = {
    "scan_project": _plain(lambda df: reads.project(df, NAMES, ("value",)), "SELECT user_id, ts, value FROM events"),
    "key_filter": _plain(lambda df: df.filter(key_is(df, NAMES, KEY)).select("user_id", "ts", "value"), f"SELECT user_id, ts, value FROM events WHERE user_id = {KEY}"),
    "time_predicate": _plain(lambda df: df.filter(in_span(df, NAMES, DAYS)).select("user_id", "ts", "value"), f"SELECT user_id, ts, value FROM events WHERE {_sql_where(DAYS)}"),
    "filter_equal_string": _filtered("event_type", ValueFilter(_SAME, "click")),
    "filter_equal_int": _filtered("k", ValueFilter(_SAME, 20)),
    "filter_greater_double": _filtered("value", ValueFilter(_GREAT, 100.0)),
    "time_range_cols": _range(DAYS, columns=("value", "k")),
    "time_range_all": _range(DAYS),
    "time_range_bounds": _bounds(),
    "time_range_missing_key": _range(DAYS, key=-5),
    "latest_all": _latest(),
    "latest_keys": _latest((3, 7, 11, -5), ("value", "k")),
    "latest_dup_keys": _latest((3, 7, 7, -5, 3)),
    "agg_max_int": _aggregate("k", MAX),
    "agg_max_double": _aggregate("value", MAX),
    "agg_avg_int": _aggregate("k", AVG),
    "agg_avg_double": _aggregate("value", AVG),
    "agg_empty_range": _aggregate("value", MAX, FUTURE),
    "agg_all_keys": _aggregate("value", AVG, DAYS, None),
    "ds_max_int_gt": _downsample("k", MAX, ValueFilter(_GREAT, 50)),
    "ds_max_int_eq": _downsample("k", MAX, ValueFilter(_SAME, 20)),
    "ds_max_double_gt": _downsample("value", MAX, ValueFilter(_GREAT, 100.0)),
    "ds_max_double_eq": _downsample("value", MAX, ValueFilter(_SAME, 0.0)),
    "ds_avg_int_gt": _downsample("k", AVG, ValueFilter(_GREAT, 50)),
    "ds_avg_int_eq": _downsample("k", AVG, ValueFilter(_SAME, 20)),
    "ds_avg_double_gt": _downsample("value", AVG, ValueFilter(_GREAT, 100.0)),
    "ds_avg_double_eq": _downsample("value", AVG, ValueFilter(_SAME, 0.0)),
    "ds_all_filtered": _downsample("k", MAX, ValueFilter(_GREAT, 1_000_000)),
    "ds_other_type": _downsample("k", MAX, ValueFilter(_GREAT, 1.5)),
    "ds_empty_range": _downsample("k", MAX, ValueFilter(_GREAT, 1), span=FUTURE),
    "ds_nofilter_avg": _downsample("value", AVG),
    "ds_subsecond": _downsample("value", MAX, None, 250, Span(LOWER, LOWER + DAY)),
    "ds_unaligned_lower": _downsample("value", MAX, ValueFilter(_GREAT, 10.0), 7 * 60_000, Span(LOWER + 777, LOWER + 777 + 700 * 60_000 * 7)),
    "ds_all_keys": _downsample("value", AVG, ValueFilter(_GREAT, 100.0), key=None),
    "append_roundtrip": _round_trip(False, False),
    "compacted_roundtrip": _round_trip(True, False),
    "base_and_staged_roundtrip": _round_trip(True, True),
    "stored_downsample": _stored_downsample(),
    "rollup_agg_max": _rolled_up("k", MAX),
    "rollup_agg_avg_int": _rolled_up("k", AVG),
    "rollup_agg_one_key": _rolled_up("value", AVG, KEY),
    "rollup_agg_min": _rolled_up("value", MIN),
    "rollup_agg_staged": _beside("value", AVG),
    "rollup_agg_staged_min": _beside("k", MIN),
    "stored_aggregate": _beside("value", MAX, KEY),
    "stored_time_range": _stored_range(),
    "stored_latest_all": _stored_latest(),
    "stored_latest_keys": _stored_latest((3, 7, 7, -5, 11)),
    "stored_latest_many_keys": _stored_latest(tuple(range(-700, 700))),
    "connect_view": _connected(),
    "schema_text": _schema_text(),
    "stream_append": _stream_append(),
    "stream_downsample": _stream_downsample(),
    "stream_downsample_all": _stream_downsample(None),
    "agg_min_double": _aggregate("value", MIN),
    "odd_values_max": _odd(MAX, None),
    "odd_values_min": _odd(MIN, None),
    "odd_values_equal_zero": _odd(MAX, ValueFilter(_SAME, 0.0)),
    "odd_values_greater": _odd(MAX, ValueFilter(_GREAT, 10.0)),
    "csv_source": _csv(),
    "csv_good_lines": _csv_mixed(),
    "csv_rejected": _csv_rejected(),
}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items()}
