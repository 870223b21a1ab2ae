"""A table on any file system that Spark reads: appended parts, compacted runs, one manifest.

Every change writes new files first and then a new numbered manifest, which
appears whole or not at all and which no two writers can both create: on one
machine's disk by a link, elsewhere by a rename that does not overwrite, as HDFS
has it.  On object stores without such a rename only one writer at a time is safe.

A snapshot is what one manifest names: a request takes one and reads nothing
else, so rows are readable as soon as append() returns, and neither an append nor
a compaction shows half.

compact() makes one run of the appended parts: rows by bucket, sorted by key and
time, their roll-up and the last row of each key.  Runs of one level are merged
into the next when there are FAN of them, so a row is rewritten once for each
level and a large base stays as it is.  Files that a change left out are removed
when they were out for `retain` seconds, by which readers must have ended.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.predicates import bucket_of
from tempora.model import BUCKET, OWN, Names
from tempora.operators.reads import last_rows
from tempora.operators.rollup import build_rollup

#: Tries of a writer whose manifest number another writer took, runs of a level that become one, appended parts that
#: become a run, and manifests that stay.
TRIES, FAN, STAGED, MANIFESTS = 200, 4, 256, 16
#: Seconds for which left-out files stay.
RETAIN = 3600


@dataclass(frozen=True)
class Snapshot:
    """What one manifest names."""

    table: Table
    number: int
    state: dict

    @property
    def names(self) -> Names:
        return Names(self.state["key"], self.state["ts"])

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.state["schema"])

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    @property
    def _wide(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])

    def _scan(self, schema: T.StructType, paths: list[str]) -> DataFrame:
        """Rows of folders, each on its own, since each holds bucket folders of its own."""
        spark = self.table.spark
        found = [spark.read.schema(schema).parquet(f"{self.table.path}/{p}") for p in paths]
        return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)

    def settled(self, paths: list[str] | None = None) -> DataFrame:
        """Rows of runs."""
        return self._scan(self._wide, [f"{r['path']}/rows" for r in self.state["runs"]] if paths is None else paths)

    def staged(self) -> DataFrame:
        """Rows of parts that are in no run yet."""
        spark, paths = self.table.spark, [f"{self.table.path}/{p}" for p in self.state["staged"]]
        if not paths:
            return spark.createDataFrame([], self._wide)
        rows = spark.read.schema(self.schema).parquet(*paths)
        return rows.withColumn(BUCKET, bucket_of(F.col(self.state["key"]), self.buckets))

    def scan(self) -> DataFrame:
        """All rows and their bucket, a filter on which skips folders."""
        if not self.state["staged"]:
            return self.settled()
        return self.settled().unionByName(self.staged()) if self.state["runs"] else self.staged()

    def read(self) -> DataFrame:
        """All rows, the table's columns only."""
        return self.scan().select(self.schema.names)

    def rollup(self) -> DataFrame | None:
        """Blocks of the rows in runs."""
        paths = [f"{self.table.path}/{r['path']}/rollup" for r in self.state["runs"]]
        found = [self.table.spark.read.parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, found) if found else None

    def candidates(self) -> DataFrame:
        """Rows of which one is the latest of each key: the last ones of each run, and all that are in none."""
        last = self._scan(self._wide, [f"{r['path']}/last" for r in self.state["runs"]])
        return last.unionByName(self.staged()) if self.state["staged"] else last


class Table:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, part: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}" if part else self.path)

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, schema: T.StructType, names: Names = Names(), buckets: int = 64, block_ms: int = 3_600_000) -> Table:
        table = cls(spark, root, name)
        for column in (names.key, names.ts):
            schema[column]
        kinds = (T.StringType, T.IntegerType, T.LongType, T.DoubleType, T.TimestampType, T.TimestampNTZType)
        if bad := [f.name for f in schema if not isinstance(f.dataType, kinds)]:
            raise ValueError(f"columns of other types than string, integer and double: {bad}")
        if bad := [f.name for f in schema if f.name.lower().startswith(OWN)]:
            raise ValueError(f"columns may not begin with {OWN!r}: {bad}")
        state = {"schema": json.loads(schema.json()), "key": names.key, "ts": names.ts, "buckets": buckets, "block_ms": block_ms}
        if table._numbers() or not table._write(0, state | {"runs": [], "staged": [], "left": [], "streams": {}}):
            raise ValueError(f"{name!r} exists")
        return table

    def _numbers(self) -> list[int]:
        """Numbers of the manifests, the newest last."""
        folder = self._path("_manifest")
        if not self._fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def _write(self, number: int, state: dict) -> bool:
        """Make a manifest appear whole; False if the number is taken."""
        aside, place = self._path(f"_manifest/.{uuid.uuid4().hex}"), self._path(f"_manifest/{number:012d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(aside.toUri().getPath(), place.toUri().getPath())
                return True
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(context.makeQualified(aside), context.makeQualified(place), none)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(aside, False)

    def snapshot(self) -> Snapshot:
        for _ in range(TRIES):
            if not (numbers := self._numbers()):
                break
            try:
                source = self._fs.open(self._path(f"_manifest/{numbers[-1]:012d}.json"))
            except Exception as e:
                # So many changes since the listing that this one is gone.
                if "FileNotFound" in str(e):
                    continue
                raise
            try:
                return Snapshot(self, numbers[-1], json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")))
            finally:
                source.close()
        raise FileNotFoundError(self.path)

    def _change(self, change) -> bool:
        """Write the manifest that follows the newest; `change` gives its state, or None if there is nothing to do."""
        for turn in range(TRIES):
            now = self.snapshot()
            if (state := change(dict(now.state))) is None:
                return False
            if self._write(now.number + 1, state):
                for old in self._numbers()[:-MANIFESTS]:
                    self._fs.delete(self._path(f"_manifest/{old:012d}.json"), False)
                return True
            time.sleep(min(0.5, 0.005 * (turn + 1)))
        raise RuntimeError("too many writers at once")

    @property
    def schema(self) -> T.StructType:
        return self.snapshot().schema

    def read(self) -> DataFrame:
        return self.snapshot().read()

    def append(self, rows: DataFrame, dedupe: bool = False, once: tuple[str, int] | None = None) -> None:
        """Add rows, each with all columns.  dedupe: of rows with one key and time, one stays.

        once: a stream's name and the number of its batch; a batch that was added before, or an earlier one, is not added again.
        """
        now = self.snapshot()
        schema = now.schema
        if set(rows.columns) != set(schema.names):
            raise ValueError(f"rows need exactly the columns {schema.names}")
        if once and now.state["streams"].get(once[0], -1) >= once[1]:
            return
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        if dedupe:
            rows = rows.dropDuplicates([now.names.key, now.names.ts])
        part = f"staged/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{part}")

        def added(s: dict) -> dict | None:
            if once and s["streams"].get(once[0], -1) >= once[1]:
                return None
            return s | {"staged": [*s["staged"], part], "streams": s["streams"] | ({once[0]: once[1]} if once else {})}

        if not self._change(added):
            self._fs.delete(self._path(part), True)
        elif len(now.state["staged"]) + 1 >= STAGED:
            self.compact()

    def _run(self, now: Snapshot, rows: DataFrame, level: int) -> dict:
        """Write rows (with their bucket) as one run.

        Ranges of (bucket, key, time) are dealt out, so a key with very many rows is not one task's.
        """
        path, names = f"run/{uuid.uuid4().hex}", now.names
        order = [BUCKET, names.key, names.ts]

        def put(df: DataFrame, part: str) -> None:
            df.write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.path}/{path}/{part}")

        put(rows.repartitionByRange(*order).sortWithinPartitions(*order), "rows")
        settled = now.settled([f"{path}/rows"])
        put(build_rollup(settled, names, now.state["block_ms"], BUCKET), "rollup")
        last = last_rows(settled.select(now.schema.names), names)
        put(last.withColumn(BUCKET, bucket_of(F.col(names.key), now.buckets)), "last")
        return {"path": path, "level": level}

    def _replaced(self, key: str, gone: list, run: dict) -> bool:
        """A manifest with `run` in place of some parts or runs; if they are no longer there, nothing changes."""
        at = time.time()

        def change(s: dict) -> dict | None:
            if any(x not in s[key] for x in gone):
                return None
            left = [*s["left"], *([x if key == "staged" else x["path"], at] for x in gone)]
            rest = {key: [x for x in s[key] if x not in gone], "left": left}
            runs = [*(rest["runs"] if key == "runs" else s["runs"]), run]
            return s | rest | {"runs": runs}

        if self._change(change):
            return True
        self._fs.delete(self._path(run["path"]), True)
        return False

    def compact(self, retain: float = RETAIN) -> None:
        """Appended parts become a run, FAN runs of a level one of the next; files left out `retain` seconds ago go."""
        now = self.snapshot()
        if staged := now.state["staged"]:
            self._replaced("staged", staged, self._run(now, now.staged(), 0))
        while True:
            now = self.snapshot()
            levels: dict[int, list] = {}
            for run in now.state["runs"]:
                levels.setdefault(run["level"], []).append(run)
            full = [x for x in levels.values() if len(x) >= FAN]
            if not full:
                break
            rows = now.settled([f"{r['path']}/rows" for r in full[0]])
            if not self._replaced("runs", full[0], self._run(now, rows, full[0][0]["level"] + 1)):
                break
        old = [p for p, at in now.state["left"] if at <= time.time() - retain]
        for p in old:
            self._fs.delete(self._path(p), True)
        if old:
            self._change(lambda s: s | {"left": [x for x in s["left"] if x[0] not in old]})
