"""The engine: a catalog of tables under one root, their lifecycle, and the reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tempora.model import AggregateRequest, DownsampleRequest, LatestRequest, Names, RangeRequest
from tempora.operators import reads
from tempora.operators.rollup import rollup_aggregate
from tempora.sources.store import Table


class Engine:
    """Open over a root folder; any number of engines and threads can use one root."""

    def __init__(self, spark: SparkSession, root: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
            raise FileNotFoundError(root)
        self.spark, self._root, self._fs, self._at = spark, root, fs, path

    @property
    def data_path(self) -> str:
        return self._root

    def tables(self) -> list[str]:
        names = (f.getPath().getName() for f in self._fs.listStatus(self._at) if f.isDirectory())
        return sorted(x for x in names if not x.startswith(("_", ".")))

    def connect(self) -> list[str]:
        """Make every table of the root a view of its rows as they are now; returns their names."""
        names = self.tables()
        for name in names:
            self.read(name).createOrReplaceTempView(name)
        return names

    def create_table(self, name: str, schema: T.StructType, names: Names = Names(), **options) -> Table:
        return Table.create(self.spark, self._root, name, schema, names, **options)

    def table(self, name: str) -> Table:
        return Table(self.spark, self._root, name)

    def schema_text(self, name: str) -> str:
        return "\n".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted(self.table(name).schema, key=lambda f: f.name))

    def write(self, name: str, rows: DataFrame, dedupe: bool = False) -> None:
        self.table(name).append(rows, dedupe)

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def shutdown(self) -> None:
        """Compact every table and drop its view."""
        for name in self.tables():
            self.table(name).compact()
            self.spark.catalog.dropTempView(name)

    def latest(self, name: str, request: LatestRequest) -> DataFrame:
        """Answered from the last rows of each run and the rows in none."""
        now = self.table(name).snapshot()
        return reads.latest(now.candidates(), request, now.names, now.buckets)

    def time_range(self, name: str, request: RangeRequest) -> DataFrame:
        now = self.table(name).snapshot()
        return reads.time_range(now.scan(), request, now.names, now.buckets)

    def aggregate(self, name: str, request: AggregateRequest) -> DataFrame:
        """Whole blocks come from the roll-ups; rows are scanned at the range's edges and where they are in no run."""
        now = self.table(name).snapshot()
        if (blocks := now.rollup()) is None:
            return reads.aggregate(now.scan(), request, now.names, now.buckets)
        beside = now.staged() if now.state["staged"] else None
        return rollup_aggregate(now.settled(), blocks, now.state["block_ms"], request, now.names, now.buckets, beside)

    def downsample(self, name: str, request: DownsampleRequest) -> DataFrame:
        now = self.table(name).snapshot()
        return reads.downsample(now.scan(), request, now.names, now.buckets)
