"""A mix of sources at target weights by a low-discrepancy schedule.

Sources in order of code point, null last, have weights 5, 2, 1, repeating.
Together they share all words; a target stops at three times its source's size
and the rest is shared again by weight until no target is above.

Each source's documents, shuffled by hash, form one stream of words that repeats
when it ends.  The stream is cut into blocks of equal words.  The slots of the
schedule are the points frac(i * golden ratio) mapped through the cumulative
targets, so every stretch of the schedule is near the targets; a slot takes the
block whose number is its rank among its source's slots.  The last slot of a
source ends at the target, and where the points gave a source too few slots one
more slot takes the rest.

Null text has no words, and such documents are never taken.  Null doc_ids and
repeated rows are rows of their own; whole rows that are equal may change places
between runs, no others.  The list of sources, one short row each, is ordered in
one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import kept, with_columns

WEIGHTS, MOST = (5, 2, 1), 3
#: Words of a block at most, and slots of a schedule at least, as far as one word a slot allows: small inputs have
#: smaller blocks, so that the mix is as even.
BLOCK, SLOTS = 1024, 1 << 14
#: Slots ranked together, stretches of a source's hash order that are counted, and those counted together.
STRETCH, GATHER, SHELF = 1 << 14, 1 << 14, 1 << 7
GOLDEN = 0.6180339887498949


def source_targets(sizes: DataFrame) -> DataFrame:
    """(src, source_size, target) from `sizes` (src, source_size): one row for each source.

    A source is full when its size for each unit of weight is below the level
    that the rest then share; sources are ranked by it and the level is found
    with running sums.
    """
    place = Window.orderBy(F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(MOST)).withColumn("ratio", F.col("limit") / F.col("weight"))
    every = Window.partitionBy()
    upto = Window.orderBy("ratio", F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"words": F.sum("source_size").over(every), "heavy": F.sum("weight").over(every), "spent": F.sum("limit").over(upto), "used": F.sum("weight").over(upto)})
    # Full, if with this source and all before it full the level of the rest is no lower than its ratio.
    level_before = (F.col("words") - (F.col("spent") - F.col("limit"))) / (F.col("heavy") - (F.col("used") - F.col("weight")))
    rows = rows.withColumn("full", F.col("ratio") <= level_before)
    free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    rest = F.col("words") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0.0))
    return rows.select("src", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(rest * F.col("weight") / free).alias("target"))


def _earlier(column: str, by: str, *keys: str):
    """The sum of `column` over rows before this one in order of `by`."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _streams(docs: DataFrame) -> DataFrame:
    """Each document's first word in its source's shuffled stream; counted by stretches of the hash order."""
    bucket = F.pmod(F.col("h"), F.lit(GATHER))
    rows = docs.withColumn("bucket", bucket)
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words")).withColumn("shelf", F.floor(F.col("bucket") / SHELF))
    # In two steps, so that no window holds all stretches of a large source.
    shelves = sums.groupBy("src", "shelf").agg(F.sum("words").alias("words"))
    shelves = shelves.select(F.col("src").alias("of_"), F.col("shelf").alias("shelf_"), _earlier("words", "shelf", "src").alias("below"))
    inside = sums.withColumn("inside", _earlier("words", "bucket", "src", "shelf"))
    sums = inside.join(shelves, F.col("src").eqNullSafe(F.col("of_")) & (F.col("shelf") == F.col("shelf_")))
    sums = sums.select(F.col("src").alias("src_"), F.col("bucket").alias("bucket_"), (F.col("below") + F.col("inside")).alias("before"))
    order = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(sums, F.col("src").eqNullSafe(F.col("src_")) & (F.col("bucket") == F.col("bucket_")))
    return joined.withColumn("first", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))


def schedule(targets: DataFrame, words: int, block: int) -> DataFrame:
    """Slots (slot, source, block, words): `targets` has (source, from_share, to_share, target), `words` is their sum."""
    spark = targets.sparkSession
    slots = -(-words // block)
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0)) * 4096).alias("x"))
    # An equi-join on cells of [0, 1): a source meets only the cells that it covers.
    cells = targets.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from_share") * 4096), F.floor(F.col("to_share") * 4096))))
    met = points.withColumn("cell", F.floor("x")).join(cells, "cell").filter((F.col("x") >= F.col("from_share") * 4096) & (F.col("x") < F.col("to_share") * 4096))
    rows = met.select("slot", "source", "target", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    counts = rows.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1
    ranked = rows.withColumn("inside", rank).join(before.drop("n"), ["source", "stretch"]).select("slot", "source", (F.col("before") + F.col("inside")).alias("block"), F.lit(block).cast("long").alias("most"), F.round("target").cast("long").alias("end"))
    total = counts.groupBy("source").agg(F.sum("n").alias("block"))
    last = targets.join(total, "source", "left").withColumn("end", F.round("target").cast("long")).withColumn("n", F.coalesce("block", F.lit(0))).filter(F.col("n") * block < F.col("end"))
    last = last.select(F.lit(None).cast("long").alias("slot"), "source", F.explode(F.sequence("n", F.floor((F.col("end") - 1) / block))).alias("block"), F.lit(block).cast("long").alias("most"), "end")
    every = ranked.unionByName(last)
    return every.select("slot", "source", "block", F.least("most", F.col("end") - F.col("block") * block).alias("words")).filter("words > 0")


def mix_sources(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row for each of `docs` (doc_id, text, source): doc_id, row, size, source_size, target, taken.

    `row` names the column that tells rows apart; without it rows are numbered as they are read.
    """
    own = with_columns(docs, doc_id="long", text="string", source="string", **({row: "long"} if row else {}))
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    number = F.col(row) if row else F.monotonically_increasing_id()
    h = F.xxhash64("doc_id", "text", "source")
    rows = kept(own.select("doc_id", F.col("source").alias("src"), size.alias("size"), h.alias("h"), number.alias("row")))
    targets = kept(source_targets(rows.groupBy("src").agg(F.sum("size").alias("source_size"))))
    words = rows.agg(F.sum("size")).first()[0] or 0
    block = max(1, min(BLOCK, words // SLOTS))
    order = Window.orderBy(F.col("src").asc_nulls_last())
    numbered = targets.select("*", F.row_number().over(order).alias("source"), (F.sum("target").over(order) / float(words or 1)).alias("to_share"))
    ends = Window.orderBy("source")
    numbered = kept(numbered.withColumns({"from_share": F.coalesce(F.lag("to_share").over(ends), F.lit(0.0)), "to_share": F.when(F.lead("source").over(ends).isNull(), 1.0).otherwise(F.col("to_share"))}))
    slots = schedule(numbered.select("source", "target", "from_share", "to_share"), words, block)
    known = numbered.select(F.col("src").alias("src_"), "source", "source_size", "target")
    streams = kept(_streams(rows).select("doc_id", "src", "size", "row", "first").join(F.broadcast(known) if numbered.count() <= 100_000 else known, F.col("src").eqNullSafe(F.col("src_"))))
    # A document stands once in each pass over its source's stream that the target reaches.
    passes = F.ceil(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int")
    copies = streams.filter("size > 0 AND target >= 0.5").withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(passes, F.lit(1)) - 1)))
    copies = copies.withColumn("from", F.col("first") + F.col("pass") * F.col("source_size")).withColumn("to", F.col("from") + F.col("size"))
    pieces = copies.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    used = pieces.join(slots.select("source", "block", "words"), ["source", "block"])
    begin = F.col("block") * block
    overlap = F.least(F.col("to"), begin + F.col("words")) - F.greatest(F.col("from"), begin)
    taken = used.groupBy("row").agg(F.sum(F.greatest(overlap, F.lit(0))).alias("taken"))
    joined = streams.join(taken, "row", "left")
    return joined.select("doc_id", "row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op7_mix_sources(spark, sf_dir) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
