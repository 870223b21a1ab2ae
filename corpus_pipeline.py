"""Documents to packed sequences: toxicity, exact copies, near copies, mix, packing.

Every stage but the last returns the columns of its documents, whatever they
are; doc_id, text and source count as null where they are missing.  Null and
repeated ids and equal rows are rows of their own in each decision.
"""

from __future__ import annotations

import re

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.exact_dedup import exact_dedup
from tempora.llm.mixing import mix_sources
from tempora.llm.near_dedup import near_dedup
from tempora.llm.packing import pack_documents
from tempora.llm.session import free_name, identified, kept
from tempora.llm.toxicity import fit, score_texts


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not find toxic."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, model, docs.columns).filter("score < 0.5").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts one row, that of the smallest doc_id."""
    rows, number = identified(docs)
    return _without(rows, number, exact_dedup(rows, number).filter("NOT kept"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row, that of the smallest doc_id."""
    rows, number = identified(docs)
    return _without(rows, number, near_dedup(rows, number).filter("NOT stays"), docs.columns)


def _without(rows: DataFrame, number: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of `rows` whose number is not among the rows of `gone`."""
    mark = free_name(rows, "gone")
    left = rows.join(gone.select(F.col("row").alias(mark)), F.col(f"`{number}`") == F.col(mark), "left_anti")
    return left.select(*(f"`{c}`" for c in columns))


_WORD = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")


def _first_words(text_at: int, words_at: int):
    """Each row but for its number of words: its text up to the end of that word."""

    def run(batches):
        for b in batches:
            texts = []
            for text, n in zip(b.column(text_at).to_pylist(), b.column(words_at).to_pylist(), strict=True):
                words = _WORD.finditer(text)
                for _ in range(n - 1):
                    next(words)
                texts.append(text[: next(words).end()])
            columns = [pa.array(texts, pa.string()) if i == text_at else b.column(i) for i in range(b.num_columns) if i != words_at]
            yield pa.RecordBatch.from_arrays(columns, names=[x for i, x in enumerate(b.schema.names) if i != words_at])

    return run


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; where it takes part of one, the first words of it, and n_chars is that part's."""
    rows, number = identified(docs)
    taken = mix_sources(rows, number).filter("taken > 0")
    names = [free_name(rows, x) for x in ("taken_row", "times", "words")]
    times = F.floor(F.col("taken") / F.col("size")).cast("int")
    taken = taken.select(F.col("row").alias(names[0]), times.alias(names[1]), (F.col("taken") % F.col("size")).alias(names[2]))
    joined = rows.join(taken, F.col(f"`{number}`") == F.col(names[0]))
    columns, copy = [F.col(f"`{c}`") for c in docs.columns], free_name(joined, "copy")
    whole = joined.filter(F.col(names[1]) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names[1])))).select(*columns)
    part = joined.filter(F.col(names[2]) > 0).select(*columns, names[2])
    at = [c.lower() for c in docs.columns].index("text") if any(c.lower() == "text" for c in docs.columns) else None
    if at is None:
        return whole
    part = part.withColumn(docs.columns[at], F.col(f"`{docs.columns[at]}`").cast("string"))
    cut = part.mapInArrow(_first_words(at, len(docs.columns)), part.select(*columns).schema)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length(F.col(f"`{docs.columns[at]}`")).cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(cut)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences of at most 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: A fitted model, links by similarity and packing have no SQL; a test holds the stages' rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = kept(docs)
    return docs
