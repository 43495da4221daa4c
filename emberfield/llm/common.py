"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these (space and \t \n \v \f \r).
SPACES = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is set only in local mode where none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/emberfield/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


#: Rows and bytes of an Arrow batch, the same for all operators: plans run later than they are built.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, so that a Python worker's memory stays bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows; empty ones are left out."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if sum(map(len, held)):
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


#: Name of the column that carries a row's other columns through an operator, and those that operators read.
REST = "_rest"
READ = ("doc_id", "text", "lang", "source")


def rest_packed(docs: DataFrame, *without: str) -> DataFrame:
    """The columns that operators read, and all columns once more in one struct, to be carried with the row.

    Other columns are in the struct alone, so their names clash with none.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in without] or [F.lit(0).alias("_")]
    return docs.select(*(c for c in docs.columns if c in READ), F.struct(*rest).alias(REST))


def rest_unpacked(df: DataFrame, docs: DataFrame, **new: str) -> DataFrame:
    """The columns of docs from the carried struct; those in ``new`` from the named column."""
    return df.select(*((F.col(new[c]) if c in new else F.col(REST).getField(c)).alias(c) for c in docs.columns))
