"""What the corpus operators share: reading tables, staging, ranking."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one Python task should hold at a time.
CHUNK_BYTES = 24 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="chronoweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the 0-based global position in the given order without gathering the rows in one task.

    Rows are range-partitioned and staged; only one count per partition is combined.
    """
    pid, idx = f"_{name}_pid", f"_{name}_idx"
    placed = stage(df.repartitionByRange(*order).withColumn(pid, F.spark_partition_id()), "ranked")
    counts = placed.groupBy(pid).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(pid, (F.sum("_n").over(Window.orderBy(pid)) - F.col("_n")).alias("_before"))
    local = placed.withColumn(idx, F.row_number().over(Window.partitionBy(pid).orderBy(*order)) - 1)
    return local.join(before, pid).withColumn(name, (F.col("_before") + F.col(idx)).cast("long")).drop(pid, idx, "_before")


def free_name(columns: list[str], name: str) -> str:
    """name, or name with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def arrow_schema(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
