"""Session, shared-folder and column helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in an Arrow batch: a batch of long texts then stays well below a worker's memory.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's spark.checkpoint.dir. Only a local master without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sigloom-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before."""
    return f"{shared_root(spark)}/sigloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the plan is cut, and no lost executor loses a row."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.written_at = path
    return read


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of df is called so (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def id_text(column: str | Column) -> Column:
    """An id as its decimal text, as the fold rules hash it."""
    return (column if isinstance(column, Column) else F.col(column)).cast("string")


def fold(column: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_text(column), F.lit("")).cast("binary")) % folds


def task_count(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def extended(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def least_by_hash(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """`rows` rows, the least by hash of the columns. Of a large table only a share of about twice as many rows, those with
    small hashes, is sorted, so that what one task gathers does not grow with the table or its partitions."""
    key, space = F.pmod(F.xxhash64(*columns), F.lit(1 << 40)), 1 << 40
    total = df.select(*columns).count()
    if total > 4 * rows:
        df = df.where(key < int(space * (2 * rows + 100) / total))
    return df.orderBy(key, *columns).limit(rows)
