"""What the operators share: session settings, the shared folder, written intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import courierlens
from courierlens.sources.session import apply_settings

#: Rows per Arrow batch sent to Python, so that a batch of long texts stays within a worker's memory.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings, and this package on the Python path of every executor."""
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if not getattr(context, "_courierlens_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(courierlens.__file__)))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "courierlens"), "zip", root, "courierlens")
        context.addPyFile(archive)
        context._courierlens_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor and the driver reach.

    Only a session without that setting (local mode, tests) gets a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="courierlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, lineage cut."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fresh(columns: Sequence[str], name: str) -> str:
    """``name``, lengthened until no column has it (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame, rows: int) -> DataFrame:
    """A small table of work items, one item per task."""
    return df.repartition(max(1, rows))


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds each row's place (from 1) in the whole table. Rows are range-partitioned by ``order``; a task ranks its range."""
    part = fresh([*df.columns, name], "_part")
    ranged = saved(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    starts = running_total(ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_rows")), [part], "_rows", "_start")
    starts = starts.select(F.col(part).alias("_of"), "_start")
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.withColumn(name, place).join(starts, F.col(part) == F.col("_of")).select(*df.columns, (F.col(name) + F.col("_start")).alias(name))


def running_total(df: DataFrame, order: Sequence[str], size: str, name: str) -> DataFrame:
    """Sum of ``size`` over the rows before each row. For tables with a row per file or per bucket."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")))


def valid_vector(vector: Column) -> Column:
    """True for vectors of finite components that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
