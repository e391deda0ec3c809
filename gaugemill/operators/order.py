"""Places over a whole table: rows numbered in an order without any task that holds more than its share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window, functions as F

SETTING = "spark.checkpoint.dir"
#: Rows up to which a small table is taken to every task.
CARRIED = 1 << 12


def shared_folder(spark) -> str:
    """The folder that all executors share; a temporary one where none is set and all runs on this machine, as in tests."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def settled(rows: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so what reads them twice reads the same, also after a lost executor."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """The rows dealt out by a key over all cores, for work that is heavy beside the rows' bytes: partitions of few bytes
    would else be joined to one task."""
    return rows.repartition(_cores(rows), *key)


def _cores(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def carried(rows: DataFrame) -> DataFrame:
    """The rows settled, and taken whole to every task of a join if they are few."""
    kept = settled(rows)
    return F.broadcast(kept) if kept.count() <= CARRIED else kept


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each row's place from 0 in the order of the columns ``order``.

    Rows are cut into ranges, sorted and numbered where they lie, and written; a range begins where the sizes of those
    before it end. Rows that agree in all of ``order`` are of one range, so the last column should tell rows apart.
    """
    numbered = settled(rows.repartitionByRange(_cores(rows), *order).sortWithinPartitions(*order).withColumn("_placed", F.monotonically_increasing_id()))
    cut = numbered.withColumn("_range", F.shiftright("_placed", 33)).withColumn("_placed", F.col("_placed").bitwiseAND(F.lit((1 << 33) - 1)))
    before = F.sum("_sized").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    begins = cut.groupBy("_range").agg(F.count("*").alias("_sized")).select("_range", F.coalesce(before, F.lit(0)).alias("_begin"))
    return cut.join(F.broadcast(begins), "_range").select(*rows.columns, (F.col("_begin") + F.col("_placed")).alias(name))
