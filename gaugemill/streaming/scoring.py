"""Predictions scored as their files arrive, with running means for each task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "task_dir string, id string, label_space array<string>, gold_label string, predicted_index bigint, ts timestamp"

#: A line as it is kept: its prediction, its time and guess, which tell the last line, and its metric.
REVISION = "task_dir string, id string, at bigint, guess bigint, metric double"


def scored(spark: SparkSession, path: str) -> DataFrame:
    """A stream of label rows with their metric; a bad line fails the query."""
    rows = spark.readStream.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    guess = F.get("label_space", F.col("predicted_index").cast("int"))
    return rows.withColumn("primary_metric", F.coalesce((guess == F.col("gold_label")).cast("double"), F.lit(0.0)))


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Means by task and hour of the event; each prediction counts once, however often its line is delivered in time."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["task_dir", "id"])
    return once.groupBy(F.window("ts", "1 hour").alias("hour"), "task_dir").agg(F.count("*").alias("n"), F.avg("primary_metric").alias("mean"))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Works off what has arrived and stops; the file sink and its checkpoint make reruns add only what is new."""
    return stream.writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", checkpoint).format("parquet").start(out)


def revisions(stream: DataFrame) -> DataFrame:
    """The lines that say something of a prediction; lines without task, id or time are left out. Nothing is held between
    batches, so no memory grows with the ids seen."""
    kept = stream.where("task_dir is not null and id is not null and ts is not null")
    return kept.select("task_dir", "id", F.unix_micros("ts").alias("at"), F.coalesce("predicted_index", F.lit(-1)).cast("long").alias("guess"), F.col("primary_metric").alias("metric"))


def means(spark: SparkSession, out: str) -> DataFrame:
    """Count and mean of each task from the lines written so far: of a prediction's lines the one of the latest time counts, of
    equal times that with the larger guess, of equal guesses that with the larger metric; so the order in which lines come, and
    in what batch, makes no difference."""
    last = spark.read.schema(REVISION).parquet(out).groupBy("task_dir", "id").agg(F.max(F.struct("at", "guess", "metric")).alias("last"))
    return last.groupBy("task_dir").agg(F.count("*").alias("n"), F.avg("last.metric").alias("mean"))


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A log of JSON lines that a repeated batch doesn't double: each batch has a folder of its own, written anew if the batch is."""
    write = lambda batch, i: batch.write.mode("overwrite").json(f"{path}/batch={i}")
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()
