"""Writers of suites, tables and reports. Small reports are rendered on the driver from aggregates of a few rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def jsonl(df: DataFrame, path: str, mode: str = "overwrite", one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode(mode).option("ignoreNullFields", True).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def csv(df: DataFrame, path: str, columns: list[str] | None = None, quote_all: bool = False, mode: str = "overwrite") -> None:
    """With a header; ``columns`` fixes their order, and otherwise it is that of their names."""
    out = df.select(*(columns or sorted(df.columns)))
    out.coalesce(1).write.mode(mode).option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def csv_union(frames: list[DataFrame], path: str) -> None:
    """Tables of different columns under the sorted union of their names; missing values are empty."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    csv(out, path)


def suite(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A directory for each tier, where rows have one, and in it one for each task, all in one job."""
    df.write.mode(mode).partitionBy(*(["tier"] if "tier" in df.columns else []), "task_dir").json(path)


def not_yet_made(wanted: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """What is still to be done: rows whose key has no output."""
    return wanted.join(made.select(key).distinct(), key, "left_anti")


def json_document(spark: SparkSession, value: dict, path: str) -> None:
    """One indented document at a path of any file system that Spark writes to."""
    text_document(spark, json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True), path)


def text_document(spark: SparkSession, text: str, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def manifest(rows: DataFrame, root: str, suite_name: str, counts: DataFrame, failures: DataFrame | None = None) -> dict:
    """Rows, failures, and a document of counts; returns it. ``counts`` is (field, value, n) of ``loaders.manifest_counts``:
    what has no value stands in the document by itself, the values of a field (splits, styles: few) under its name."""
    spark = rows.sparkSession
    jsonl(rows, f"{root}/manifest")
    document = {"suite": suite_name, "count": 0, "audio_extraction_failures": 0, "audio_extraction_failure_log": f"{root}/audio_extraction_failures"}
    for r in counts.toLocalIterator():
        if r["value"] is None:
            document[r["field"]] = r["n"]
        else:
            document.setdefault(r["field"], {})[r["value"]] = r["n"]
    if failures is not None:
        jsonl(failures, document["audio_extraction_failure_log"])
        document["audio_extraction_failures"] = failures.count()
    json_document(spark, document, f"{root}/metadata.json")
    return document


def task_metadata(df: DataFrame, strategy: str, seed: int) -> DataFrame:
    """Per task: count, label distribution, seed and strategy."""
    labels = df.groupBy("task_dir", "gold_key").agg(F.count("*").alias("n"))
    each = labels.groupBy("task_dir").agg(F.sum("n").alias("count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("gold_key", "n")))).alias("label_distribution"))
    return each.withColumn("sample_seed", F.lit(seed)).withColumn("sampling_strategy", F.lit(strategy))


def markdown(df: DataFrame, title: str) -> str:
    """A table of a report, four decimals, blanks for nulls. A report's rows are few; they are read one by one."""
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in df.toLocalIterator())]) + "\n"
