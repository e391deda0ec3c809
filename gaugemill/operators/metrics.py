"""Aggregates over scored rows: levels, macro averages, bootstrap intervals, paired comparisons, baselines and gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.seeded import digest
from .resample import replicate_means

#: Guesses are even below this.
GUESSES = 1 << 40


def macro_f1(rows: DataFrame, by: list[str], gold: str, predicted: str) -> DataFrame:
    """Unweighted mean precision, recall and F1 over the labels seen on either side; no labels, no row."""
    sides = rows.select(*by, F.explode(F.array(
        F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold) == F.col(predicted)).cast("int").alias("t")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")),
    )).alias("s")).select(*by, "s.*").where("label is not null")
    each = sides.groupBy(*by, "label").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum(F.coalesce("t", F.lit(0))).alias("t"))
    precision = F.when(F.col("p") > 0, F.col("t") / F.col("p")).otherwise(F.lit(0.0))
    recall = F.when(F.col("g") > 0, F.col("t") / F.col("g")).otherwise(F.lit(0.0))
    f1 = F.when(F.col("t") > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return each.groupBy(*by).agg(F.avg(precision).alias("macro_precision"), F.avg(recall).alias("macro_recall"), F.avg(f1).alias("macro_f1"), F.count("*").alias("n_labels"))


def levels(rows: DataFrame, outer: str, inner: str, metric: str) -> DataFrame:
    """Counts and means by task, by suite and over all in one pass, and the mean of the suites' means."""
    micro = rows.groupingSets([[outer, inner], [outer], []], outer, inner).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.grouping_id().alias("level"))
    macro = rows.groupBy(outer).agg(F.avg(metric).alias("mean")).agg(F.count("*").alias("n"), F.avg("mean").alias("mean"))
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    return micro.select(outer, inner, "n", "mean", F.col("level").cast("long").alias("level")).unionByName(macro.select(none(outer), none(inner), "n", "mean", F.lit(9).cast("long").alias("level")))


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds the ordinal in its group (``i``, from 0) and the group's size (``n``)."""
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))


def bootstrap_ci(rows: DataFrame, by: list[str], value: str, order: list[str], samples: int = 100, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Mean and percentile interval (linear interpolation) of each group."""
    tail = (1 - confidence) / 2
    means = replicate_means(rows, by, value, order, samples, seed)
    ends = means.groupBy(*by).agg(F.percentile("mean", F.lit(tail)).alias("ci_low"), F.percentile("mean", F.lit(1 - tail)).alias("ci_high"))
    return with_columns(rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n")), ends, by)


def with_columns(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Joined on the columns, in which nulls are values; of tables of one row each if there are none."""
    if not by:
        return left.crossJoin(right)
    other = right.toDF(*(f"_{c}" if c in by else c for c in right.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return left.join(other, same, how).drop(*(f"_{c}" for c in by))


def at_levels(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Every row once by task, once by suite and once over all: ``level`` 0, 1 and 3, as grouping sets number them, and
    null in the columns that a level leaves out."""
    levels = F.array(*(F.struct(F.lit(n).cast("long").alias("level"), (F.col(outer) if n < 3 else F.lit(None).cast(rows.schema[outer].dataType)).alias(outer), (F.col(inner) if n == 0 else F.lit(None).cast(rows.schema[inner].dataType)).alias(inner)) for n in (0, 1, 3)))
    rest = [c for c in rows.columns if c not in (outer, inner)]
    return rows.select(*rest, F.explode(levels).alias("_l")).select(*rest, "_l.*")


def level_intervals(rows: DataFrame, outer: str, inner: str, metric: str, order: list[str], samples: int = 100, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Count, mean and interval by task, by suite and over all, in one pass."""
    return bootstrap_ci(at_levels(rows.select(outer, inner, metric, *order), outer, inner), [outer, inner, "level"], metric, order, samples, seed, confidence)


def level_comparison(rows: DataFrame, outer: str, inner: str, current: str, reference: str, order: list[str], samples: int = 100, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Paired differences with interval, p and effect size by task, by suite and over all, in one pass."""
    return paired_comparison(at_levels(rows.select(outer, inner, current, reference, *order), outer, inner), [outer, inner, "level"], current, reference, order, samples, seed, confidence)


def effect_size(value: str) -> Column:
    """Hedges' correction of mean over standard deviation; 0 for under two rows or no spread."""
    n, sd = F.count(value), F.stddev_samp(value)
    return F.when((n >= 2) & (sd > 1e-12), F.avg(value) / sd * (1 - 3.0 / F.greatest(F.lit(1), 4 * n - 5))).otherwise(F.lit(0.0))


def paired_comparison(rows: DataFrame, by: list[str], current: str, reference: str, order: list[str], samples: int = 100, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Difference of paired metrics with interval, two-sided p (smoothed by one, zeros on both sides) and effect size."""
    tail = (1 - confidence) / 2
    rows = rows.withColumn("difference", F.col(current) - F.col(reference))
    means = replicate_means(rows, by, "difference", order, samples, seed)
    above, below = F.count_if(F.col("mean") >= 0), F.count_if(F.col("mean") <= 0)
    ends = means.groupBy(*by).agg(
        F.percentile("mean", F.lit(tail)).alias("ci_low"),
        F.percentile("mean", F.lit(1 - tail)).alias("ci_high"),
        F.least(F.lit(1.0), 2.0 * F.least(above + 1, below + 1) / (F.count("*") + 1)).alias("p_value"),
    )
    seen = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("difference").alias("observed_difference"), effect_size("difference").alias("hedges_g"))
    return with_columns(seen, ends, by)


def deduplicated(rows: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first, or last, row of each key."""
    ends = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*ends))).where("_rn = 1").drop("_rn")


def _hits(trials: int) -> Column:
    """How many of the trials' guesses meet the gold; in batches, as so many terms of one expression run uncompiled."""

    def hits(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            guess, step, options, gold = (x.to_numpy(np.int64, copy=True) for x in batch)
            options = options[0] if len(options) and (options == options[0]).all() else options
            met = np.zeros(len(guess), np.int64)
            for _ in range(trials):
                met += guess % options == gold
                guess += step
                guess &= GUESSES - 1
            yield pd.Series(met)

    count = F.pandas_udf(hits, "long")
    return count("_a", "_b", "_options", "_gold")


def baselines(rows: DataFrame, by: list[str], key: str, gold: str, n_options: str, trials: int = 64, seed: int = 42) -> DataFrame:
    """Chance (of the first row), majority, always-first and random accuracy of each task; ``key`` is the row order.

    Majority ties go to the label that comes first as text. Random accuracy is the mean over seeded trials, whose guesses
    are linear in the trial's number, modulo GUESSES: one digest a row serves all.
    """
    counts = rows.groupBy(*by, gold).agg(F.count("*").alias("c"))
    top = counts.groupBy(*by).agg(F.min_by(F.struct("c", gold), F.struct(-F.col("c"), F.col(gold).cast("string"))).alias("top"))
    hashed = digest(seed, *map(F.col, by), F.col(key))
    part = lambda i: F.conv(F.substring(hashed, i, 10), 16, 10).cast("long")
    asked = rows.withColumn("_a", part(1)).withColumn("_b", part(11)).withColumn("_options", F.greatest(F.lit(1), F.col(n_options)).cast("long")).withColumn("_gold", F.coalesce(F.col(gold).cast("long"), F.lit(-1)))
    out = asked.withColumn("_hits", F.when(F.col(gold).isNotNull(), _hits(trials))).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min_by(F.lit(1.0) / F.greatest(F.lit(1), F.col(n_options)), F.col(key)).alias("chance"),
        F.avg((F.col(gold) == 0).cast("double")).alias("always_first"),
        (F.sum("_hits") / (F.count("*") * trials)).alias("random"),
    )
    return out.join(top, by).select(*by, "n", "chance", (F.col("top.c") / F.col("n")).alias("majority"), "always_first", "random")


def gates(diagnostics: DataFrame, majority: float = 0.10, first: float = 0.10, random: float = 0.05) -> DataFrame:
    """Adds passed (no baseline beyond chance by more than its margin) and violation (the largest excess)."""
    over = [F.col(c) - (F.col("chance") + F.lit(m)) for c, m in (("majority", majority), ("always_first", first), ("random", random))]
    violation = F.greatest(F.lit(0.0), *over)
    return diagnostics.withColumn("violation", violation).withColumn("passed", violation <= 0)


def best_model(scores: DataFrame, by: list[str], model: str = "model", value: str = "score") -> DataFrame:
    """The best score and its model, ties to the first name; a missing score is none."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), F.col(model))
    return scores.where(F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*by, F.col(model).alias("best_model"), F.col(value).alias("best_score"))


def metric_means(scored: DataFrame, by: list[str], skip: tuple[str, ...] = ("gold", "predicted")) -> DataFrame:
    """Count and mean of every metric of a map column ``metrics``; values that aren't numbers don't count."""
    each = scored.select(*by, F.explode("metrics").alias("metric", "value")).where(~F.col("metric").isin(*skip))
    return each.withColumn("value", F.col("value").try_cast("double")).where("value is not null").groupBy(*by, "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def label_histogram(rows: DataFrame, label: str, flag: Column) -> DataFrame:
    """Rows of each label and how many of them the flag holds for."""
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.sum(flag.cast("long")).alias("flagged"))
