"""Whole runs: evaluating a suite, comparing runs, building a validated subset, and the reports on them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import metrics as M, models, sampling as S, scoring as P


def evaluate(rows: DataFrame, make_model: Callable, empty_scores: str = "reference") -> DataFrame:
    """Predictions and primary metric of every row; ``rows`` has the task schema with tier and task_dir."""
    keep = ["tier", "task_dir", "task_name", "id", "gold_index", "gold_label", "gold_ranking", "label_space", "text_options", "candidate_audio_paths"]
    return P.score(models.predict(rows, make_model, keep), empty_scores)


def summary(scored: DataFrame, samples: int = 1000, seed: int = 42) -> DataFrame:
    """Count, mean and interval of each task."""
    return M.bootstrap_ci(scored, ["tier", "task_dir"], "primary_metric", ["id"], samples, seed)


def tiers(scored: DataFrame, samples: int = 1000, seed: int = 42) -> DataFrame:
    """Micro means by task, tier and over all, each with its interval, and the macro mean over tiers."""
    ends = M.level_intervals(scored, "tier", "task_dir", "primary_metric", ["id"], samples, seed).select("tier", "task_dir", "level", "ci_low", "ci_high")
    return M.with_columns(M.levels(scored, "tier", "task_dir", "primary_metric"), ends, ["tier", "task_dir", "level"], "left")


def task_report(scored: DataFrame, samples: int = 1000, seed: int = 42) -> DataFrame:
    """Of each task: count, mean and interval, and where its rows have labels, macro-averaged precision, recall and F1.

    ``scored`` has tier, task_dir, id, primary_metric, gold_label and predicted_label_text."""
    labels = M.macro_f1(scored.where("gold_label is not null"), ["tier", "task_dir"], "gold_label", "predicted_label_text")
    return summary(scored, samples, seed).join(labels, ["tier", "task_dir"], "left")


def report(scored: DataFrame, reference: DataFrame | None = None, samples: int = 1000, seed: int = 42) -> dict[str, DataFrame]:
    """One evaluation's whole report: ``tasks``, ``tiers`` and, beside another run's scores, ``comparison``."""
    out = {"tasks": task_report(scored, samples, seed), "tiers": tiers(scored, samples, seed)}
    if reference is not None:
        out["comparison"] = compare(scored, reference, samples, seed)
    return out


def compare(current: DataFrame, reference: DataFrame, samples: int = 1000, seed: int = 42) -> DataFrame:
    """Paired differences of two runs on the ids they share, by task and over all (``task_dir`` null); of repeated ids the
    last counts."""
    side = lambda df, name: M.deduplicated(df, ["task_dir", "id"], ["row_ord"], last=True).select("task_dir", "id", F.col("primary_metric").alias(name))
    both = side(current, "current").join(side(reference, "reference"), ["task_dir", "id"])
    both = both.withColumn("task_dir", F.explode(F.array("task_dir", F.lit(None).cast("string"))))
    return M.paired_comparison(both, ["task_dir"], "current", "reference", ["id"], samples, seed)


def positional(gold: DataFrame, predictions: DataFrame, by: list[str]) -> DataFrame:
    """Gold rows with the predictions in the same place of their task; what has none is counted as wrong."""
    place = lambda df: M.numbered(df, by, ["row_ord"]).drop("n")
    return place(gold).join(place(predictions).drop("row_ord", "id"), [*by, "i"], "left").withColumn("primary_metric", F.coalesce((F.col("predicted_index") == F.col("gold_index")).cast("double"), F.lit(0.0)))


def validated_subset(rows: DataFrame, most: int, least: int | None = None, n_attempts: int = 128, seed: int = 42, trials: int = 64, strategy: str = "balanced") -> tuple[DataFrame, DataFrame]:
    """(rows, diagnostics): each task's best sample of ``most`` rows, or as few as ``least``, that passes the gates; a task in
    which none does is dropped. Tasks with no more rows than asked for stay whole, and pass as they are."""
    least = most if least is None else least
    best = S.adaptive_search(rows, ["task_dir"], "gold_key", "id", "gold_index", "n_options", most, least, n_attempts, seed, trials, strategy)
    return S.samples_of(rows, ["task_dir"], "gold_key", "id", best.where("passed"), most, least, seed, strategy), best


def release(rows: DataFrame, targets: dict[str, int], n_attempts: int = 128, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows, manifest): a validated subset of every tier with its own size, the seed growing by tier, and a row for each
    task on what it was drawn from, how, and whether it was kept."""
    parts, notes = [], []
    for i, (tier, size) in enumerate(sorted(targets.items())):
        kept, best = validated_subset(rows.where(F.col("tier") == tier), size, None, n_attempts, seed + 1000 * i)
        parts.append(kept)
        notes.append(best.select(F.lit(tier).alias("tier"), "task_dir", F.lit(seed + 1000 * i).alias("seed"), F.lit(size).alias("max_per_task"), "n", "size", (F.col("attempt") + 1).alias("attempts"), "chance", "majority", "always_first", "random", "violation", F.col("passed").alias("kept")))
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, notes)


def allowed_tasks(rows: DataFrame, include: list[str] = (), exclude: list[str] = (), dropped: DataFrame | None = None) -> DataFrame:
    """Rows of tasks that are included (if any are named), not excluded and not dropped."""
    out = rows.where(F.col("task_name").isin(*include)) if include else rows
    out = out.where(~F.col("task_name").isin(*exclude)) if exclude else out
    return out if dropped is None else out.join(dropped.select("task_dir").distinct(), "task_dir", "left_anti")


def results_table(tasks: DataFrame, scores: DataFrame, names: list[str]) -> DataFrame:
    """Every task, a column for each model (blank where it has no result), and the best."""
    wide = scores.groupBy("tier", "task_dir").pivot("model", sorted(names)).agg(F.first("score"))
    best = M.best_model(scores, ["tier", "task_dir"])
    return tasks.join(wide, ["tier", "task_dir"], "left").join(best, ["tier", "task_dir"], "left").orderBy("tier", "task_dir")


def cue_priority(text, seconds, task: str, label) -> object:
    """Five for a good length, three for safe words, and a bonus for telling openings."""
    from ..functions.text import CLARIFY, CUE_POINTS, REPAIR, is_safe

    short = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) <= 3
    name, condition = {
        "explicit_repair_cue_detection": ("explicit_repair_cue", F.col(text).rlike(REPAIR)),
        "clarification_question_detection": ("clarification_question", F.col(text).rlike(CLARIFY)),
        "acknowledgment_cue_detection": ("short_acknowledgment", short),
    }[task]
    points = lambda key, holds: F.when(holds, CUE_POINTS[key]).otherwise(0)
    return points("length", F.col(seconds).between(12, 22)) + points("safe", is_safe(text)) + points(task, (F.col(label) == name) & condition)
