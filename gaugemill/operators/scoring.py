"""Scores of predictions: label rows, index rows, retrieval rows and rankings, told apart by their gold columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A

RANKING_TASK = "acoustic_plausibility_ranking"


def gold_kind(task: Column, gold_label: Column, gold_index: Column) -> Column:
    """rank by the task's name, then label, then index."""
    return F.when(task == RANKING_TASK, "rank").when(gold_label.isNotNull(), "label").when(gold_index.isNotNull(), "index")


def gold_key(gold_label: Column, gold_ranking: Column, gold_index: Column, bucket: Column) -> Column:
    base = F.when(gold_label.isNotNull(), F.concat(F.lit("label:"), gold_label)).when(gold_ranking.isNotNull(), F.concat(F.lit("rank0:"), F.get(gold_ranking, F.lit(0)).cast("string"))).otherwise(F.concat(F.lit("index:"), gold_index.cast("string")))
    return F.when(F.coalesce(bucket, F.lit("")) != "", F.concat(base, F.lit("|bucket:"), bucket)).otherwise(base)


def predicted_ranking(ranking: Column, scores: Column, index: Column, n: Column, empty_scores: str = "reference") -> Column:
    """The ranking given, or that of the scores, or the index and the rest in order. An empty score list counts as given,
    and ranks nothing, unless ``empty_scores`` is ``use_index``."""
    given = scores.isNotNull() if empty_scores == "reference" else F.coalesce(F.size(scores) > 0, F.lit(False))
    return F.when(ranking.isNotNull(), ranking).when(given, A.ranking(scores)).otherwise(A.with_rest(F.coalesce(index, F.lit(0)), n))


def ranking_metrics(gold: Column, predicted: Column) -> dict[str, Column]:
    """top1_accuracy, exact_ranking_accuracy, mrr, ndcg with relevance n - rank."""
    n = F.size(gold)
    first, guess = F.get(gold, F.lit(0)), F.get(predicted, F.lit(0))
    relevance = F.transform(predicted, lambda x: F.coalesce((n - (A.position(gold, x) - 1)).cast("double"), F.lit(0.0)))
    ideal = A.dcg(F.transform(gold, lambda _, i: (n - i).cast("double")))
    return {
        "primary_metric": F.coalesce((first == guess).cast("double"), F.lit(0.0)),
        "exact_ranking_accuracy": (gold == predicted).cast("double"),
        "mrr": F.coalesce(1.0 / A.position(predicted, first), F.lit(0.0)),
        "ndcg": F.when(ideal > 0, A.dcg(relevance) / ideal).otherwise(F.lit(0.0)),
    }


def label_metrics(space: Column, index: Column, gold: Column) -> dict[str, Column]:
    """Accuracy; an index outside the label space is wrong."""
    guess = F.get(space, index.cast("int"))
    return {"primary_metric": F.coalesce((guess == gold).cast("double"), F.lit(0.0)), "predicted_label_text": guess}


def index_metrics(gold: Column, predicted: Column) -> dict[str, Column]:
    """Accuracy of the first index (0 if nothing is ranked), and retrieval metrics of the gold index."""
    rank = F.coalesce(A.position(predicted, gold), F.size(predicted) + 1)
    accuracy = (F.coalesce(F.get(predicted, F.lit(0)), F.lit(0)) == gold).cast("double")
    hit = F.transform(predicted, lambda x: (x == gold).cast("int"))
    return {
        "primary_metric": accuracy,
        "rank": rank.cast("double"),
        "mrr": 1.0 / rank,
        "average_precision": A.average_precision(hit),
        "ndcg": 1.0 / F.log2(rank + F.lit(1.0)),
        **{f"recall_at_{k}": (rank <= k).cast("double") for k in (1, 2, 3)},
    }


def score(rows: DataFrame, empty_scores: str = "reference") -> DataFrame:
    """Adds gold_kind, primary_metric and, for labels, predicted_label_text to rows of the task schema joined with their
    predictions."""
    n = F.size(F.coalesce("candidate_audio_paths", "text_options", "label_space"))
    ranked = predicted_ranking(F.col("predicted_ranking"), F.col("scores"), F.col("predicted_index"), n, empty_scores)
    kind = gold_kind(F.col("task_name"), F.col("gold_label"), F.col("gold_index"))
    metric = (
        F.when(kind == "rank", ranking_metrics(F.col("gold_ranking"), ranked)["primary_metric"])
        .when(kind == "label", label_metrics(F.col("label_space"), F.col("predicted_index"), F.col("gold_label"))["primary_metric"])
        .when(kind == "index", index_metrics(F.col("gold_index"), ranked)["primary_metric"])
    )
    said = F.when(kind == "label", label_metrics(F.col("label_space"), F.col("predicted_index"), F.col("gold_label"))["predicted_label_text"])
    return rows.withColumn("gold_kind", kind).withColumn("primary_metric", metric).withColumn("predicted_label_text", said)


def choice(text: Column, n: int) -> Column:
    """struct(predicted_index, predicted_ranking) of a free answer: the first valid letter, A if none; a ranking only
    from more than one letter."""
    from ..functions.text import letters

    valid = [chr(65 + i) for i in range(n)]
    found = F.transform(letters(text, valid), lambda c: (F.ascii(c) - 65).cast("long"))
    return F.struct(F.coalesce(F.get(found, F.lit(0)), F.lit(0)).alias("predicted_index"), F.when(F.size(found) > 1, found).alias("predicted_ranking"))
