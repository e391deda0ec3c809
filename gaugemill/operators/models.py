"""Models as columns: seeded random and heuristic ones natively, others as functions over batches of rows."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A, seeded, text as T

PREDICTION = "predicted_index long, scores array<double>, predicted_ranking array<long>"


def random_scores(n: Column, seed: int, *key: Column) -> Column:
    """An even score in [0, 1) for each option."""
    spots = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: seeded.draw(F.lit(1 << 30), seed, *key, i) / F.lit(float(1 << 30)))


# The weights in the two scores below, and the words of options that they go with.
def heuristic_candidate_score(prompt: Column, label: Column, rms: Column, onset: Column, with_text: bool = True) -> Column:
    """Words in common with the prompt, loudness and sharpness."""
    heard = 0.2 * rms + 0.1 * onset
    return (2.0 * T.overlap(T.tokens(prompt), T.tokens(label)) if with_text else F.lit(0.0)) + heard


def heuristic_option_score(task: Column, prompt: Column, option: Column, rms: Column, onset: Column, periodicity: Column) -> Column:
    """Words in common, and what the sound says for an option of the task."""
    low, sharp = F.lower(option), F.least(F.lit(1.0), onset * 8.0)
    has = lambda words, value: F.when(low.rlike(words), value).otherwise(0.0)
    heard = (
        F.when(task == "periodicity_aware_grounding", has("repetitive|rhythmic", 2.0 * periodicity) + has("single|impact", 2.0 * (1.0 - periodicity)))
        .when(task == "onset_sharpness_grounding", has("sharp|sudden", 2.0 * sharp) + has("diffuse|smeared", 2.0 * (1.0 - sharp)))
        .when(task == "foreground_event_focus", F.when(low == "foreground", 1.8 * F.least(F.lit(1.0), rms * 6.0)).when(low == "background", F.least(F.lit(1.0), rms * 4.0)).when(low == "absent", 1.2 * F.greatest(F.lit(0.0), 1.0 - onset * 8.0)).otherwise(0.0))
        .otherwise(0.0)
    )
    return 1.5 * T.overlap(T.tokens(prompt), T.tokens(option)) + heard


def cosine_scores(query: Column, candidates: Column) -> Column:
    """Cosines of a query's embedding with those of its candidates; 0 where a side is zero."""
    norm = lambda v: F.sqrt(A.dot(v, v))
    return F.transform(candidates, lambda c: F.coalesce(A.dot(query, c) / F.nullif(norm(query) * norm(c), F.lit(0.0)), F.lit(0.0)))


@dataclass
class Native:
    """A model that is a column: the scores of a row's options."""

    scores: Column


def predict(rows: DataFrame, model: Native | Callable[[], Callable[[dict], dict]], keep: list[str]) -> DataFrame:
    """Runs a model over the rows. A native one is a column, whose best score is taken; another is called once a task, and
    what it returns maps a row to a prediction."""
    if isinstance(model, Native):
        scored = rows.withColumn("_scores", model.scores)
        return scored.select(*keep, A.argmax(F.col("_scores")).alias("predicted_index"), F.col("_scores").alias("scores"), F.lit(None).cast("array<bigint>").alias("predicted_ranking"))
    schema = f"{rows.select(*keep).schema.toDDL()}, {PREDICTION}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = model()
        for pdf in batches:
            made = [ask(r) for r in pdf.to_dict("records")]
            yield pdf[keep].assign(**{c: [m.get(c) for m in made] for c in ("predicted_index", "scores", "predicted_ranking")})

    return rows.mapInPandas(run, schema)


def random_model(seed: int = 42, key: str = "id") -> Native:
    """Even scores for the options of each row."""
    return Native(random_scores(F.size(F.coalesce("candidate_audio_paths", "text_options", "label_space")), seed, F.col(key)))


def hybrid_model() -> Native:
    """The heuristic scores, of options by ``query_features`` (rms, onset, periodicity), or else of candidates by their
    labels and ``candidate_features`` (rms, onset)."""
    heard = F.col("query_features")
    options = F.transform(F.coalesce("text_options", "label_space"), lambda o: heuristic_option_score(F.col("task_name"), F.col("prompt"), o, heard["rms"], heard["onset"], heard["periodicity"]))
    candidates = F.zip_with("candidate_labels", "candidate_features", lambda c, f: heuristic_candidate_score(F.col("prompt"), c, f["rms"], f["onset"]))
    return Native(F.when(F.coalesce("text_options", "label_space").isNotNull(), options).otherwise(candidates))


def command(argv: list[str]) -> Callable[[], Callable[[dict], dict]]:
    """A model in another process that reads a JSON row a line and answers likewise; one process a task."""
    def make() -> Callable[[dict], dict]:
        process = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)

        def ask(row: dict) -> dict:
            process.stdin.write(json.dumps(row, default=lambda v: v.tolist()) + "\n")
            process.stdin.flush()
            answer = json.loads(process.stdout.readline())
            if not {"predicted_index", "scores", "predicted_ranking"} & answer.keys():
                raise ValueError("the answer holds no prediction")
            return answer

        return ask

    return make


BACKENDS: dict[str, Callable] = {}


def backend(name: str, **options):
    """A registered model factory; an unknown name is an error."""
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name}")
    return BACKENDS[name](**options)


BACKENDS["command"] = lambda argv: command(argv)
BACKENDS["first"] = lambda: lambda: lambda row: {"predicted_index": 0}
BACKENDS["random"] = random_model
BACKENDS["hybrid"] = hybrid_model
