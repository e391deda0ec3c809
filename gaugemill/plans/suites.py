"""Whole suites: every builder's rows with prompt, sources, candidates and balance bucket, in the schema of task rows.

Items have id, label, audio_path, rich and short (what is said of them at length and in brief) besides the builders' columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import pools, sampling as S
from ..operators.order import settled
from ..sources import readers, schema, writers
from . import tasks

# The tasks of each tier in order, each with its recommended metrics; the primary one is accuracy but for
# rankings.
TIERS = {
    "tier1": (
        ("target_sound_grounding", "accuracy, recall@k"),
        ("fine_grained_acoustic_contrast", "accuracy, macro_f1"),
        ("foreground_event_focus", "accuracy, macro_f1"),
        ("acoustic_plausibility_ranking", "mAP, ndcg, top1_accuracy"),
        ("periodicity_aware_grounding", "accuracy, macro_f1"),
        ("onset_sharpness_grounding", "accuracy, macro_f1"),
        ("audio_text_hard_negative_matching", "accuracy, macro_f1"),
        ("causal_event_order", "accuracy, order_consistency"),
    ),
    "tier2": (
        ("phonic_target_grounding", "accuracy, recall@k"),
        ("speech_activity_grounding", "accuracy, precision, recall, f1"),
        ("speaker_count_grounding", "accuracy, macro_f1"),
        ("dyadic_matching", "accuracy, retrieval_hit_rate"),
        ("delivery_style_grounding", "accuracy, macro_f1"),
        ("turn_holding_continuation", "accuracy, choice_consistency"),
        ("speaker_count_aware_continuation", "accuracy, choice_consistency"),
        ("delivery_conditioned_continuation", "accuracy, choice_consistency"),
    ),
    "tier3": (
        ("event_window_grounding", "accuracy, retrieval_hit_rate"),
        ("coarse_event_order", "accuracy, order_consistency"),
        ("narrative_continuation_plausibility", "accuracy, choice_consistency"),
        ("long_context_event_retrieval", "recall@k, mAP, accuracy"),
        ("speaker_event_overlap", "accuracy, macro_f1"),
        ("sequential_causal_consistency", "accuracy, choice_consistency"),
    ),
}
# How ids begin, and the prompts that are the same for all rows of a task.
PREFIXES = {"tier1": "t", "tier2": "sv-t", "tier3": "t3-"}
PROMPTS = {
    "onset_sharpness_grounding": "Focus on the onset profile of this clip rather than its semantic category.",
    "dyadic_matching": "Which follow-up clip is more likely to come from the same people-centered scene or conversation context?",
    "turn_holding_continuation": "Given the current speech clip, choose the continuation text that best fits the same ongoing speaking turn or immediate local context.",
    "speaker_count_aware_continuation": "Choose the continuation text that best matches the current interaction scale (single-speaker versus multi-speaker or dyadic context).",
    "delivery_conditioned_continuation": "Choose the continuation text that best fits the delivery style of the current speech clip.",
    "narrative_continuation_plausibility": "Choose the continuation clip that most plausibly comes next in the same activity sequence.",
}


def specs(spark: SparkSession) -> DataFrame:
    """A row for each task: tier, task_dir, task_name, primary and recommended metrics, scope of comparison."""
    rows = [(tier, f"task_{n}_{name}", name, "top1_accuracy" if "ranking" in name else "accuracy", metrics, "within_tier") for tier, named in TIERS.items() for n, (name, metrics) in enumerate(named, 1)]
    return spark.createDataFrame(rows, "tier string, task_dir string, task_name string, primary_metric string, recommended_metrics string, comparison_scope string")


def _known(rows: DataFrame, items: DataFrame) -> DataFrame:
    """With the item itself as ``own``."""
    return rows.join(items.select("id", F.struct(*items.columns).alias("own")), "id")


def _met(rows: DataFrame, items: DataFrame, column: str = "options", told: tuple[str, ...] = ("label", "audio_path", "text")) -> DataFrame:
    """With the item itself, and as ``cands`` what is told of each candidate's item, in their order."""
    rows = settled(rows)  # read twice: drawing and shuffling cost more than writing
    each = rows.select("id", F.posexplode(column).alias("at", "candidate"))
    held = F.struct("at", F.col("candidate").cast("string").alias("id"), *told)
    named = each.join(items.select(F.col("id").alias("candidate"), *told), "candidate")
    return _known(rows, items).join(named.groupBy("id").agg(F.sort_array(F.collect_list(held)).alias("cands")), "id")


def _each(name: str) -> Column:
    return F.transform("cands", lambda c: c[name])


def _row(rows: DataFrame, *args, **columns) -> DataFrame:
    return rows.select(*_columns(*args, **columns))


def _columns(tier: str, task: str, prompt: Column | None = None, id_: Column | None = None, **columns: Column) -> list[Column]:
    n = [name for name, _ in TIERS[tier]].index(task) + 1
    fixed = PROMPTS.get(task)
    named = {"id": F.concat(F.lit(f"{PREFIXES[tier]}{n}-"), (F.col("id") if id_ is None else id_).cast("string")), "task_name": F.lit(task), "prompt": F.lit(fixed) if fixed else prompt if prompt is not None else F.lit(None).cast("string"), **columns}
    wanted = [f.split(" ") for f in schema.TASK_ROWS.split(", ")]
    filled = [named[c].cast(t).alias(c) if c in named else F.lit(None).cast(t).alias(c) for c, t in wanted]
    return [F.lit(tier).alias("tier"), F.lit(f"task_{n}_{task}").alias("task_dir"), *filled]


def _all(builders: dict[str, Callable[[], DataFrame]], only: list[str] | None) -> DataFrame:
    return reduce(DataFrame.unionByName, (build() for name, build in builders.items() if only is None or name in only))


def first_tier(items: DataFrame, seed: int = 42, only: list[str] | None = None) -> DataFrame:
    """The eight tasks on source items, or those in ``only``; ``items`` also has name, grp, flag. Mixes and sequences are named by the files that
    the renderer makes of them."""
    rich, short = F.col("own.rich"), F.col("own.short")
    audio = {"candidate_audio_paths": _each("audio_path"), "candidate_labels": _each("label"), "source_item_ids": _each("id")}
    fixed = {"query_audio_path": F.col("own.audio_path"), "source_item_ids": F.array("id"), "text_options": F.col("options"), "gold_index": F.col("gold_index")}
    least, most = cache(lambda: pools.by_name(items, 9, "least")), cache(lambda: pools.by_name(items, 3, "most"))  # several tasks draw from these
    met = lambda rows, column="options": _met(rows, items, column, ("label", "audio_path"))
    mixed = lambda: tasks.foreground(met(pools.picked(least(), 3, 1, seed + 2), "others"), ["own", "cands"])
    pair = lambda: met(tasks.causal_order(items, seed + 7).withColumn("pair", F.array("id", "candidate")), "pair")
    turned = F.col("gold_index") == 1
    ids, labels = _each("id"), _each("label")
    two = lambda values, joint, fix="": (F.concat(F.lit(fix), F.concat_ws(joint, values[0], values[1])), F.concat(F.lit(fix), F.concat_ws(joint, values[1], values[0])))
    both = lambda a, b: F.when(turned, F.array(b, a)).otherwise(F.array(a, b))
    path = lambda values: tuple(F.concat(v, F.lit(".wav")) for v in two(values, "__then__", "audio/task8_causal_order/"))
    phrase = lambda i: T.event_phrase(labels[i])
    return _all({
        "target_sound_grounding": lambda: _row(met(tasks.target_sound(items, seed, least())), "tier1", "target_sound_grounding", rich, gold_index=F.col("gold_index"), **audio),
        "fine_grained_acoustic_contrast": lambda: _row(met(tasks.acoustic_contrast(items, seed + 1, most())), "tier1", "fine_grained_acoustic_contrast", short, gold_index=F.col("gold_index"), **audio),
        "foreground_event_focus": lambda: _row(mixed(), "tier1", "foreground_event_focus", rich, F.concat_ws("-", "id", "gold_label"), gold_label=F.col("gold_label"), label_space=F.col("label_space"), distractor_label=labels[0], source_item_ids=F.array(F.col("id").cast("string"), ids[0]), query_audio_path=F.concat(F.lit("audio/task3_foreground_focus/"), F.concat_ws("-", "id", "gold_label"), F.lit(".wav"))),
        "acoustic_plausibility_ranking": lambda: _row(met(tasks.plausibility_ranking(items, seed + 3, least(), most()), "candidates"), "tier1", "acoustic_plausibility_ranking", rich, gold_ranking=F.col("gold_ranking"), **audio),
        "periodicity_aware_grounding": lambda: _row(_known(tasks.periodicity(items), items), "tier1", "periodicity_aware_grounding", rich, **fixed),
        "onset_sharpness_grounding": lambda: _row(_known(tasks.onset_sharpness(items), items), "tier1", "onset_sharpness_grounding", balance_bucket=F.col("balance_bucket"), **fixed),
        "audio_text_hard_negative_matching": lambda: _row(_known(tasks.hard_negatives(items, seed + 6), items), "tier1", "audio_text_hard_negative_matching", short, **fixed),
        "causal_event_order": lambda: _row(pair(), "tier1", "causal_event_order", F.concat(F.lit("First "), phrase(0), F.lit(", then "), phrase(1), F.lit(".")), F.concat_ws("-", "id", "candidate"), candidate_audio_paths=both(*path(ids)), candidate_labels=both(*two(labels, "_then_")), source_item_ids=ids, gold_index=F.col("gold_index"), balance_bucket=F.col("balance_bucket")),
    }, only)


def second_tier(clips: DataFrame, seed: int = 42, only: list[str] | None = None) -> DataFrame:
    """The eight tasks on clips; ``clips`` also has video, clip_index, delivery, duration, text, speakers, is_talking."""
    rich, short = F.col("own.rich"), F.col("own.short")
    gold = {"gold_index": F.col("gold_index")}
    fixed = {"query_audio_path": F.col("own.audio_path"), "source_item_ids": F.array("id"), "text_options": F.col("options"), **gold}
    right = F.get("cands", F.col("gold_index").cast("int"))["id"]
    wrong = F.get("cands", 1 - F.col("gold_index").cast("int"))["id"]
    pair = {"prompt_audio_path": F.col("own.audio_path"), "source_item_ids": F.array(F.col("id").cast("string"), right, wrong), **gold}
    texts = {"text_options": _each("text"), **pair}
    length = T.duration_bucket("own.duration")
    by_delivery = F.concat_ws("|", "own.delivery", length)
    by_speakers = F.concat_ws("|", T.speaker_count_label("own.speakers"), length)
    return _all({
        "phonic_target_grounding": lambda: _row(_met(tasks.phonic_target(clips, seed), clips), "tier2", "phonic_target_grounding", rich, candidate_audio_paths=_each("audio_path"), candidate_labels=_each("label"), source_item_ids=_each("id"), **gold),
        "speech_activity_grounding": lambda: _row(_known(tasks.speech_activity(clips), clips), "tier2", "speech_activity_grounding", rich, **fixed),
        "speaker_count_grounding": lambda: _row(_known(tasks.speaker_count(clips), clips), "tier2", "speaker_count_grounding", short, balance_bucket=F.col("balance_bucket"), **fixed),
        "dyadic_matching": lambda: _row(_met(tasks.dyadic(clips, seed + 3), clips), "tier2", "dyadic_matching", candidate_audio_paths=_each("audio_path"), candidate_labels=_each("label"), balance_bucket=by_delivery, **pair),
        "delivery_style_grounding": lambda: _row(_known(tasks.delivery_style(clips), clips), "tier2", "delivery_style_grounding", short, **fixed),
        "turn_holding_continuation": lambda: _row(_met(tasks.turn_holding(clips, seed + 5), clips), "tier2", "turn_holding_continuation", balance_bucket=by_delivery, **texts),
        "speaker_count_aware_continuation": lambda: _row(_met(tasks.continuation(clips, "speakers", "speaker_count_aware_continuation", seed + 6), clips), "tier2", "speaker_count_aware_continuation", balance_bucket=by_delivery, **texts),
        "delivery_conditioned_continuation": lambda: _row(_met(tasks.continuation(clips, "delivery", "delivery_conditioned_continuation", seed + 7), clips), "tier2", "delivery_conditioned_continuation", delivery_label=F.col("own.delivery"), balance_bucket=by_speakers, **texts),
    }, only)


def third_tier(rows: DataFrame, seed: int = 42, max_source_items: int | None = 4096, max_orders: int = 1024, only: list[str] | None = None) -> DataFrame:
    """The six tasks on long items, of which at most ``max_source_items`` (None: all) are taken, round by round over events; ``rows``
    also has event, secondary, scenario, mode, text (what happens in order)."""
    kept = rows if max_source_items is None else S.round_robin(rows.withColumn("_all", F.lit(0)), ["_all"], "event", ["id"], seed, max_source_items, small_first=False).select(*rows.columns)
    gold = {"gold_index": F.col("gold_index")}
    path = F.col("options.audio_path")
    audio = {"candidate_audio_paths": path, "candidate_item_ids": F.col("options.candidate").cast("array<string>"), **gold}
    texts = {"query_audio_path": F.col("own.audio_path"), "text_options": F.col("options"), **gold}
    paths = F.transform("options", lambda o: F.concat(F.lit("audio/task2_coarse_order/"), o, F.lit(".wav")))
    windows = {
        "event_window_grounding": lambda: _columns("tier3", "event_window_grounding", F.col("own.rich"), **audio),
        "long_context_event_retrieval": lambda: _columns("tier3", "long_context_event_retrieval", query_text=T.event_phrase("own.event"), **audio),
    }

    def both_windows(*names: str) -> DataFrame:
        """Tasks of the same candidates, drawn once."""
        each = F.array(*(F.struct(*windows[name]()) for name in names))
        return tasks.event_window(kept, seed, ("audio_path",)).select(F.explode(each).alias("row")).select("row.*")

    asked = [name for name in windows if only is None or name in only]
    return _all({
        **({asked[0]: lambda: both_windows(*asked)} if asked else {}),
        "coarse_event_order": lambda: _row(_known(tasks.coarse_order(kept, max_orders, seed + 1), kept), "tier3", "coarse_event_order", F.concat(F.lit("Which sequence better matches this long-form context: "), "own.text", F.lit("?")), candidate_audio_paths=paths, **gold),
        "narrative_continuation_plausibility": lambda: _row(tasks.narrative(kept, seed + 2, ("audio_path",)), "tier3", "narrative_continuation_plausibility", query_audio_path=F.col("own.audio_path"), **audio),
        "speaker_event_overlap": lambda: _row(_known(tasks.overlap(kept), kept), "tier3", "speaker_event_overlap", F.col("own.short"), **texts),
        "sequential_causal_consistency": lambda: _row(_known(tasks.sequential(kept, seed + 5), kept), "tier3", "sequential_causal_consistency", F.col("own.rich"), **texts),
    }, only)


def counts(rows: DataFrame) -> DataFrame:
    """Every task of the rows' tiers with its spec and its number of rows, none included."""
    n = rows.groupBy("tier", "task_dir").agg(F.count("*").alias("count"))
    of = specs(rows.sparkSession).join(F.broadcast(n.select("tier").distinct()), "tier")
    return of.join(n, ["tier", "task_dir"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def write(rows: DataFrame, path: str, seed: int = 42) -> dict:
    """The suite's folders and a document on its tasks; returns that document. Rows are counted as they were written."""
    spark = rows.sparkSession
    writers.suite(rows, f"{path}/rows")
    made = spark.read.option("basePath", f"{path}/rows").schema(f"{schema.TASK_ROWS}, tier string, task_dir string").json(f"{path}/rows")
    index = {f"{r.tier}/{r.task_dir}": r.asDict() for r in counts(made).collect()}  # a row for each of the fixed tasks
    document = {"seed": seed, "task_index": index, "count": sum(r["count"] for r in index.values())}
    writers.json_document(spark, document, f"{path}/metadata.json")
    return document


def copied(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the tasks in ``wanted`` (tier, task_dir), each with where it was selected from."""
    return rows.join(F.broadcast(wanted.select("tier", "task_dir").distinct()), ["tier", "task_dir"]).withColumn("selected_from", F.concat_ws("/", "tier", "task_dir"))


def copy_tasks(spark: SparkSession, root: str, wanted: DataFrame, out: str) -> dict[str, int]:
    """Writes the rows of the wanted tasks (tier, task_dir) of the suite at ``root``, beside each the task's own metadata, if
    it has any, with where it was selected from and how many rows it has; returns these numbers. Rows are counted as they
    were written, and read once."""
    rows = readers.suite(spark, root, file="{all.jsonl,part-*.json}").drop("row_ord", "file")
    writers.suite(rows.join(F.broadcast(wanted.select("tier", "task_dir").distinct()), ["tier", "task_dir"]), f"{out}/rows")
    made = spark.read.schema(f"{schema.TASK_ROWS}, tier string, task_dir string").option("basePath", f"{out}/rows").json(f"{out}/rows")
    n = {f"{r.tier}/{r.task_dir}": r["count"] for r in made.groupBy("tier", "task_dir").count().toLocalIterator()}  # a row for each task
    for task, count in n.items():
        path = f"{root}/{task}/metadata.json"
        known = json.loads(spark.read.text(path, wholetext=True).first()[0]) if readers.exists(spark, path) else {}
        writers.json_document(spark, known | {"selected_from": f"{root}/{task}", "count": count}, f"{out}/metadata/{task}.json")
    return n
