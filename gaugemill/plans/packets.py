"""Packets for people: the first items of every task without their answers, and the answers apart."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# What raters of cues are asked, and what they fill in.
CUE_PROMPTS = {
    "acknowledgment_cue_detection": "Listen to the clip. Is the speaker mainly giving a short acknowledgment such as okay, yeah, or mm-hmm?",
    "clarification_question_detection": "Listen to the clip. Does the speaker ask a semantic or referential clarification question?",
    "explicit_repair_cue_detection": "Listen to the clip. Does the speaker explicitly signal a hearing or understanding problem?",
}
ANSWERABLE = "Could you make this judgment from audio alone?"
CUE_FORM = ("chosen_answer", "answerable_from_audio_yes_no", "confidence_1_5", "difficulty_1_5", "comments")
CUE_QUOTA = 6
# How raters are told to judge each task, or any other.
GUIDANCE = {
    "target_sound_grounding": "Listen to all candidate clips and choose the one that best matches the written event description.",
    "fine_grained_acoustic_contrast": "Listen to the candidate clips and choose the better acoustic match for the prompt.",
    "foreground_event_focus": "Listen to the query clip and decide whether the target event is foreground, background, or absent.",
    "acoustic_plausibility_ranking": "Rank the candidate clips from most plausible to least plausible given the prompt.",
    "periodicity_aware_grounding": "Listen to the query clip and choose whether it sounds more repetitive/rhythmic or more abrupt/impact-like.",
    "onset_sharpness_grounding": "Listen to the query clip and judge whether the sound onset is sharp or diffuse.",
    "audio_text_hard_negative_matching": "Listen to the query clip and choose the text description that best matches it.",
    "phonic_target_grounding": "Listen to all candidate clips and choose the one that best matches the people-centered speech prompt.",
    "speaker_count_grounding": "Listen to the query clip and decide whether it contains one dominant speaker or multiple speakers.",
    "dyadic_matching": "Listen to the prompt clip and the candidate clips, then choose the candidate most likely to come from the same conversational scene.",
    "delivery_style_grounding": "Listen to the query clip and pick the delivery style that best matches the speech.",
    "turn_holding_continuation": "Listen to the prompt clip and choose the continuation text that best fits the same ongoing turn.",
    "speaker_count_aware_continuation": "Listen to the prompt clip and choose the continuation text that best matches the single-speaker or multi-speaker interaction scale.",
    "delivery_conditioned_continuation": "Listen to the prompt clip and choose the continuation text that best matches the delivery style.",
    "event_window_grounding": "Listen to all candidate clips and choose the one that best matches the long-form event prompt.",
    "narrative_continuation_plausibility": "Listen to the query clip and choose the continuation text that best fits what plausibly happens next.",
    "long_context_event_retrieval": "Given the text query, listen to the candidate clips and choose the best audio match.",
    "sequential_causal_consistency": "Listen to the query clip and choose the text option that best matches the causal order implied by the audio.",
}
OTHER_GUIDANCE = "Listen carefully and choose the option that best matches the task prompt."
RECORDED = ("chosen answer", "confidence from 1 to 5", "difficulty from 1 to 5", "optional free-text comments")


def answer() -> Column:
    """The gold label, else the gold ranking from 1 (``2 > 1 > 3``), else the gold place from 1."""
    ranking = F.array_join(F.transform("gold_ranking", lambda i: (i + 1).cast("string")), " > ")
    return F.coalesce("gold_label", F.when(F.size("gold_ranking") > 0, ranking), (F.col("gold_index") + 1).cast("string"))


def chosen(rows: DataFrame, per_task: int, by: str | None = None) -> DataFrame:
    """The first ``per_task`` rows of every task (or of every value of ``by`` in it), by id, with ``example`` from 1; rows
    without a task or of dropped tasks must be left out before."""
    within = ["tier", "task_dir", *([by] if by else [])]
    w = Window.partitionBy(*within).orderBy("id")
    return rows.withColumn("example", F.row_number().over(w)).where(F.col("example") <= per_task)


def items(picked: DataFrame) -> DataFrame:
    """What people may see: no gold, and files under names that tell nothing."""
    said = F.coalesce(F.nullif("prompt", F.lit("")), F.nullif("query_text", F.lit("")), F.lit(""))
    place = F.concat_ws("/", F.lit("items"), "task_name", F.format_string("%02d_%s", "example", "id"))
    file = lambda column, name: F.when(F.col(column).isNotNull(), name)
    return picked.select(
        "tier", "task_dir", "task_name", "id", place.alias("item_dir"), said.alias("prompt"), "text_options", "label_space", F.transform("candidate_audio_paths", lambda p, i: F.format_string("candidate_%d.wav", i + 1)).alias("candidate_audio_files"),
        file("query_audio_path", "query.wav").alias("query_audio_file"), file("prompt_audio_path", "prompt.wav").alias("prompt_audio_file"),
    )


def key(picked: DataFrame) -> DataFrame:
    """The answers, to be kept from the raters."""
    return picked.select("task_name", F.col("id").alias("item_id"), answer().alias("answer_key"))


def instructions(picked: DataFrame) -> DataFrame:
    """(task_name, text): a sheet of instructions for each task of the items; of one that stands in several tiers, the first's."""
    spoken = F.lit(OTHER_GUIDANCE)
    for task, said in GUIDANCE.items():
        spoken = F.when(F.col("task_name") == task, said).otherwise(spoken)
    each = picked.groupBy("task_name").agg(F.min("tier").alias("tier"))
    asked = "\n".join(f"- {r}" for r in RECORDED)
    return each.select("task_name", F.format_string(f"# %s\n\nTier: `%s`\n\n%s\n\nAsk each rater to also record:\n\n{asked}\n", "task_name", "tier", spoken).alias("text"))


def assets(picked: DataFrame) -> DataFrame:
    """(source, item_dir, name) of every sound that an item needs."""
    shown = items(picked).select("tier", "task_dir", "id", "item_dir")
    each = lambda column, name: picked.select("tier", "task_dir", "id", F.col(column).alias("source"), F.lit(name).alias("name"))
    many = picked.select("tier", "task_dir", "id", F.posexplode("candidate_audio_paths").alias("i", "source")).select("tier", "task_dir", "id", "source", F.format_string("candidate_%d.wav", F.col("i") + 1).alias("name"))
    wanted = each("query_audio_path", "query.wav").unionByName(each("prompt_audio_path", "prompt.wav")).unionByName(many)
    return wanted.where(F.col("source").isNotNull()).join(shown, ["tier", "task_dir", "id"]).select("source", "item_dir", "name")


def copy_assets(wanted: DataFrame, root: str) -> None:
    """Copies files of a file system that all executors mount to their places under ``root``; missing ones are skipped.
    A copy takes its name when it is whole, so a repeated task does no harm."""
    import os
    import shutil
    import uuid

    def copy(rows):
        for r in rows:
            if os.path.isfile(r.source):
                folder = os.path.join(root, r.item_dir)
                os.makedirs(folder, exist_ok=True)
                part = os.path.join(folder, f".{uuid.uuid4().hex}")
                shutil.copyfile(r.source, part)
                os.replace(part, os.path.join(folder, r.name))

    wanted.foreachPartition(copy)


def write(rows: DataFrame, root: str, per_task: int = 2, by: str | None = None) -> None:
    """Items and manifest to share, the key in a folder of its own, an empty form for responses."""
    from ..sources import writers

    picked = chosen(rows, per_task, by)
    shown = items(picked)
    shown.write.mode("overwrite").partitionBy("task_name").json(f"{root}/items")
    for sheet in instructions(picked).toLocalIterator():  # a row for each task
        writers.text_document(rows.sparkSession, sheet["text"], f"{root}/task_instructions/{sheet['task_name']}.md")
    writers.csv(shown.select("tier", "task_name", F.col("id").alias("item_id"), "item_dir"), f"{root}/manifest", ["tier", "task_name", "item_id", "item_dir"])
    writers.csv(key(picked), f"{root}/answer_key_private", ["task_name", "item_id", "answer_key"])
    form = ["response", "confidence", "difficulty", "comments"]
    writers.csv(shown.select("task_name", F.col("id").alias("item_id"), *(F.lit(None).cast("string").alias(c) for c in form)), f"{root}/response_template", ["task_name", "item_id", *form])


def cue_labels() -> dict[str, tuple[str, str]]:
    """The two labels of every cue task."""
    from .tasks import CUES

    return dict(CUES)


def cue_packet(candidates: DataFrame, attempt: Callable[[DataFrame], DataFrame], quota: int = CUE_QUOTA) -> dict[str, DataFrame]:
    """A packet of cue clips: ``items`` and ``responses`` to share, ``answers`` to keep, and ``failures``.

    ``candidates`` has task_name, label, text, seconds, dover_score, clear_score, source_item_id and whatever else the key
    should tell. Clips with unsafe or empty words and labels that aren't the task's are left out; of each label the first
    ``quota`` are taken for which ``attempt`` (see ``sampling.filled``) gets a sound, by points, then scores, then id.
    Item ids hold the label, as the packet's format wants it: who must not see it needs other names for them.
    """
    from ..functions import text as T
    from ..operators.sampling import filled
    from .pipelines import cue_priority

    labels = cue_labels()
    either = lambda of: reduce(lambda rest, task: rest.when(F.col("task_name") == task, of(task)), labels, F)
    known = either(lambda task: F.col("label").isin(*labels[task]))
    kept = candidates.where(known & T.is_safe("text") & (F.trim("text") != "") & F.col("source_item_id").isNotNull())
    down = lambda c: -F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    points = either(lambda task: cue_priority("text", "seconds", task, "label"))
    done, failures = filled(kept, ["task_name", "label"], [-points, down("dover_score"), down("clear_score"), F.col("source_item_id")], quota, attempt)
    named = done.withColumn("item_id", F.format_string("%s_%s_%02d", "task_name", "label", "ordinal"))
    place = F.concat_ws("/", F.lit("items"), "task_name", "item_id")
    items_ = named.select(
        "item_id", "task_name", either(lambda task: F.lit(CUE_PROMPTS[task])).alias("prompt"), either(lambda task: F.array(*map(F.lit, labels[task]))).alias("label_space"),
        F.concat(place, F.lit("/query.wav")).alias("audio_file"), F.concat(place, F.lit("/item.json")).alias("item_json"), F.lit(ANSWERABLE).alias("answerability_question"),
    )
    told = [c for c in candidates.columns if c not in ("task_name", "label", "text")]
    return {
        "items": items_,
        "responses": named.select("item_id", "task_name", *(F.lit("").alias(c) for c in CUE_FORM)),
        "answers": named.select("item_id", "task_name", F.col("label").alias("gold_label"), F.col("text").alias("transcript_private"), *told),
        "failures": failures.select("task_name", "label", "source_item_id", "error"),
    }


def write_cue_packet(packet: dict[str, DataFrame], root: str) -> None:
    """The shared part under ``share``; the key and what failed in folders of their own, so sharing the one shares no answer."""
    from ..sources import writers

    packet["items"].write.mode("overwrite").partitionBy("task_name").json(f"{root}/share/items")
    writers.csv(packet["items"].select("item_id", "task_name", "audio_file", "item_json"), f"{root}/share/items_manifest")
    writers.csv(packet["responses"], f"{root}/share/responses_template")
    writers.csv(packet["answers"], f"{root}/answer_key_private")
    writers.csv(packet["failures"], f"{root}/download_failures")
