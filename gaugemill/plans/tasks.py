"""Task rows from source tables: each builder turns items and their pools into options with a seeded order and a gold.

Items of the first tier have id, name, grp, flag; clips of the second id, video, clip_index, delivery, duration, text,
caption, is_talking and speakers; long items of the third id, event, scenario, mode, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import seeded, text as T
from ..operators import pools

# Option texts of the two-way tasks, gold first where the flag holds.
PERIODICITY = ("A repetitive, rhythmic acoustic event.", "A single abrupt impact-like event.")
ONSET = ("A sudden sharp-onset sound.", "A diffuse or smeared-onset sound.")
SPEECH = ("The visible subject is actively speaking or vocalizing.", "The visible subject is not strongly vocalizing.")
SPEAKERS = ("A single dominant speaker is present.", "Multiple speakers or a dyadic exchange are present.")
# The delivery classes in the order of their options, and these options.
DELIVERIES = ("laughter", "high_energy", "neutral_speech", "soft")
DELIVERY_OPTIONS = ("Laughter or amused vocal delivery.", "High-energy shouting or cheering.", "Neutral or ordinary speech delivery.", "Soft or whisper-like delivery.")
CUES = {
    "acknowledgment_cue_detection": ("short_acknowledgment", "not_short_acknowledgment"),
    "clarification_question_detection": ("clarification_question", "not_clarification_question"),
    "explicit_repair_cue_detection": ("explicit_repair_cue", "no_explicit_repair_cue"),
}


def with_options(rows: DataFrame, task: str, right: str, wrong: str, seed: int, most: int = 3, kept: tuple[str, ...] = ()) -> DataFrame:
    """Shuffles the right option among the wrong ones (an array, of ``most`` at most) and tells where it went; with the columns
    ``kept``."""
    all_ = rows.withColumn("_o", F.concat(F.array(right), F.col(wrong)))
    mixed = all_.withColumn("_m", seeded.shuffled(F.col("_o"), seed, F.col("id"), most + 1))
    place = (F.array_position("_m.i", F.lit(0)) - 1).alias("gold_index")
    return mixed.select(F.lit(task).alias("task_name"), "id", F.col("_m.v").alias("options"), place, *kept)


def _gathered(pool: DataFrame, told: tuple[str, ...] = ()) -> DataFrame:
    """The candidates of each id in their order, as structs if more is told of them."""
    one = F.struct("candidate", *told) if told else F.col("candidate")
    return pool.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pick", one.alias("x"))))["x"].alias("others"))


def _owned(rows: DataFrame, items: DataFrame) -> DataFrame:
    """With the item itself as ``own``."""
    return rows.join(items.select("id", F.struct(*items.columns).alias("own")), "id")


def two_way(rows: DataFrame, task: str, options: tuple[str, str], first_is_gold: Column, bucket: Column | None = None) -> DataFrame:
    """A fixed pair of options, gold by a condition."""
    out = rows.select(F.lit(task).alias("task_name"), "id", F.array(*map(F.lit, options)).alias("options"), F.when(first_is_gold, 0).otherwise(1).cast("bigint").alias("gold_index"), (bucket if bucket is not None else F.lit(None).cast("string")).alias("balance_bucket"))
    return out


def target_sound(items: DataFrame, seed: int, least: DataFrame | None = None) -> DataFrame:
    """``least`` (and ``most`` below): what ``pools.by_name`` found of the items, if it's known, nine (three) at least."""
    pool = pools.picked(pools.by_name(items, 9, "least") if least is None else least, 9, 3, seed)
    return with_options(pool, "target_sound_grounding", "id", "others", seed)


def acoustic_contrast(items: DataFrame, seed: int, most: DataFrame | None = None) -> DataFrame:
    """With its most similar neighbour; items without one are left out."""
    pool = pools.picked(pools.by_name(items, 3, "most") if most is None else most, 3, 1, seed)
    return with_options(pool, "fine_grained_acoustic_contrast", "id", "others", seed)


def foreground(items: DataFrame, kept: list[str] = ()) -> DataFrame:
    """Three rows an item: in front, behind, absent, with the volumes to mix it at; and the columns ``kept``."""
    kinds = F.array(*(F.struct(F.lit(g).alias("gold_label"), F.lit(a).alias("volume"), F.lit(b).alias("other_volume")) for g, a, b in (("foreground", 1.0, 0.35), ("background", 0.25, 1.0), ("absent", 0.0, 1.0))))
    return items.select("id", *kept, F.explode(kinds).alias("k")).select(F.lit("foreground_event_focus").alias("task_name"), "id", F.array(*map(F.lit, ("foreground", "background", "absent"))).alias("label_space"), "k.*", *kept)


def plausibility_ranking(items: DataFrame, seed: int, least: DataFrame | None = None, most: DataFrame | None = None) -> DataFrame:
    """The item, a similar and a dissimilar one that isn't the similar one, in seeded order, with the ranking that puts
    them so."""
    near = pools.picked(pools.by_name(items, 3, "most") if most is None else most, 3, 1, seed).select("id", F.get("others", F.lit(0)).alias("near"))
    far = (pools.by_name(items, 4, "least") if least is None else least).join(near, "id")
    far = far.withColumn("best", F.slice(F.filter(F.slice("best", 1, 4), lambda x: x["candidate"] != F.col("near")), 1, 3)).where(F.size("best") > 0)
    drawn = F.array_min(F.transform("best", lambda x: F.struct(seeded.digest(seed, F.col("id"), x["candidate"]).alias("h"), x["candidate"].alias("c"))))
    far = far.select("id", "near", drawn["c"].alias("far"))
    mixed = far.withColumn("_m", seeded.shuffled(F.array("id", "near", "far"), seed, F.col("id"), 3))
    order = F.array(*(F.array_position("_m.i", F.lit(i)) - 1 for i in range(3)))
    return mixed.select(F.lit("acoustic_plausibility_ranking").alias("task_name"), "id", F.col("_m.v").alias("candidates"), order.alias("gold_ranking"))


def periodicity(items: DataFrame) -> DataFrame:
    return two_way(items, "periodicity_aware_grounding", PERIODICITY, F.col("flag") == 1)


def onset_sharpness(items: DataFrame) -> DataFrame:
    return two_way(items, "onset_sharpness_grounding", ONSET, F.col("flag") == 1, F.col("grp"))


def hard_negatives(items: DataFrame, seed: int) -> DataFrame:
    """What is said of it (``rich``, or else its name) among what is said of three of the most similar items with other
    names."""
    says = "rich" if "rich" in items.columns else "name"
    names = items.select(F.col("id").alias("candidate"), F.col(says).alias("other"))
    drawn = pools.picked(pools.by_name(items, 9, "most", other_names=True), 9, 3, seed)
    pool = drawn.select("id", F.posexplode("others").alias("pick", "candidate")).join(names, "candidate")
    few = pool.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pick", "other"))), lambda s: s["other"]).alias("others"))
    return with_options(few.join(items.select("id", F.col(says).alias("own")), "id"), "audio_text_hard_negative_matching", "own", "others", seed)


def causal_order(items: DataFrame, seed: int) -> DataFrame:
    """An item and one of another group, and which of the two orders stands first; the bucket is their groups."""
    other = items.select(F.col("id").alias("candidate"), F.col("grp").alias("other_grp"))
    rows = pools.in_other_group(items, "id", "grp").join(items.select("id", "grp"), "id").join(other, "candidate")
    return rows.select(F.lit("causal_event_order").alias("task_name"), "id", "candidate", seeded.draw(F.lit(2), seed, F.col("id")).alias("gold_index"), F.concat_ws("__", "grp", "other_grp").alias("balance_bucket"))


def speech_activity(clips: DataFrame) -> DataFrame:
    return two_way(clips, "speech_activity_grounding", SPEECH, F.col("is_talking"))


def delivery_bucket() -> Column:
    return F.concat_ws("|", "delivery", T.duration_bucket("duration"))


def speaker_count(clips: DataFrame) -> DataFrame:
    return two_way(clips, "speaker_count_grounding", SPEAKERS, F.col("speakers") <= 1, delivery_bucket())


def delivery_style(clips: DataFrame) -> DataFrame:
    """An option for each delivery; clips of none of these are left out."""
    place = F.array_position(F.array(*map(F.lit, DELIVERIES)), F.col("delivery")) - 1
    return clips.where(F.col("delivery").isin(*DELIVERIES)).select(F.lit("delivery_style_grounding").alias("task_name"), "id", F.array(*map(F.lit, DELIVERY_OPTIONS)).alias("options"), place.alias("gold_index"))


def _drawn(pool: DataFrame, seed: int, name: str) -> DataFrame:
    """One candidate of each id in seeded order."""
    best = F.min(F.struct(seeded.digest(seed, F.col("id"), F.col("candidate")).alias("h"), F.col("candidate").alias("c")))
    return pool.groupBy("id").agg(best.alias("x")).select("id", F.col("x.c").alias(name))


def _spoken(clips: DataFrame) -> DataFrame:
    """Clips with texts of four tokens at least."""
    return clips.where(F.size(T.tokens("text")) >= 4)


def phonic_target(clips: DataFrame, seed: int) -> DataFrame:
    """Three in seeded order of the eight clips least alike."""
    w = Window.partitionBy("id").orderBy(seeded.digest(seed, F.col("id"), F.col("candidate")), "candidate")
    pool = pools.clips_by_score(clips, clips, 8).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= 3)
    return with_options(_gathered(pool), "phonic_target_grounding", "id", "others", seed)


def dyadic(clips: DataFrame, seed: int) -> DataFrame:
    """The first other clip of the same video against one of eight of other videos that are alike in speakers, delivery,
    duration and talking and least alike in words, or else one of the eight least alike of all."""
    right = pools.first_neighbour(clips, "video", "clip_index", "id").select("id", F.col("neighbour").alias("right"))
    alike = clips.withColumn("bucket", T.duration_bucket("duration"))
    best = _drawn(pools.clips_by_score(alike, alike, 8, [*pools.TRAITS, "bucket"], ["video"]), seed, "wrong")
    rest = clips.join(best, "id", "left_anti")
    wrong = best.unionByName(_drawn(pools.clips_by_score(rest, clips, 8), seed, "wrong"))
    return with_options(right.join(wrong.select("id", F.array("wrong").alias("wrong")), "id"), "dyadic_matching", "right", "wrong", seed)


def continuation(clips: DataFrame, differ: str, task: str, seed: int) -> DataFrame:
    """A text of another video that agrees in speakers, delivery and duration, one of the eight most alike, against one of
    the eight least alike that are of another video and have another value in ``differ``; texts of four tokens at least,
    and for deliveries clips of these classes only."""
    long = _spoken(clips).withColumn("bucket", T.duration_bucket("duration"))
    own = long.where(F.col("delivery").isin(*DELIVERIES)) if differ == "delivery" else long
    same = ["speakers", "delivery", "bucket"]
    right = _drawn(pools.clips_by_score(own, long, 8, same, ["video"], "most_last"), seed, "right")
    wrong = _drawn(pools.clips_by_score(own, long, 8, [c for c in same if c != differ], [differ, "video"]), seed, "wrong")
    return with_options(right.join(wrong.select("id", F.array("wrong").alias("wrong")), "id"), task, "right", "wrong", seed)


def turn_holding(clips: DataFrame, seed: int) -> DataFrame:
    """The first other clip of the same video with text against one of the eight least alike; dropped if that one has
    under four tokens."""
    long = _spoken(clips)
    right = pools.first_neighbour(long, "video", "clip_index", "id").select("id", F.col("neighbour").alias("right"))
    wrong = _drawn(pools.clips_by_score(long, clips, 8), seed, "wrong").join(long.select(F.col("id").alias("wrong")), "wrong", "left_semi")
    return with_options(right.join(wrong.select("id", F.array("wrong").alias("wrong")), "id"), "turn_holding_continuation", "right", "wrong", seed)


def event_window(rows: DataFrame, seed: int, told: tuple[str, ...] = ()) -> DataFrame:
    """With ``told`` options are structs of candidate and these columns of it, which come with the draws, and the item is ``own``."""
    pool = _gathered(pools.seeded_others(rows, "event", 3, seed, told), told)
    if not told:
        return with_options(pool, "event_window_grounding", "id", "others", seed)
    met = _owned(pool, rows).withColumn("right", F.struct(F.col("id").alias("candidate"), *(F.col(f"own.{c}") for c in told)))
    return with_options(met, "event_window_grounding", "right", "others", seed, kept=("own",))


def event_retrieval(rows: DataFrame, seed: int) -> DataFrame:
    """The same candidates, asked for in words."""
    return event_window(rows, seed).withColumn("task_name", F.lit("long_context_event_retrieval")).join(rows.select("id", F.col("text").alias("query_text")), "id")


def coarse_order(rows: DataFrame, budget: int, seed: int) -> DataFrame:
    """A row and one like it in both orders; gold is always the first, so the gate must reject the task. Only the first
    ``budget`` rows in order, as each renders two files."""
    near = pools.fallback_pool(rows, rows, "event", "scenario", 1, seed).select("id", "candidate").orderBy("id").limit(budget)
    both = F.array(F.concat_ws("__then__", "id", "candidate"), F.concat_ws("__then__", "candidate", "id"))
    return near.select(F.lit("coarse_event_order").alias("task_name"), "id", both.alias("options"), F.lit(0).cast("bigint").alias("gold_index"))


def narrative(rows: DataFrame, seed: int, told: tuple[str, ...] = ()) -> DataFrame:
    """``told`` as in ``event_window``."""
    right = F.struct("candidate", *told) if told else F.col("candidate")
    near = pools.fallback_pool(rows, rows, "event", "scenario", 1, seed, told).select("id", right.alias("right"))
    far = _gathered(pools.seeded_others(rows, "event", 2, seed, told), told).withColumnRenamed("others", "wrong")
    met = near.join(far, "id")
    return with_options(_owned(met, rows) if told else met, "narrative_continuation_plausibility", "right", "wrong", seed, kept=("own",) if told else ())


def overlap(rows: DataFrame) -> DataFrame:
    """The speaker mode against another, where it is known; gold is always the first."""
    other = F.when(F.col("mode") == "single_speaker", "multi_speaker").otherwise("single_speaker")
    return rows.where("mode <> 'unknown'").select(F.lit("speaker_event_overlap").alias("task_name"), "id", F.array("mode", other).alias("options"), F.lit(0).cast("bigint").alias("gold_index"))


def sequential(rows: DataFrame, seed: int) -> DataFrame:
    """The event followed by the one beside it, against another event followed by it."""
    far = pools.seeded_others(rows, "event", 1, seed, ("event",)).withColumnRenamed("event", "other")
    after = lambda a, b: F.concat(T.event_phrase(a), F.lit(" followed by "), T.event_phrase(b))
    both = far.select("id", "other").join(rows.select("id", "event", "secondary"), "id").select("id", after("event", "secondary").alias("right"), F.array(after("other", "event")).alias("wrong"))
    return with_options(both, "sequential_causal_consistency", "right", "wrong", seed)


def cues(candidates: DataFrame, task: str, per_label: int) -> DataFrame:
    """The best safe candidates of each label of a cue task, with running numbers."""
    from ..operators.sampling import top_n

    kept = candidates.where(F.col("label").isin(*CUES[task]) & T.is_safe("text") & (F.trim("text") != ""))
    order = [F.abs(F.col("seconds") - 18), F.col("clear_score").desc(), F.col("dover_score").desc(), F.col("source_item_id")]
    best = top_n(kept, ["label"], order, per_label)
    return best.select(F.format_string(f"{task}_%s_%05d", "label", "ordinal").alias("id"), F.lit(task).alias("task_name"), F.array(*map(F.lit, CUES[task])).alias("label_space"), F.col("label").alias("gold_label"), F.least(F.greatest("seconds", F.lit(12.0)), F.lit(24.0)).alias("window_duration_seconds"), "source_item_id")
