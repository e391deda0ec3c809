"""Items of the three long-form sources and of clips, from their annotations and a listing of media files.

Annotations are tables whose column ``file`` is the file a record came from; ``readers.listing`` makes the listing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from . import readers

# Endings of media files, words in the names of annotation files, and the fields that may name a record.
MEDIA = ("mp4", "mov", "mkv", "avi", "webm", "wav", "flac", "mp3", "m4a", "aac", "ogg")
KITCHEN_FILES = ("sound", "audio", "epic")
DAILY_FILES = ("ego4d", "social", "diar", "av", "forecast")
VIDEO_KEYS = ("video_id", "vid", "youtube_id", "id")
KITCHEN_KEYS = ("narration_id", "uid", "clip_id")
DAILY_KEYS = ("clip_uid", "source_clip_uid", "video_uid", "uid", "id")


def csv_files(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """Files of differing headers under the same columns; a plan for each file, for the few files of an annotation set."""
    parts = [readers.csv(spark, p, columns).withColumn("file", F.lit(p)) for p in paths]
    return reduce(DataFrame.unionByName, parts)


def stem(path="file") -> Column:
    return F.regexp_replace(F.regexp_extract(T.col(path), "[^/]+$", 0), r"\.[^.]*$", "")


def of_files(records: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Records of files in whose names one of the words stands."""
    return records.where(F.lower(stem()).rlike("|".join(words)))


def media(listing: DataFrame) -> DataFrame:
    return listing.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*MEDIA))


def _text(records: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in records.columns else F.lit("")


def _key(records: DataFrame, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(_text(records, n), F.lit("")) for n in names), F.lit(""))


def _joined(records: DataFrame, names: list[str], between: str) -> Column:
    return T.squeeze(F.concat_ws(between, *(F.nullif(_text(records, n), F.lit("")) for n in names)))


def _items(known: DataFrame, dataset: Column, group: str, short: Column, rich: Column) -> DataFrame:
    """``known`` has key, path, split, primary, secondary, sequence."""
    said = F.coalesce(F.nullif("sequence", F.lit("")), T.event_phrase("primary"))
    return known.select(
        F.concat_ws("-", F.lower(dataset), *(["split"] if group == "long_form" else []), "key").alias("source_item_id"), dataset.alias("source_dataset"), "split", F.col("path").alias("media_path"), short.alias("context_short"), rich.alias("context_rich"),
        F.col("primary").alias("primary_event"), F.col("secondary").alias("secondary_event"), said.alias("event_sequence_text"), T.speaker_mode("sequence").alias("speaker_mode"), F.lit(group).alias("scenario_group"), F.lit(0.0).alias("duration_sec"), "file",
    )


def long_form(records: DataFrame, listing: DataFrame) -> DataFrame:
    """Audio-visual labels; the split is what the file's name begins with. Records without an id or a file are left out."""
    r = records.withColumn("key", _key(records, VIDEO_KEYS)).withColumn("split", F.split_part(stem(), F.lit("_"), F.lit(1)))
    sound, sight, label = (_text(records, n) for n in ("audio_label", "visual_label", "label"))
    r = r.withColumn("primary", T.safe_event(sound, sight, label)).withColumn("secondary", T.safe_event(sight, sound)).withColumn("sequence", _joined(records, ["audio_label", "visual_label"], " then "))
    known = r.join(readers.resolved(r, media(listing), "key", "").select("key", "path"), "key")
    short, rich = T.long_context("LFAV", "primary", "secondary", T.speaker_mode("sequence"))
    return _items(known, F.lit("LFAV"), "long_form", short, rich)


def kitchen(records: DataFrame, listing: DataFrame) -> DataFrame:
    """Narrated kitchen sounds, of files named so; a record's file has exactly its id as name, the last path if several."""
    r = of_files(records, KITCHEN_FILES)
    name = F.lower(stem())
    split = F.when(F.contains(name, F.lit("validation")), "validation").when(F.contains(name, F.lit("test")), "test").otherwise("train")
    dataset = F.when(F.contains(name, F.lit("hd")), "HD-EPIC").otherwise("EPIC")
    r = r.withColumn("key", _key(records, KITCHEN_KEYS)).where("key <> ''").withColumn("split", split).withColumn("primary", T.safe_event(*(_text(records, n) for n in ("class", "narration", "verb"))))
    r = r.withColumn("secondary", T.safe_event(_text(records, "noun"), _text(records, "secondary_class"))).withColumn("sequence", _joined(records, ["narration", "verb", "noun"], " "))
    files = media(listing).groupBy(F.col("stem").alias("key")).agg(F.max("path").alias("path"))
    short, rich = T.long_context(dataset, "primary", "secondary", T.speaker_mode("sequence"))
    return _items(r.join(files, "key"), dataset, "ego_kitchen", short, rich)


def daily(records: DataFrame, listing: DataFrame) -> DataFrame:
    """Clips of daily life, flattened before (``readers.flattened``), of files named so."""
    r = of_files(records, DAILY_FILES)
    r = r.withColumn("key", _key(records, DAILY_KEYS)).withColumn("split", F.coalesce(F.nullif(_text(records, "split"), F.lit("")), F.lit("train")))
    r = r.withColumn("primary", T.safe_event(*(_text(records, n) for n in ("text", "event", "narration_text", "label")))).withColumn("secondary", T.safe_event(_text(records, "secondary_event"), _text(records, "scenario")))
    r = r.withColumn("sequence", _joined(records, ["text", "event", "scenario"], " "))
    known = r.join(readers.resolved(r, media(listing), "key", "").select("key", "path"), "key")
    first, second = T.event_phrase("primary"), T.event_phrase("secondary")
    short = F.concat(F.lit("A long-form egocentric clip involving "), first, F.lit("."))
    rich = F.concat(F.lit("A long-form Ego4D clip with conversation or activity context. Primary cue: "), first, F.lit(". Secondary cue: "), second, F.lit("."))
    return _items(known, F.lit("Ego4D"), "ego_daily_life", short, rich)


def side_texts(clips: DataFrame, side: DataFrame) -> DataFrame:
    """(clip_name, leaf, path): strings of each clip's side document: that whose name begins with the clip's, or else with
    its video's. ``clips`` has clip_name and video; ``side`` has stem and doc (JSON text)."""
    named = side.withColumn("path", F.concat("stem", F.lit(".json")))
    own = readers.resolved(clips.select("clip_name"), named, "clip_name", "").where("kind < 2").select("clip_name", "path")
    left = clips.join(own.select("clip_name"), "clip_name", "left_anti")
    theirs = readers.resolved(left.select("video").distinct(), named, "video", "").where("kind < 2").select("video", "path")
    chosen = own.unionByName(left.join(theirs, "video").select("clip_name", "path")).select("clip_name", F.regexp_replace("path", r"\.json$", "").alias("stem"))
    return T.string_leaves(side.select("stem", "doc"), "doc").join(chosen, "stem").select("clip_name", "leaf", "path")


def clips(merged: DataFrame, speech: DataFrame, captions: DataFrame, members: dict[str, DataFrame], listing: DataFrame, min_clear: float = 0.45, min_dover: float = 0.45, require_speech: bool = True, max_items: int | None = None) -> DataFrame:
    """Clips with a file, good scores, a duration and (if required) speech; captions and speech give delivery and contexts.

    ``merged`` has clip_name, clear, dover, conf, is_talking, clip_speaker_num, start_seconds, end_seconds, duration (any type
    that reads as a number); ``speech`` and ``captions`` have stem and doc.
    """
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    m = merged.withColumn("video", T.video_id("clip_name", short=True)).withColumn("clear", number("clear")).withColumn("dover", number("dover")).withColumn("conf", number("conf"))
    lasts = number("duration")
    m = m.where((F.col("clear") >= min_clear) & (F.col("dover") >= min_dover)).withColumn("start", number("start_seconds")).withColumn("length", F.when(lasts > 0, lasts).otherwise(number("end_seconds") - F.col("start"))).where("length > 0")
    names = m.select("clip_name", "video")
    m = m.join(readers.resolved(names, media(listing), "clip_name", "").select("clip_name", "path"), "clip_name")
    # the longest string, of several the first
    heard = side_texts(names, speech).groupBy("clip_name").agg(F.min(F.struct(-F.length("leaf"), "path", "leaf"))["leaf"].alias("asr"))
    seen = side_texts(names, captions).where(F.trim("leaf") != "").groupBy("clip_name").agg(F.sort_array(F.collect_list(F.struct("path", F.trim("leaf").alias("leaf")))).alias("s"))
    seen = seen.select("clip_name", F.array_join(F.transform("s", lambda x: x["leaf"]), " ").alias("caption"))
    both = m.join(heard, "clip_name", "left").join(seen, "clip_name", "left").fillna("", ["asr", "caption"]).withColumn("asr", F.trim("asr"))
    both = both.where("asr <> ''") if require_speech else both
    talking, many = F.coalesce(F.col("is_talking").try_cast("int"), F.lit(0)) != 0, F.greatest(F.lit(1), F.coalesce(F.col("clip_speaker_num").try_cast("int"), F.lit(1)))
    short, rich = T.clip_context(talking, many, "caption")
    out = readers.split_membership(both, "clip_name", members).select(
        "clip_name", "video", F.col("path").alias("clip_path"), "split", talking.alias("is_talking"), many.alias("clip_speaker_num"), F.col("asr").alias("asr_text"), F.col("caption").alias("caption_text"), F.col("clear").alias("clear_score"), F.col("dover").alias("dover_score"), F.col("conf").alias("conf_score"),
        F.col("start").alias("start_seconds"), F.col("length").alias("duration_seconds"), short.alias("short_context_text"), rich.alias("rich_context_text"), T.delivery(F.concat_ws(" ", "caption", "asr")).alias("delivery_label"), T.last_integer("clip_name").alias("clip_index"),
    )
    return out if max_items is None else out.orderBy("clip_name").limit(max_items)


def manifest(items: DataFrame, audio: DataFrame | None = None, key: str = "clip_name") -> DataFrame:
    """The items that have audio, with its path; ``audio`` has the key and audio_path."""
    return items if audio is None else items.join(audio.where(F.coalesce("audio_path", F.lit("")) != "").select(key, "audio_path"), key)


def manifest_counts(rows: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """(field, value, n): rows by each value of the columns ``by``, the flags that hold, and all, in one pass."""
    marks = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in by]
    marks += [F.when(hold, F.struct(F.lit(name).alias("field"), F.lit(None).cast("string").alias("value"))) for name, hold in flags.items()]
    marks += [F.struct(F.lit("count").alias("field"), F.lit(None).cast("string").alias("value"))]
    return rows.select(F.explode(F.array(*marks)).alias("m")).where("m is not null").groupBy("m.field", "m.value").agg(F.count("*").alias("n"))
