"""Queries of whole suites, loaders, manifests and packets, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..sources import loaders, readers
from . import packets, suites, tasks
from .bindings import CLIPS, LONG_ITEMS, SRC_ITEMS, clips, digest_sql, long_items, src_items
from .registry import Tables, query
from .task_queries import _ALIKE, _ALIKE_EVENT, _LONG_TEXT, _NEXT, OTHER_GROUP, TOLD, _continued, _one


def _audio() -> Column:
    return F.format_string("/audio/%s.wav", F.col("id").cast("string"))


def tier_1(t: Tables) -> DataFrame:
    said = F.concat(F.lit("A sound of "), T.event_phrase("name"))
    return src_items(t).select("*", F.col("name").alias("label"), _audio().alias("audio_path"), said.alias("rich"), F.col("grp").alias("short"), said.alias("text"))


def tier_2(t: Tables) -> DataFrame:
    short, rich = T.clip_context(F.col("is_talking"), F.col("speakers"), "delivery")
    rows = clips(t)
    return rows.select(*(c for c in rows.columns if c != "delivery"), T.delivery("text").alias("delivery"), F.concat(F.lit("clip_"), "id").alias("label"), _audio().alias("audio_path"), rich.alias("rich"), short.alias("short"))


def tier_3(t: Tables) -> DataFrame:
    short, rich = T.long_context("LFAV", "event", "secondary", "mode")
    return long_items(t).select("*", F.col("event").alias("label"), _audio().alias("audio_path"), rich.alias("rich"), short.alias("short"))


def _shown(rows: DataFrame) -> DataFrame:
    """Of each row what doesn't hang on seeds: its gold in words, its prompt, how much it offers and names."""
    at = F.coalesce("gold_index", F.get("gold_ranking", F.lit(0))).cast("int")
    gold = F.coalesce("gold_label", F.get("candidate_labels", at), F.get("candidate_item_ids", at), F.get("text_options", at), F.get("candidate_audio_paths", at))
    offered = F.greatest(F.size("text_options"), F.size("candidate_audio_paths"), F.size("label_space"))
    return rows.select("task_dir", "id", F.coalesce("prompt", "query_text").alias("prompt"), gold.alias("gold"), offered.cast("long").alias("n_options"), F.size("source_item_ids").cast("long").alias("n_sources"), "balance_bucket", F.coalesce("query_audio_path", "prompt_audio_path", F.lit("")).alias("heard"))


_S1 = "'A sound of ' || replace(name, '_', ' ')"
_WAV = "'/audio/' || id || '.wav'"


@query(f"""WITH {SRC_ITEMS}, {OTHER_GROUP},
m AS (SELECT unnest(['foreground', 'background', 'absent']) AS g),
r AS (SELECT 'task_1_target_sound_grounding' AS task_dir, 't1-' || id AS id, {_S1} AS prompt, name AS gold, 4 AS n_options, 4 AS n_sources, NULL AS balance_bucket, '' AS heard FROM src_items
UNION ALL SELECT 'task_2_fine_grained_acoustic_contrast', 't2-' || id, grp, name, 2, 2, NULL, '' FROM src_items
UNION ALL SELECT 'task_3_foreground_event_focus', 't3-' || id || '-' || g, {_S1}, g, 3, 2, NULL, 'audio/task3_foreground_focus/' || id || '-' || g || '.wav' FROM src_items, m
UNION ALL SELECT 'task_4_acoustic_plausibility_ranking', 't4-' || id, {_S1}, name, 3, 3, NULL, '' FROM src_items
UNION ALL SELECT 'task_5_periodicity_aware_grounding', 't5-' || id, {_S1}, CASE WHEN flag = 1 THEN '{tasks.PERIODICITY[0]}' ELSE '{tasks.PERIODICITY[1]}' END, 2, 1, NULL, {_WAV} FROM src_items
UNION ALL SELECT 'task_6_onset_sharpness_grounding', 't6-' || id, '{suites.PROMPTS['onset_sharpness_grounding']}', CASE WHEN flag = 1 THEN '{tasks.ONSET[0]}' ELSE '{tasks.ONSET[1]}' END, 2, 1, grp, {_WAV} FROM src_items
UNION ALL SELECT 'task_7_audio_text_hard_negative_matching', 't7-' || id, grp, {_S1}, 4, 1, NULL, {_WAV} FROM src_items
UNION ALL SELECT 'task_8_causal_event_order', 't8-' || id || '-' || candidate, 'First ' || replace(name, '_', ' ') || ', then ' || replace(other, '_', ' ') || '.', name || '_then_' || other, 2, 2, grp || '__' || other_grp, '' FROM c)
SELECT task_dir, id, prompt, gold, n_options::BIGINT AS n_options, n_sources::BIGINT AS n_sources, balance_bucket::VARCHAR AS balance_bucket, heard FROM r""")
def suite_first_tier(t: Tables) -> DataFrame:
    """All eight tasks."""
    return _shown(suites.first_tier(tier_1(t), 42))


_RICH2 = "'A portrait-style video clip. ' || CASE WHEN is_talking THEN 'with a speaking subject' ELSE 'with no strong visible vocalization' END || '. and ' || speakers || ' visible speaker(s). Caption cues: ' || role || '.'"
_SHORT2 = "CASE WHEN is_talking THEN 'A speaking portrait clip.' ELSE 'A portrait clip with little or no visible speech.' END"


def _continued_rows(n: int, task: str, seed: int, tags: str, bucket: str) -> str:
    """The rows of a continuation, of which one right and one wrong candidate are drawn from eight each."""
    draw = lambda pool: _one(pool, seed)
    return f"""UNION ALL SELECT 'task_{n}_{task}', 'sv-t{n}-' || c.id, '{suites.PROMPTS[task]}', z.text, 2, 3, {bucket}, '/audio/' || c.id || '.wav'
FROM {draw(f'same_{tags}')} x JOIN {draw(f'other_{tags}')} y USING (id) JOIN b c USING (id) JOIN clips z ON z.id = x.wrong"""


def _parted(sql: str, tags: str) -> str:
    """Only the two pools of a continuation's SQL, under other names."""
    body = sql[sql.index("same_ AS") : sql.rindex("o AS (SELECT id, x.wrong")].rstrip().rstrip(",")
    return body.replace("same_ AS", f"same_{tags} AS").replace("other_ AS", f"other_{tags} AS")


_BY_DELIVERY = "c.delivery || '|' || c.bucket"
_BY_SPEAKERS = "CASE WHEN c.speakers > 1 THEN 'multiple_speakers' ELSE 'single_speaker' END || '|' || c.bucket"


@query(f"""WITH {TOLD}, {_ALIKE}, {_NEXT}, l AS (SELECT * FROM b WHERE {_LONG_TEXT}), {_parted(_continued('speakers', 48), 's')}, {_parted(_continued('delivery', 49), 'd')},
ln AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY clip_index, id) AS n FROM l), lr AS (SELECT a.id, z.text FROM ln a JOIN ln z ON a.video = z.video AND z.n = CASE WHEN a.n = 1 THEN 2 ELSE 1 END),
d AS (SELECT r.*, c.delivery, c.bucket FROM r JOIN b c USING (id)),
x AS (SELECT 'task_1_phonic_target_grounding' AS task_dir, 'sv-t1-' || id AS id, {_RICH2} AS prompt, 'clip_' || id AS gold, 4 AS n_options, 4 AS n_sources, NULL AS balance_bucket, '' AS heard FROM told
UNION ALL SELECT 'task_2_speech_activity_grounding', 'sv-t2-' || id, {_RICH2}, CASE WHEN is_talking THEN '{tasks.SPEECH[0]}' ELSE '{tasks.SPEECH[1]}' END, 2, 1, NULL, {_WAV} FROM told
UNION ALL SELECT 'task_3_speaker_count_grounding', 'sv-t3-' || id, {_SHORT2}, CASE WHEN speakers > 1 THEN '{tasks.SPEAKERS[1]}' ELSE '{tasks.SPEAKERS[0]}' END, 2, 1, delivery || '|' || bucket, {_WAV} FROM b
UNION ALL SELECT 'task_4_dyadic_matching', 'sv-t4-' || id, '{suites.PROMPTS['dyadic_matching']}', 'clip_' || right_, 2, 3, delivery || '|' || bucket, {_WAV} FROM d
UNION ALL SELECT 'task_5_delivery_style_grounding', 'sv-t5-' || id, {_SHORT2}, list_extract({list(tasks.DELIVERY_OPTIONS)}, list_position({list(tasks.DELIVERIES)}, delivery)::INT), 4, 1, NULL, {_WAV} FROM clips
UNION ALL SELECT 'task_6_turn_holding_continuation', 'sv-t6-' || c.id, '{suites.PROMPTS['turn_holding_continuation']}', lr.text, 2, 3, {_BY_DELIVERY}, '/audio/' || c.id || '.wav' FROM {_one('least_', 47)} y JOIN l wl ON wl.id = y.wrong JOIN b c ON c.id = y.id JOIN lr ON lr.id = y.id
{_continued_rows(7, 'speaker_count_aware_continuation', 48, 's', _BY_DELIVERY)}
{_continued_rows(8, 'delivery_conditioned_continuation', 49, 'd', _BY_SPEAKERS)})
SELECT task_dir, id, prompt, gold, n_options::BIGINT AS n_options, n_sources::BIGINT AS n_sources, balance_bucket::VARCHAR AS balance_bucket, heard FROM x""".replace("FROM told", "FROM (SELECT b.*, o.delivery AS role FROM b JOIN raw o USING (id))"))
def suite_second_tier(t: Tables) -> DataFrame:
    """All eight tasks."""
    return _shown(suites.second_tier(tier_2(t), 42))


_RICH3 = "'A long-form clip from LFAV. where ' || replace(event, '_', ' ') || ' is central. and may co-occur with ' || replace(secondary, '_', ' ') || CASE WHEN mode <> 'unknown' THEN '. with a ' || replace(mode, '_', ' ') || ' interaction pattern' ELSE '' END || '.'"


@query(f"""WITH {LONG_ITEMS}, {_ALIKE_EVENT.replace('{seed}', '43')}, near AS (SELECT * FROM s), o AS (SELECT id, candidate, text FROM near JOIN long_items USING (id) ORDER BY id LIMIT 1024), next_ AS (SELECT id, candidate FROM (SELECT id, candidate, tag, {digest_sql(44, 'candidate')} AS h FROM z) QUALIFY row_number() OVER (PARTITION BY id ORDER BY tag, h, candidate) = 1),
x AS (SELECT 'task_1_event_window_grounding' AS task_dir, 't3-1-' || id AS id, {_RICH3} AS prompt, id::VARCHAR AS gold, 4 AS n_options, '' AS heard FROM long_items
UNION ALL SELECT 'task_2_coarse_event_order', 't3-2-' || id, 'Which sequence better matches this long-form context: ' || text || '?', 'audio/task2_coarse_order/' || id || '__then__' || candidate || '.wav', 2, '' FROM o
UNION ALL SELECT 'task_3_narrative_continuation_plausibility', 't3-3-' || id, '{suites.PROMPTS['narrative_continuation_plausibility']}', candidate::VARCHAR, 3, {_WAV} FROM next_
UNION ALL SELECT 'task_4_long_context_event_retrieval', 't3-4-' || id, replace(event, '_', ' '), id::VARCHAR, 4, '' FROM long_items
UNION ALL SELECT 'task_5_speaker_event_overlap', 't3-5-' || id, 'A long-form audio clip involving ' || replace(event, '_', ' ') || '.', mode, 2, {_WAV} FROM long_items WHERE mode <> 'unknown'
UNION ALL SELECT 'task_6_sequential_causal_consistency', 't3-6-' || id, {_RICH3}, replace(event, '_', ' ') || ' followed by ' || replace(secondary, '_', ' '), 2, {_WAV} FROM long_items)
SELECT task_dir, id, prompt, gold, n_options::BIGINT AS n_options, heard FROM x""")
def suite_third_tier(t: Tables) -> DataFrame:
    """All six tasks from all long items; 1,024 orders are the task's own budget."""
    rows = suites.third_tier(tier_3(t), 42, None)
    return _shown(rows).drop("balance_bucket", "n_sources")


@query(f"""WITH {SRC_ITEMS}, n AS (SELECT count(*) AS n FROM src_items), s AS (SELECT unnest({[name for name, _ in suites.TIERS['tier1']]}) AS task_name, unnest({[m for _, m in suites.TIERS['tier1']]}) AS recommended_metrics, unnest(range(1, 9)) AS i)
SELECT 'task_' || i || '_' || task_name AS task_dir, task_name, CASE WHEN i = 4 THEN 'top1_accuracy' ELSE 'accuracy' END AS primary_metric, recommended_metrics, CASE WHEN i IN (5, 6) THEN n ELSE 0 END::BIGINT AS "count" FROM s, n""")
def suite_index(t: Tables) -> DataFrame:
    """Specs and counts of a first tier of which two tasks are selected, each row marked with where it is from."""
    wanted = t.spark.createDataFrame([("tier1", "task_5_periodicity_aware_grounding"), ("tier1", "task_6_onset_sharpness_grounding")], "tier string, task_dir string")
    rows = suites.first_tier(tier_1(t), 42, ["periodicity_aware_grounding", "onset_sharpness_grounding", "causal_event_order"])
    kept = suites.copied(rows, wanted).where(F.col("selected_from") == F.concat_ws("/", "tier", "task_dir"))
    return suites.counts(kept).select("task_dir", "task_name", "primary_metric", "recommended_metrics", "count")


@query(f"""WITH {LONG_ITEMS} SELECT a.id, (a.scenario = b.scenario)::INT + (a.mode = b.mode)::INT + 0.5::DOUBLE * len(list_intersect(regexp_extract_all(a.event, '[a-z0-9]+'), regexp_extract_all(b.event, '[a-z0-9]+'))) AS score FROM long_items a JOIN long_items b ON b.id = a.id + 1""")
def long_item_scores(t: Tables) -> DataFrame:
    """How alike each long item and the next one are."""
    x = long_items(t)
    pairs = x.alias("a").join(x.withColumn("id", F.col("id") - 1).alias("b"), "id")
    side = lambda s: {k: F.col(f"{s}.{k}") for k in ("scenario", "mode", "event")}
    return pairs.select("id", T.long_score(side("a"), side("b")).alias("score"))


@query(f"""WITH {CLIPS} SELECT a.id, round((a.speakers = b.speakers)::INT + (a.is_talking = b.is_talking)::INT + (a.delivery = b.delivery)::INT + 0.05::DOUBLE * len(list_intersect(list_distinct(regexp_extract_all(lower(a.text), '[\\p{{L}}\\p{{N}}]+')), list_distinct(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}]+')))), 9) AS score
FROM clips a JOIN clips b ON a.video = b.video AND b.clip_index = a.clip_index + 1""")
def clip_scores(t: Tables) -> DataFrame:
    """How alike each clip and the next one of its video are."""
    x = clips(t)
    pairs = x.alias("a").join(x.withColumn("clip_index", F.col("clip_index") - 1).alias("b"), ["video", "clip_index"])
    side = lambda s: {k: F.col(f"{s}.{k}") for k in ("speakers", "is_talking", "delivery", "text")}
    return pairs.select("a.id", F.round(T.clip_score(side("a"), side("b")), 9).alias("score"))


_REC = """e AS (SELECT *, format('{:09d}', event_id) AS k, CASE user_id % 7 WHEN 0 THEN 'People  talking' WHEN 1 THEN 'a Speech' ELSE '' END AS seen FROM events)"""


def _records(t: Tables) -> DataFrame:
    seen = F.when(F.col("user_id") % 7 == 0, "People  talking").when(F.col("user_id") % 7 == 1, "a Speech").otherwise("")
    return t.events.select("*", F.format_string("%09d", "event_id").alias("k"), seen.alias("seen"))


@query(f"""WITH {_REC}, r AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'y' ELSE 'v' END || k AS key, CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, CASE WHEN user_id % 7 = 0 THEN 'multi_speaker' WHEN user_id % 7 = 1 THEN 'single_speaker' ELSE 'unknown' END AS mode,
 CASE WHEN user_id % 7 = 0 THEN 'people_talking' WHEN user_id % 7 = 1 THEN 'a_speech' ELSE event_type END AS second FROM e WHERE user_id % 3 <> 0)
SELECT 'lfav-' || split || '-' || key AS source_item_id, split, '/media/' || key || '.mp4' AS media_path, event_type AS primary_event, second AS secondary_event, mode AS speaker_mode, 'A long-form audio clip involving ' || event_type || '.' AS context_short,
 event_type || CASE WHEN user_id % 7 = 0 THEN ' then People talking' WHEN user_id % 7 = 1 THEN ' then a Speech' ELSE '' END AS event_sequence_text FROM r""")
def long_form_items(t: Tables) -> DataFrame:
    """Items of labelled files; ids stand in two columns, a third of the files is missing."""
    r = _records(t)
    key = F.concat(F.when(F.col("event_id") % 5 == 0, "y").otherwise("v"), "k")
    there = r.where("user_id % 3 <> 0").select(F.concat(F.lit("/media/"), key, F.lit(".mp4")).alias("path"), key.alias("stem"))
    there = there.unionByName(r.select(F.concat(F.lit("/media/"), key, F.lit(".txt")).alias("path"), key.alias("stem")))
    file = F.concat(F.lit("/notes/"), F.when(F.col("user_id") % 2 == 0, "train").otherwise("test"), F.lit("_labels.csv"))
    rows = r.select(F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("v"), "k")).alias("video_id"), F.concat(F.lit("y"), "k").alias("youtube_id"), F.col("event_type").alias("audio_label"), F.col("seen").alias("visual_label"), file.alias("file"))
    return loaders.long_form(rows, there).select("source_item_id", "split", "media_path", "primary_event", "secondary_event", "speaker_mode", "context_short", "event_sequence_text")


@query(f"""WITH {_REC}, r AS (SELECT *, CASE user_id % 4 WHEN 0 THEN 'HD-EPIC' ELSE 'EPIC' END AS d, CASE user_id % 4 WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM e WHERE user_id % 4 < 3)
SELECT lower(d) || '-' || k AS source_item_id, d AS source_dataset, split, '/b/' || k || '.wav' AS media_path, event_type AS primary_event, CASE WHEN user_id % 7 = 0 THEN 'people_talking' WHEN user_id % 7 = 1 THEN 'a_speech' ELSE 'unknown_event' END AS secondary_event, 'ego_kitchen' AS scenario_group FROM r""")
def kitchen_items(t: Tables) -> DataFrame:
    """Narrated sounds; files of other names aren't read, and of two media files of a name the last path counts."""
    r = _records(t)
    name = F.element_at(F.array(*map(F.lit, ("hd_sounds", "EPIC_validation", "audio_train", "notes"))), (F.col("user_id") % 4 + 1).cast("int"))
    rows = r.select(F.col("k").alias("narration_id"), F.col("event_type").alias("narration"), F.col("seen").alias("noun"), F.concat(F.lit("/n/"), name, F.lit(".csv")).alias("file"))
    there = r.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("d"), F.col("k").alias("stem")).select(F.concat(F.lit("/"), "d", F.lit("/"), "stem", F.lit(".wav")).alias("path"), "stem")
    return loaders.kitchen(rows, there).select("source_item_id", "source_dataset", "split", "media_path", "primary_event", "secondary_event", "scenario_group")


@query(f"""WITH {_REC} SELECT 'ego4d-' || k AS source_item_id, CASE WHEN user_id % 2 = 0 THEN 'val' ELSE 'train' END AS split, event_type AS primary_event, 'social_x' AS secondary_event,
 'A long-form Ego4D clip with conversation or activity context. Primary cue: ' || event_type || '. Secondary cue: social x.' AS context_rich, event_type || ' Social x' AS event_sequence_text FROM e WHERE user_id % 2 = 0 OR user_id % 3 = 0""")
def daily_items(t: Tables) -> DataFrame:
    r = _records(t)
    rows = r.select(F.col("k").alias("clip_uid"), F.when(F.col("user_id") % 2 == 0, "val").alias("split"), F.col("event_type").alias("text"), F.lit("Social x").alias("scenario"), F.when(F.col("user_id") % 2 == 0, "/j/social.json").when(F.col("user_id") % 3 == 0, "/j/AV_x.jsonl").otherwise("/j/other.json").alias("file"))
    there = r.select(F.concat(F.lit("/m/"), "k", F.lit(".MP4")).alias("path"), F.col("k").alias("stem"))
    return loaders.daily(rows, there).select("source_item_id", "split", "primary_event", "secondary_event", "context_rich", "event_sequence_text")


@query("""WITH d AS (SELECT *, 'd' || format('{:09d}', doc_id) || '_clip_' || (doc_id % 9) AS clip_name FROM documents WHERE doc_id % 10 >= 5 AND doc_id % 6 <> 5)
SELECT clip_name, 'd' || format('{:09d}', doc_id) AS video, '/c/' || clip_name || '.mp4' AS clip_path, CASE WHEN doc_id % 4 = 0 THEN 'benchmark' WHEN doc_id % 2 = 0 THEN 'sft' ELSE 'unassigned' END AS split, CASE WHEN length(source) > length(lang) THEN source ELSE lang END AS asr_text, lang AS caption_text,
 (n_chars % 7 + 1)::DOUBLE AS duration_seconds, 'neutral_speech' AS delivery_label, doc_id % 9 AS clip_index, 'A portrait-style video clip. ' || CASE WHEN doc_id % 2 = 1 THEN 'with a speaking subject' ELSE 'with no strong visible vocalization' END || '. and 1 visible speaker(s). Caption cues: ' || lang || '.' AS rich_context_text FROM d""")
def clip_items(t: Tables) -> DataFrame:
    """Clips with side documents under their own name or their video's; low scores and missing files are left out."""
    video = F.format_string("d%09d", "doc_id")
    d = t.documents.withColumn("video", video).withColumn("clip_name", F.concat_ws("_clip_", video, (F.col("doc_id") % 9).cast("string")))
    merged = d.select("clip_name", (F.col("doc_id") % 10 / 10).alias("clear"), F.lit("0.5").alias("dover"), F.lit("n/a").alias("conf"), (F.col("doc_id") % 2).alias("is_talking"), F.lit(None).cast("int").alias("clip_speaker_num"), F.lit(2).alias("start_seconds"), (F.col("n_chars") % 7 + 3).alias("end_seconds"), F.lit(0).alias("duration"))
    stem = F.when(F.col("doc_id") % 2 == 0, F.col("clip_name")).otherwise(F.col("video")).alias("stem")
    speech = d.select(stem, F.to_json(F.struct(F.col("lang").alias("a"), F.array("source", F.lit("")).alias("b"))).alias("doc"))
    captions = d.select(stem, F.to_json(F.struct(F.concat(F.lit(" "), "lang").alias("c"), F.lit("").alias("e"))).alias("doc"))
    members = {"benchmark": d.where("doc_id % 4 = 0").select("clip_name"), "sft": d.where("doc_id % 2 = 0").select("clip_name")}
    there = d.where("doc_id % 6 <> 5").select(F.concat(F.lit("/c/"), "clip_name", F.lit(".mp4")).alias("path"), F.col("clip_name").alias("stem"))
    found = loaders.clips(merged, speech, captions, members, there)
    return found.select("clip_name", "video", "clip_path", "split", "asr_text", "caption_text", "duration_seconds", "delivery_label", "clip_index", "rich_context_text")


@query("""WITH d AS (SELECT lang, source, n_chars FROM documents WHERE doc_id % 3 <> 0), x AS (SELECT unnest(['lang', 'source', 'count', 'long']) AS field, unnest([lang, source, NULL, NULL]) AS value, unnest([true, true, true, n_chars > 1500]) AS ok FROM d)
SELECT field, value, count(*) AS n FROM x WHERE ok GROUP BY ALL""")
def manifest_counts(t: Tables) -> DataFrame:
    """What a manifest says of the items that have audio."""
    audio = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 != 0, "x.wav").alias("audio_path"))
    return loaders.manifest_counts(loaders.manifest(t.documents, audio, "doc_id"), ["lang", "source"], {"long": F.col("n_chars") > 1500})


@query("""WITH r AS (SELECT 'tier' || (p_size % 2 + 1) AS tier, CASE p_size % 3 WHEN 0 THEN 'label' WHEN 1 THEN 'rank' ELSE 'index' END AS task_name, format('{:09d}', p_partkey) AS id, p_name, p_size, row_number() OVER (PARTITION BY p_size % 2, p_size % 3 ORDER BY p_partkey) AS e FROM part)
SELECT tier, task_name, id, 'items/' || task_name || '/' || format('{:02d}', e) || '_' || id AS item_dir, p_name AS prompt, CASE task_name WHEN 'label' THEN 'yes' WHEN 'rank' THEN '2 > 3 > 1' ELSE '2' END AS answer_key, CASE task_name WHEN 'rank' THEN 'candidate_1.wav,candidate_2.wav,candidate_3.wav' ELSE 'query.wav' END AS files FROM r WHERE e <= 6""")
def packet_items(t: Tables) -> DataFrame:
    """The six first items of each task, which are the packet's own number, with their answers and files."""
    kind = F.col("p_size") % 3
    name = F.when(kind == 0, "label").when(kind == 1, "rank").otherwise("index")
    rows = t.part.select(
        F.concat(F.lit("tier"), (F.col("p_size") % 2 + 1).cast("string")).alias("tier"), name.alias("task_name"), F.concat(F.lit("task_"), name).alias("task_dir"), F.format_string("%09d", "p_partkey").alias("id"), F.lit("").alias("prompt"), F.col("p_name").alias("query_text"),
        F.lit(None).cast("array<string>").alias("text_options"), F.lit(None).cast("array<string>").alias("label_space"), F.when(kind == 1, F.array(*map(F.lit, "abc"))).alias("candidate_audio_paths"), F.when(kind != 1, "q").alias("query_audio_path"), F.lit(None).cast("string").alias("prompt_audio_path"),
        F.when(kind == 0, "yes").alias("gold_label"), F.when(kind == 1, F.array(*map(F.lit, (1, 2, 0)))).alias("gold_ranking"), F.when(kind == 2, 1).alias("gold_index"),
    )
    picked = packets.chosen(rows, 6)
    files = packets.assets(picked).groupBy("item_dir").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("files"))
    shown = packets.items(picked).select("tier", "task_name", "id", "item_dir", "prompt")
    return shown.join(packets.key(picked).withColumnRenamed("item_id", "id"), ["task_name", "id"]).join(files, "item_dir")


@query("SELECT lang, metric, n, round(mean, 6) AS mean FROM (SELECT lang, 'length' AS metric, count(*) AS n, avg(n_chars) AS mean FROM documents GROUP BY lang UNION ALL SELECT lang, 'odd', count(*), avg(doc_id % 2) FROM documents GROUP BY lang)")
def metric_means(t: Tables) -> DataFrame:
    """Every metric's mean; notes and golds among them aren't metrics."""
    metrics = F.create_map(F.lit("length"), F.col("n_chars").cast("string"), F.lit("odd"), (F.col("doc_id") % 2).cast("string"), F.lit("gold"), F.lit("1"), F.lit("note"), "source")
    return M.metric_means(t.documents.select("lang", metrics.alias("metrics")), ["lang"]).withColumn("mean", F.round("mean", 6))


@query("SELECT p_brand AS label, count(*) AS n, sum(regexp_matches(lower(p_name), 'people|person|man|woman|boy|girl|human|crowd|audience|child|adult')::INT)::BIGINT AS flagged FROM part GROUP BY p_brand")
def label_histogram(t: Tables) -> DataFrame:
    return M.label_histogram(t.part, "p_brand", T.people_priority("p_name"))


@query("SELECT count(*) AS n FROM part WHERE p_size % 3 <> 0")
def line_counts(t: Tables) -> DataFrame:
    """Lines that aren't blank, over all files of a folder."""
    path = t.new_folder()
    t.part.select(F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_name")).alias("value")).write.mode("overwrite").text(path)
    return readers.line_count(t.spark, path).agg(F.sum("n").alias("n"))
