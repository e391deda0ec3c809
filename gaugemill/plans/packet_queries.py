"""Queries of what is made in rounds or as it arrives: lists of any shape, cue packets, streamed means, rendered sounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import prompts, text as T
from ..operators import media, pools
from ..sources import readers
from ..streaming import scoring
from . import packets
from .bindings import LABEL_ROWS, digest_sql, label_rows
from .registry import Tables, query

# A list a document: a text; objects under one key or several, some of them empty; a number beside an object; an object without
# a video; no list.
SHAPES = ('["d%1$d", ""]', '[{"video_name": "d%1$d"}]', '[{"youtube_id": "", "video_id": "v%1$d", "clip_name": null, "clip": "d%1$d"}]', '[7, {"yt_id": 5, "name": "d%1$d"}, {"yt_id": 0, "name": "z"}]', '[{"clip": "d%1$d"}, null]', '{"clip_name": "d%1$d"}')
LISTS = "lists AS (SELECT doc_id, CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN replace('{s}', '%1$d', doc_id::VARCHAR)" for i, s in enumerate(SHAPES)) + " END AS j FROM documents)"
ENTRIES = f"""{LISTS}, v AS (SELECT doc_id, unnest(from_json(j, '["JSON"]')) AS e, generate_subscripts(from_json(j, '["JSON"]'), 1) - 1 AS pos FROM lists WHERE json_type(j) = 'ARRAY'),
n AS (SELECT doc_id, pos, CASE json_type(e) WHEN 'VARCHAR' THEN e->>'$' WHEN 'OBJECT' THEN coalesce({', '.join(f"nullif(nullif(e->>'{k}', ''), '0')" for k in readers.VIDEO_KEYS)}) END AS youtube_id,
 CASE json_type(e) WHEN 'VARCHAR' THEN e->>'$' WHEN 'OBJECT' THEN coalesce({', '.join(f"nullif(nullif(e->>'{k}', ''), '0')" for k in readers.CLIP_KEYS)}) END AS clip_name FROM v),
entries AS (SELECT * FROM n WHERE youtube_id IS NOT NULL AND clip_name IS NOT NULL)"""


def _lists(t: Tables) -> DataFrame:
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.documents.select("doc_id", F.replace(shape, F.lit("%1$d"), F.col("doc_id").cast("string")).alias("json"))


@query(f"WITH {ENTRIES} SELECT doc_id, pos::INT AS pos, youtube_id, clip_name FROM entries")
def list_entries(t: Tables) -> DataFrame:
    return readers.list_entries(_lists(t), "json")


@query(f"""WITH {ENTRIES}, a AS (SELECT DISTINCT clip_name FROM entries) SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'benchmark' WHEN l.doc_id IS NOT NULL THEN 'sft' WHEN a.clip_name IS NOT NULL THEN 'all' ELSE 'unassigned' END AS split
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 LEFT JOIN a ON a.clip_name = 'd' || d.doc_id""")
def membership_lists(t: Tables) -> DataFrame:
    """The split of every document by three kinds of lists, of which the first are of mixed shape."""
    named = lambda df, name: df.select(F.lit(name).alias("name"), F.format_string('["d%d"]', "doc_id").alias("json"))
    good = t.labels.where("quality = 1")
    files = _lists(t).select(F.lit("all").alias("name"), "json").unionByName(named(good, "sft")).unionByName(named(good.where("toxic = 1"), "benchmark"))
    items = t.documents.select("doc_id", F.format_string("d%d", "doc_id").alias("clip_name"))
    return readers.split_membership(items, "clip_name", readers.membership_lists(files, "name", "json")).select("doc_id", "split")


# Clips are turns; a label is said by the length of their text, and those have a sound whose number has a label.
TURNS = f"""turns AS (SELECT conv_id * 8 + turn AS id, CASE conv_id % 3 WHEN 0 THEN 'acknowledgment_cue_detection' WHEN 1 THEN 'clarification_question_detection' ELSE 'explicit_repair_cue_detection' END AS task_name,
 CASE conv_id % 3 WHEN 0 THEN CASE WHEN length(text) % 2 = 0 THEN '' ELSE 'not_' END || 'short_acknowledgment' WHEN 1 THEN CASE WHEN length(text) % 2 = 0 THEN '' ELSE 'not_' END || 'clarification_question' ELSE CASE WHEN length(text) % 2 = 0 THEN '' ELSE 'no_' END || 'explicit_repair_cue' END AS label,
 text, length(text) / 20.0::DOUBLE AS seconds, (turn % 3)::DOUBLE AS dover_score, (conv_id % 5)::DOUBLE AS clear_score FROM conversations),
points AS (SELECT *, CASE WHEN seconds BETWEEN 12 AND 22 THEN 5 ELSE 0 END + 3 + CASE WHEN label = 'short_acknowledgment' AND len(regexp_extract_all(text, '\\S+')) <= 3 THEN 6 WHEN label = 'clarification_question' AND regexp_matches(text, '{T.CLARIFY}') THEN 8 WHEN label = 'explicit_repair_cue' AND regexp_matches(text, '{T.REPAIR}') THEN 8 ELSE 0 END AS points
 FROM turns WHERE NOT regexp_matches(text, '{T.PROFANITY}') AND trim(text) <> ''),
made AS (SELECT p.*, l.doc_id IS NOT NULL AS made, sum((l.doc_id IS NOT NULL)::INT) OVER (PARTITION BY p.task_name, p.label ORDER BY p.points DESC, p.dover_score DESC, p.clear_score DESC, p.id ROWS UNBOUNDED PRECEDING) AS ordinal FROM points p LEFT JOIN labels l ON l.doc_id = p.id)"""


def _cue_packet(t: Tables) -> dict[str, DataFrame]:
    yes = F.length("text") % 2 == 0
    task, label = F, F
    for i, (name, (positive, negative)) in enumerate(packets.cue_labels().items()):
        task, label = task.when(F.col("conv_id") % 3 == i, name), label.when(F.col("conv_id") % 3 == i, F.when(yes, positive).otherwise(negative))
    clips = t.conversations.select(task.alias("task_name"), label.alias("label"), "text", (F.length("text") / 20.0).alias("seconds"), (F.col("turn") % 3).alias("dover_score"), (F.col("conv_id") % 5).alias("clear_score"), (F.col("conv_id") * 8 + F.col("turn")).alias("source_item_id"))
    sounds = t.labels.select(F.col("doc_id").alias("source_item_id"), F.lit(True).alias("_heard"))

    def heard(rows: DataFrame) -> DataFrame:
        return rows.join(sounds, "source_item_id", "left").withColumn("error", F.when(F.col("_heard").isNull(), "no sound")).drop("_heard")

    return packets.cue_packet(clips, heard)


@query(f"WITH {TURNS} SELECT printf('%s_%s_%02d', task_name, label, ordinal) AS item_id, 'items/' || task_name || '/' || printf('%s_%s_%02d', task_name, label, ordinal) || '/query.wav' AS audio_file, label AS gold_label, id AS source_item_id, text AS transcript_private FROM made WHERE made AND ordinal <= 6")
def cue_packet(t: Tables) -> DataFrame:
    """The packet's items beside their key: of every label the six best clips that have a sound, its own number."""
    made = _cue_packet(t)
    return made["items"].select("item_id", "audio_file").join(made["answers"].select("item_id", "gold_label", "source_item_id", "transcript_private"), "item_id")


@query(f"WITH {TURNS} SELECT task_name, label, id AS source_item_id, 'no sound' AS error FROM made WHERE NOT made AND ordinal < 6")
def cue_packet_failures(t: Tables) -> DataFrame:
    """Clips that were tried before their label was full and have no sound."""
    return _cue_packet(t)["failures"]


@query(f"WITH {LABEL_ROWS} SELECT 'task_' || lang AS task_dir, count(*)::BIGINT AS n, round(avg((gold_label = CASE WHEN (predicted_index = 1) = (doc_id % 3 <> 0) THEN 'high' ELSE 'low' END)::INT), 9) AS mean FROM label_rows GROUP BY lang")
def streamed_means(t: Tables) -> DataFrame:
    """Means by task of predictions that come in two lots, a third of them revised by the second, which also holds lines older
    than those before and repeats some; the stream is stopped and started again between the lots."""
    folder = t.new_folder()
    lines = label_rows(t).select(F.concat(F.lit("task_"), "lang").alias("task_dir"), F.col("doc_id").cast("string").alias("id"), "label_space", "gold_label", "predicted_index", F.timestamp_seconds(F.col("doc_id") + 1000000).alias("ts"), "doc_id")
    other = lines.withColumn("predicted_index", 1 - F.col("predicted_index"))
    later, older = (other.withColumn("ts", F.timestamp_seconds(F.col("doc_id") + F.lit(s))) for s in (2000000, 0))
    second = later.where("doc_id % 3 = 0").unionByName(older.where("doc_id % 5 = 0")).unionByName(lines.where("doc_id % 7 = 0"))
    for lot in (lines, second):
        lot.drop("doc_id").write.mode("append").json(f"{folder}/in")
        scoring.run_available(scoring.revisions(scoring.scored(t.spark, f"{folder}/in")), f"{folder}/out", f"{folder}/state").awaitTermination()
    return scoring.means(t.spark, f"{folder}/out").withColumn("mean", F.round("mean", 9))


# Sounds are vectors at 100 samples a second; a pair's two orders are joined with a pause, mixed at unlike volumes, and trimmed.
SOUNDS = f"""o AS (SELECT vec_id, [floor(e::DOUBLE * 8192) for e in embedding] AS q, row_number() OVER (ORDER BY {digest_sql(11, 'vec_id')}, vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings),
p AS (SELECT a.vec_id AS first, z.vec_id AS second, a.q AS u, z.q AS v FROM o a JOIN o z ON z.i = (a.i + 1) % a.n WHERE a.n > 1),
x AS (SELECT first || '_ab' AS path, list_concat(u, [0.0::DOUBLE for k in range(25)], v) AS x FROM p UNION ALL SELECT first || '_ba', list_concat(v, [0.0::DOUBLE for k in range(25)], u) FROM p
 UNION ALL SELECT first || '_mix', [round_even(u[k] + 0.35::DOUBLE * v[k], 0) for k in range(1, 51)] FROM p UNION ALL SELECT first || '_trim', u[1:30] FROM p),
f AS (SELECT path, x, len(x) AS n, unnest(range(0, greatest(1, len(x) - 63), 32)) AS s FROM x),
e AS (SELECT path, s, sqrt(list_sum([(v / 32768) * (v / 32768) for v in x[s + 1:least(s + 64, n)]]) / (least(s + 64, n) - s)) AS energy FROM f),
d AS (SELECT *, energy - lag(energy) OVER w AS rise, energy - avg(energy) OVER (PARTITION BY path) AS even FROM e WINDOW w AS (PARTITION BY path ORDER BY s)),
l AS (SELECT *, even * lead(even) OVER w AS one, even * lead(even, 2) OVER w AS two FROM d WINDOW w AS (PARTITION BY path ORDER BY s)),
g AS (SELECT path, greatest(0, coalesce(max(rise), 0)) AS onset, CASE WHEN sum(even * even) > 1e-9 THEN greatest(0, coalesce(sum(one) / sum(even * even), 0), coalesce(sum(two) / sum(even * even), 0)) ELSE 0 END AS peak FROM l GROUP BY path)
SELECT path, len(x) / 100.0::DOUBLE AS duration_sec, round(sqrt(list_sum([(v / 32768) * (v / 32768) for v in x]) / len(x)), 6) AS rms, round(onset, 6)::DOUBLE AS onset_strength, round(peak, 6)::DOUBLE AS periodicity_score,
 round(list_sum([((x[k] >= 0) <> (x[k + 1] >= 0))::INT for k in range(1, len(x))]) / greatest(1, len(x) / 100.0::DOUBLE), 6)::DOUBLE AS zero_crossing_rate FROM x JOIN g USING (path)"""


@query(f"WITH {SOUNDS}")
def rendered_sounds(t: Tables) -> DataFrame:
    """Features of rendered sounds: every vector joined to its next one, before and after it, mixed with it, and cut short.
    The joined ones are rendered first, and left as they are by the run over all."""
    folder = t.new_folder()
    sample = F.transform("embedding", lambda e: F.floor(e.cast("double") * 8192).cast("int"))
    sounds = t.embeddings.select(F.col("vec_id").cast("string").alias("path"), media.wav(sample, F.lit(100)).alias("content"))
    pairs = pools.cyclic_pairs(t.embeddings.select("vec_id"), "vec_id", 11, 1)

    def job(name: str, how: str, first: str, second: str, volume: float, seconds: float | None):
        part = lambda c: F.col(c).cast("string")
        return F.struct(F.format_string(f"%d_{name}", "vec_id").alias("path"), F.lit(how).alias("how"), part(first).alias("first"), part(second).alias("second"), F.lit(1.0).alias("volume_first"), F.lit(volume).alias("volume_second"), F.lit(seconds).cast("double").alias("seconds"), F.lit(0.25).alias("gap"))

    asked = F.array(job("ab", "join", "vec_id", "candidate", 1.0, 1.2), job("ba", "join", "candidate", "vec_id", 1.0, 1.2), job("mix", "mix", "vec_id", "candidate", 0.35, 0.5), job("trim", "trim", "vec_id", "candidate", 1.0, 0.3))
    jobs = pairs.select(F.explode(asked).alias("j")).select("j.*")
    media.render(jobs.where("how = 'join'"), sounds, f"{folder}/sounds")
    media.render(jobs, sounds, f"{folder}/sounds")
    told = t.spark.read.parquet(f"{folder}/sounds").select("path", media.audio_features("content").alias("f"))
    return told.select("path", *(F.round(f"f.{c}", 6).alias(c) for c in media.NUMBERS))


NOISES = (prompts.NEARBY, prompts.VEHICLES, "Music", *prompts.MACHINES, "None")
PLACES = (*prompts.STREETS, *prompts.PUBLIC, "Office")
ASKED = (prompts.SIDE_TALK, prompts.TOOL_CALL, "grounding", "closed_book")


def _wearable(t: Tables) -> DataFrame:
    """Documents as recordings: tasks, noises, places and angles in turn."""
    nth = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    said = {"_noise_type": nth(NOISES), "location": nth(PLACES), "bystander__y_n_": nth(("No", "Yes", "Yes")), "noise_level": nth((prompts.LOUD, "Quiet", "Normal")), "environment": nth(("Indoors", "Outdoors")), "partner_position": nth(("0", "60", "-60", "-30", "90")), "partner_distance": nth(("1.5m", "3m", "1.5m"))}
    meta = F.create_map(*(c for k, v in said.items() for c in (F.lit(k), v)))
    return t.documents.select("doc_id", F.format_string("d%d_%s", "doc_id", nth((*prompts.BYSTANDERS, "none"))).alias("id"), nth(ASKED).alias("task"), meta.alias("meta"), "text")


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _nth(values: tuple[str, ...]) -> str:
    return f"{_listed(values)}[doc_id % {len(values)} + 1]"


WEARABLE = f"""w AS (SELECT doc_id, 'd' || doc_id || '_' || {_nth((*prompts.BYSTANDERS, 'none'))} AS id, {_nth(ASKED)} AS task, {_nth(NOISES)} AS noise, {_nth(PLACES)} AS place, {_nth(('No', 'Yes', 'Yes'))} AS bystander, {_nth((prompts.LOUD, 'Quiet', 'Normal'))} AS level,
 {_nth(('Indoors', 'Outdoors'))} AS environment, {_nth(('0', '60', '-60', '-30', '90'))} AS angle, {_nth(('1.5m', '3m', '1.5m'))} AS distance, text FROM documents)"""


@query(f"""WITH {WEARABLE} SELECT doc_id, concat_ws(',', CASE WHEN task = '{prompts.SIDE_TALK}' AND bystander = 'Yes' AND regexp_matches(id, 'bystander|unrelated|partner') THEN 'bystander_side_talk' END, CASE WHEN task = '{prompts.SIDE_TALK}' AND noise = '{prompts.NEARBY}' THEN 'nearby_side_conversation' END,
 CASE WHEN noise = '{prompts.VEHICLES}' OR list_contains({_listed(prompts.STREETS)}, place) THEN 'vehicle_or_street_context' END, CASE WHEN list_contains({_listed(prompts.MACHINES)}, noise) THEN 'construction_or_machine_noise' END, CASE WHEN noise = 'Music' OR list_contains({_listed(prompts.PUBLIC)}, place) THEN 'music_or_cafe_context' END,
 CASE WHEN task <> 'closed_book' AND list_contains({_listed(prompts.ANGLES)}, angle) AND distance = '1.5m' THEN 'orientation_distance_context' END) AS contrast,
 concat_ws(',', CASE WHEN task = '{prompts.SIDE_TALK}' AND noise = '{prompts.NEARBY}' THEN 'side_talk_nearby_conversation' END, CASE WHEN task = '{prompts.SIDE_TALK}' AND bystander = 'Yes' THEN 'side_talk_with_bystander' END, CASE WHEN task = 'tool_call' AND level = '{prompts.LOUD}' THEN 'tool_call_noisy_environment' END,
 CASE WHEN noise = '{prompts.VEHICLES}' THEN 'traffic_or_vehicle_noise' END, CASE WHEN noise = 'Music' OR list_contains({_listed(prompts.PUBLIC)}, place) THEN 'music_or_public_space_noise' END, CASE WHEN environment = 'Indoors' AND level = 'Quiet' AND task <> '{prompts.SIDE_TALK}' THEN 'indoor_quiet_control' END) AS demo FROM w""")
def category_rules(t: Tables) -> DataFrame:
    """The categories of every recording by both sets of rules."""
    joined = lambda rules: F.array_join(prompts.categories(rules), ",")
    return _wearable(t).select("doc_id", joined(prompts.contrast_rules()).alias("contrast"), joined(prompts.demo_rules()).alias("demo"))


def _asked_sql(kind: str) -> str:
    side, tool, other = (q.replace("'", "''") for q in prompts.QUESTIONS[kind])
    return f"CASE task WHEN '{prompts.SIDE_TALK}' THEN '{side}' WHEN '{prompts.TOOL_CALL}' THEN '{tool}' ELSE '{other}' END"


def _filled_sql(template: str, *parts: str) -> str:
    first, *rest = template.replace("'", "''").split("%s")
    return " || ".join([f"'{first}'", *(f"{part} || '{text}'" for part, text in zip(parts, rest, strict=True))])


@query(f"""WITH {WEARABLE} SELECT doc_id, md5({_filled_sql(prompts.DECIDE, "''", _asked_sql('decide'))}) AS decide, md5({_filled_sql(prompts.SPEAK, "(" + _filled_sql(prompts.METADATA, "place") + ")", _asked_sql('speak'))}) AS speak,
 md5({_filled_sql(prompts.DIAGNOSE, "(" + _filled_sql(prompts.METADATA_TOLD, "noise") + ")", "id", "coalesce(text, '')")}) AS diagnosis FROM w""")
def prompt_texts(t: Tables) -> DataFrame:
    """Digests of every recording's prompts: a decision without metadata, a spoken reply and a diagnosis with it."""
    rows = _wearable(t).select("*", F.col("meta")["location"].alias("place"), F.col("meta")["_noise_type"].alias("noise"))
    return rows.select("doc_id", F.md5(prompts.prompt("task", "decide")).alias("decide"), F.md5(prompts.prompt("task", "speak", "place")).alias("speak"), F.md5(prompts.diagnosis("id", "text", "noise")).alias("diagnosis"))
