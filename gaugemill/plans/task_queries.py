"""Queries of task builders, plug-in models and file round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import models, scoring as P
from ..sources import readers, writers
from ..functions import text as T
from . import tasks
from .bindings import CLIP_SCORE, CLIPS, LABEL_ROWS, LONG_ITEMS, SRC_ITEMS, clips, digest_sql, draw_sql, label_rows, long_items, src_items
from .evaluation_queries import SCORED
from .registry import Tables, query


def _mixed(options: list[str], seed: int, extra: str = "") -> str:
    """SQL that shuffles option columns of ``o`` as the builders do."""
    return f"""u AS (SELECT id, unnest([{', '.join(options)}]) AS v, unnest({list(range(len(options)))}) AS i FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {digest_sql(seed, 'id', 'i')}, i) - 1 AS k FROM u){extra}
SELECT id, string_agg(v::VARCHAR, ',' ORDER BY k) AS options, max(CASE WHEN i = 0 THEN k END)::BIGINT AS gold_index FROM k GROUP BY id"""


def _flat(df: DataFrame, column: str = "options") -> DataFrame:
    return df.select("id", F.array_join(F.transform(column, lambda v: v.cast("string")), ",").alias("options"), "gold_index")


@query(f"""WITH {SRC_ITEMS} SELECT id, g AS gold_label, v AS volume, w AS other_volume FROM src_items,
(SELECT unnest(['foreground', 'background', 'absent']) AS g, unnest([1.0, 0.25, 0.0]::DOUBLE[]) AS v, unnest([0.35, 1.0, 1.0]::DOUBLE[]) AS w)""")
def task_three_way(t: Tables) -> DataFrame:
    return tasks.foreground(src_items(t)).select("id", "gold_label", "volume", "other_volume")


@query(f"""WITH {SCORED}, near AS (SELECT id, candidate FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate) <= 3) QUALIFY row_number() OVER (PARTITION BY id ORDER BY {digest_sql(5, 'id', 'candidate')}, candidate) = 1),
far AS (SELECT id, candidate FROM (SELECT q.id, q.candidate FROM q JOIN near USING (id) WHERE q.candidate <> near.candidate QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY score, q.candidate) <= 3) QUALIFY row_number() OVER (PARTITION BY id ORDER BY {digest_sql(5, 'id', 'candidate')}, candidate) = 1),
u AS (SELECT id, unnest([near.id, near.candidate, far.candidate]) AS v, unnest([0, 1, 2]) AS i FROM near JOIN far USING (id)),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {digest_sql(5, 'id', 'i')}, i) - 1 AS k FROM u)
SELECT id, string_agg(v::VARCHAR, ',' ORDER BY k) AS options, string_agg(k::VARCHAR, '>' ORDER BY i) AS gold_ranking FROM k GROUP BY id""")
def task_ranking(t: Tables) -> DataFrame:
    rows = tasks.plausibility_ranking(src_items(t), 5)
    text = lambda c: F.transform(c, lambda v: v.cast("string"))
    return rows.select("id", F.array_join(text("candidates"), ",").alias("options"), F.array_join(text("gold_ranking"), ">").alias("gold_ranking"))


_NEXT = "n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY clip_index, id) AS n FROM clips), r AS (SELECT a.id, b.id AS right_ FROM n a JOIN n b ON a.video = b.video AND b.n = CASE WHEN a.n = 1 THEN 2 ELSE 1 END)"


def _one(pool: str, seed: int) -> str:
    return f"(SELECT id, candidate AS wrong FROM {pool} QUALIFY row_number() OVER (PARTITION BY id ORDER BY {digest_sql(seed, 'id', 'candidate')}, candidate) = 1)"


_ALIKE = f"""b AS (SELECT *, CASE WHEN duration < 2.5 THEN 'short' WHEN duration < 5 THEN 'medium' ELSE 'long' END AS bucket, list_distinct(string_split(caption, ' ')) AS w FROM clips),
least_ AS (SELECT a.id, z.id AS candidate FROM b a JOIN b z ON a.id <> z.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {CLIP_SCORE}, z.id) <= 8)"""


@query(f"""WITH {CLIPS}, {_NEXT}, {_ALIKE},
near AS (SELECT a.id, z.id AS candidate FROM b a JOIN b z ON a.speakers = z.speakers AND a.is_talking = z.is_talking AND a.delivery = z.delivery AND a.bucket = z.bucket AND a.video <> z.video QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {CLIP_SCORE}, z.id) <= 8),
w AS (SELECT * FROM {_one('near', 6)} UNION ALL SELECT * FROM {_one('least_', 6)} WHERE id NOT IN (SELECT id FROM near)), o AS (SELECT id, right_, wrong FROM r JOIN w USING (id)),
{_mixed(['right_', 'wrong'], 6)}""")
def task_dyadic(t: Tables) -> DataFrame:
    return _flat(tasks.dyadic(clips(t), 6))


_LONG_TEXT = "len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) >= 4"


def _continued(differ: str, seed: int, clips: str = CLIPS, own: str = "true") -> str:
    """Clips with a text that agrees in count, delivery and duration, and one that doesn't in ``differ``."""
    same = " AND ".join(f"a.{c} = z.{c}" for c in ("speakers", "delivery", "bucket") if c != differ)
    return f"""{clips}, {_ALIKE}, l AS (SELECT * FROM b WHERE {_LONG_TEXT}),
same_ AS (SELECT a.id, z.id AS candidate FROM l a JOIN l z ON {same} AND a.{differ} = z.{differ} AND a.video <> z.video WHERE a.{own} QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {CLIP_SCORE} DESC, z.id DESC) <= 8),
other_ AS (SELECT a.id, z.id AS candidate FROM l a JOIN l z ON {same} AND a.{differ} <> z.{differ} AND a.video <> z.video WHERE a.{own} QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {CLIP_SCORE}, z.id) <= 8),
o AS (SELECT id, x.wrong AS right_, y.wrong FROM {_one('same_', seed)} x JOIN {_one('other_', seed)} y USING (id))""".replace("a.true", "true")


#: Clips with the delivery that their texts tell of, as the second tier takes them.
TOLD = CLIPS.replace("clips AS", "raw AS") + """, clips AS (SELECT * EXCLUDE (delivery), CASE WHEN regexp_matches(lower(text), 'laugh|chuckle|giggle') THEN 'laughter' WHEN regexp_matches(lower(text), 'shout|yell|scream|cheer') THEN 'high_energy'
 WHEN regexp_matches(lower(text), 'whisper|murmur|soft|quietly') THEN 'soft' ELSE 'neutral_speech' END AS delivery FROM raw)"""
#: Deliveries of the four classes by the role and the turn, so that all occur; one turn in five has none.
ACTED = CLIPS.replace("clips AS", "raw AS") + f", clips AS (SELECT * EXCLUDE (delivery), CASE WHEN clip_index % 5 = 4 THEN 'other' ELSE list_extract({list(tasks.DELIVERIES)}, (length(text) % 4 + 1)::INT) END AS delivery FROM raw)"


@query(f"WITH {_continued('delivery', 8, ACTED, 'delivery <> ' + repr('other'))}, {_mixed(['right_', 'wrong'], 8)}")
def task_delivery_continuation(t: Tables) -> DataFrame:
    acted = F.when(F.col("clip_index") % 5 == 4, "other").otherwise(F.get(F.array(*map(F.lit, tasks.DELIVERIES)), (F.length("text") % 4).cast("int")))
    return _flat(tasks.continuation(clips(t).withColumn("delivery", acted), "delivery", "delivery_conditioned_continuation", 8))


@query(f"WITH {LABEL_ROWS} SELECT lang, count(*) AS n, round(avg((gold_label = 'low')::INT), 9) AS accuracy FROM label_rows GROUP BY lang")
def model_plugin(t: Tables) -> DataFrame:
    """A plug-in model over batches of rows: it always takes the first option."""
    rows = label_rows(t).drop("predicted_index")
    made = models.predict(rows, models.backend("first"), ["doc_id", "lang", "label_space", "gold_label"])
    metric = P.label_metrics(F.col("label_space"), F.col("predicted_index"), F.col("gold_label"))["primary_metric"]
    return made.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(metric), 9).alias("accuracy"))


@query("SELECT p_partkey::VARCHAR AS id, p_name AS prompt, (p_size % 2)::BIGINT AS gold_index FROM part")
def jsonl_roundtrip(t: Tables) -> DataFrame:
    path = t.new_folder()
    writers.jsonl(t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("prompt"), (F.col("p_size") % 2).cast("bigint").alias("gold_index")), path)
    return readers.jsonl(t.spark, path, "id string, prompt string, gold_index bigint").select("id", "prompt", "gold_index")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand FROM part")
def csv_roundtrip(t: Tables) -> DataFrame:
    path = t.new_folder()
    writers.csv(t.part.select("p_partkey", "p_name", "p_brand"), path)
    return readers.csv(t.spark, path, ["p_partkey", "p_name", "p_brand"])


_PICKS = "p AS (SELECT id, candidate, row_number() OVER (PARTITION BY id ORDER BY {d}, candidate) AS pick FROM (SELECT * FROM q {w} QUALIFY row_number() OVER (PARTITION BY id ORDER BY {o}, candidate) <= {cap}) QUALIFY pick <= {k})".format


@query(f"""WITH {SCORED}, {_PICKS(d=digest_sql(4, 'id', 'candidate'), o='score', w='', cap=9, k=3)}, o AS (SELECT id, max(CASE WHEN pick = 1 THEN candidate END) AS c1, max(CASE WHEN pick = 2 THEN candidate END) AS c2, max(CASE WHEN pick = 3 THEN candidate END) AS c3 FROM p GROUP BY id),
{_mixed(['id', 'c1', 'c2', 'c3'], 4)}""")
def task_target_sound(t: Tables) -> DataFrame:
    return _flat(tasks.target_sound(src_items(t), 4))


@query(f"""WITH {SCORED}, {_PICKS(d=digest_sql(4, 'id', 'candidate'), o='score DESC', w='', cap=3, k=1)}, o AS (SELECT id, candidate FROM p), {_mixed(['id', 'candidate'], 4)}""")
def task_acoustic_contrast(t: Tables) -> DataFrame:
    return _flat(tasks.acoustic_contrast(src_items(t), 4))


@query(f"""WITH {SCORED}, e AS (SELECT q.* FROM q JOIN src_items a ON a.id = q.id JOIN src_items z ON z.id = q.candidate WHERE a.name <> z.name AND z.id = (SELECT min(id) FROM src_items y WHERE y.name = z.name)),
{_PICKS(d=digest_sql(3, 'id', 'candidate'), o='score DESC', w='', cap=9, k=3).replace('FROM q ', 'FROM e ')}, n AS (SELECT p.id, pick, name FROM p JOIN src_items s ON s.id = p.candidate),
o AS (SELECT s.id, s.name, max(CASE WHEN pick = 1 THEN n.name END) AS c1, max(CASE WHEN pick = 2 THEN n.name END) AS c2, max(CASE WHEN pick = 3 THEN n.name END) AS c3 FROM n JOIN src_items s ON s.id = n.id GROUP BY s.id, s.name),
{_mixed(['name', 'c1', 'c2', 'c3'], 3)}""")
def task_hard_negatives(t: Tables) -> DataFrame:
    return _flat(tasks.hard_negatives(src_items(t), 3))


def _two_way_sql(source: str, first: str, options: tuple[str, str], bucket: str = "NULL") -> str:
    return f"WITH {source[0]} SELECT id, '{options[0]}|{options[1]}' AS options, CASE WHEN {first} THEN 0 ELSE 1 END::BIGINT AS gold_index, {bucket}::VARCHAR AS balance_bucket FROM {source[1]}"


def _two(df: DataFrame) -> DataFrame:
    return df.select("id", F.array_join("options", "|").alias("options"), "gold_index", "balance_bucket")


@query(_two_way_sql((SRC_ITEMS, "src_items"), "flag = 1", tasks.PERIODICITY))
def task_periodicity(t: Tables) -> DataFrame:
    return _two(tasks.periodicity(src_items(t)))


@query(_two_way_sql((SRC_ITEMS, "src_items"), "flag = 1", tasks.ONSET, "grp"))
def task_onset(t: Tables) -> DataFrame:
    return _two(tasks.onset_sharpness(src_items(t)))


@query(_two_way_sql((CLIPS, "clips"), "is_talking", tasks.SPEECH))
def task_speech_activity(t: Tables) -> DataFrame:
    return _two(tasks.speech_activity(clips(t)))


@query(_two_way_sql((CLIPS, "clips"), "speakers <= 1", tasks.SPEAKERS, "delivery || '|' || CASE WHEN duration < 2.5 THEN 'short' WHEN duration < 5 THEN 'medium' ELSE 'long' END"))
def task_speaker_count(t: Tables) -> DataFrame:
    return _two(tasks.speaker_count(clips(t)))


@query(f"""WITH {CLIPS}, d AS (SELECT id, CASE WHEN regexp_matches(lower(text), 'laugh|chuckle|giggle') THEN 'laughter' WHEN regexp_matches(lower(text), 'shout|yell|scream|cheer') THEN 'high_energy'
 WHEN regexp_matches(lower(text), 'whisper|murmur|soft|quietly') THEN 'soft' ELSE 'neutral_speech' END AS gold_label FROM clips) SELECT id, '{'|'.join(tasks.DELIVERY_OPTIONS)}' AS options, list_position({list(tasks.DELIVERIES)}, gold_label) - 1 AS gold_index FROM d""")
def task_delivery_style(t: Tables) -> DataFrame:
    rows = tasks.delivery_style(clips(t).withColumn("delivery", T.delivery("text")))
    return rows.select("id", F.array_join("options", "|").alias("options"), "gold_index")


#: Each item with one outside its group: of the m items there, in order, the (i modulo m)-th for the i-th item of all.
OTHER_GROUP = """b AS (SELECT id, name, grp, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () - count(*) OVER (PARTITION BY grp) AS m FROM src_items), g AS (SELECT DISTINCT grp FROM b),
o AS (SELECT g.grp, b.id AS candidate, b.name AS other, b.grp AS other_grp, row_number() OVER (PARTITION BY g.grp ORDER BY b.i) - 1 AS k FROM g JOIN b ON b.grp <> g.grp),
c AS (SELECT b.id, b.name, b.grp, candidate, other, other_grp FROM b JOIN o ON o.grp = b.grp AND o.k = b.i % b.m)"""


@query(f"WITH {SRC_ITEMS}, {OTHER_GROUP} SELECT id, candidate, {draw_sql('2', 2, 'id')} AS gold_index, grp || '__' || other_grp AS balance_bucket FROM c")
def task_causal_order(t: Tables) -> DataFrame:
    return tasks.causal_order(src_items(t), 2).select("id", "candidate", "gold_index", "balance_bucket")


@query(f"""WITH {CLIPS}, l AS (SELECT * FROM clips WHERE {_LONG_TEXT}), {_NEXT.replace('FROM clips)', 'FROM l)')}, {_ALIKE}, w AS (SELECT x.* FROM {_one('least_', 7)} x JOIN l ON l.id = x.wrong),
o AS (SELECT id, right_, wrong FROM r JOIN w USING (id)), {_mixed(['right_', 'wrong'], 7)}""")
def task_turn_holding(t: Tables) -> DataFrame:
    return _flat(tasks.turn_holding(clips(t), 7))


@query(f"WITH {_continued('speakers', 9)}, {_mixed(['right_', 'wrong'], 9)}")
def task_speaker_continuation(t: Tables) -> DataFrame:
    return _flat(tasks.continuation(clips(t), "speakers", "speaker_count_aware_continuation", 9))


def _others(seed: int, k: int) -> str:
    """``k`` (up to three) draws without replacement from all long items of other events, or from all others if there are none."""
    r = lambda j: draw_sql(f"greatest(n - c - {j}, 1)", seed, "id", str(j))
    return f"""{LONG_ITEMS}, e AS (SELECT id, event, row_number() OVER (ORDER BY event, {digest_sql(seed + 1, 'id')}, id) - 1 AS pl FROM long_items),
s0 AS (SELECT event, min(pl) AS f, count(*) AS c FROM e GROUP BY event), n0 AS (SELECT count(*) AS n FROM e),
m0 AS (SELECT id, CASE WHEN n > c THEN f ELSE pl END AS f, CASE WHEN n > c THEN c ELSE 1 END AS c, n FROM e JOIN s0 USING (event), n0),
r0 AS (SELECT *, {r(0)} AS a, {r(1)} AS b, {r(2)} AS d FROM m0), r1 AS (SELECT *, b + (b >= a)::INT AS q FROM r0), r2 AS (SELECT *, d + (d >= least(a, q))::INT AS x FROM r1), r3 AS (SELECT *, x + (x >= greatest(a, q))::INT AS y FROM r2),
p0 AS (SELECT id, f, c, unnest(CASE WHEN n - c > {k} THEN [a, q, y][1:{k}] ELSE range(n - c) END) AS p, unnest(range(least(n - c, {k}))) + 1 AS pick FROM r3),
c AS (SELECT p0.id, e.id AS candidate, pick FROM p0 JOIN e ON e.pl = p + CASE WHEN p >= f THEN c ELSE 0 END)"""


@query(f"""WITH {_others(1, 3)}, o AS (SELECT id, max(CASE WHEN pick = 1 THEN candidate END) AS c1, max(CASE WHEN pick = 2 THEN candidate END) AS c2, max(CASE WHEN pick = 3 THEN candidate END) AS c3 FROM c GROUP BY id), {_mixed(['id', 'c1', 'c2', 'c3'], 1)}""")
def task_event_window(t: Tables) -> DataFrame:
    return _flat(tasks.event_window(long_items(t), 1))


@query(f"""WITH {_others(2, 3)}, o AS (SELECT id, max(CASE WHEN pick = 1 THEN candidate END) AS c1, max(CASE WHEN pick = 2 THEN candidate END) AS c2, max(CASE WHEN pick = 3 THEN candidate END) AS c3 FROM c GROUP BY id),
m AS ({_mixed(['id', 'c1', 'c2', 'c3'], 2).replace('u AS', 'WITH u AS', 1)}) SELECT m.*, text AS query_text FROM m JOIN long_items USING (id)""")
def task_event_retrieval(t: Tables) -> DataFrame:
    rows = tasks.event_retrieval(long_items(t), 2)
    return rows.select("id", F.array_join(F.transform("options", lambda v: v.cast("string")), ",").alias("options"), "gold_index", "query_text")


@query(f"""WITH {_others(3, 1)}, o AS (SELECT a.id, replace(a.event, '_', ' ') || ' followed by ' || replace(a.secondary, '_', ' ') AS right_, replace(z.event, '_', ' ') || ' followed by ' || replace(a.event, '_', ' ') AS wrong
FROM c JOIN long_items a ON a.id = c.id JOIN long_items z ON z.id = c.candidate), {_mixed(['right_', 'wrong'], 3)}""")
def task_sequential(t: Tables) -> DataFrame:
    return _flat(tasks.sequential(long_items(t), 3))


@query(f"""WITH {_others(4, 2)}, z AS (SELECT a.id, b.id AS candidate, min(CASE WHEN a.event = b.event THEN 0 ELSE 1 END) AS tag, any_value({digest_sql(4, 'b.id')}) AS h FROM long_items a JOIN long_items b ON (a.event = b.event OR a.scenario = b.scenario) AND a.id <> b.id GROUP BY ALL),
s AS (SELECT id, candidate AS right_ FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY tag, h, candidate) = 1),
o AS (SELECT s.id, right_, max(CASE WHEN pick = 1 THEN c.candidate END) AS c1, max(CASE WHEN pick = 2 THEN c.candidate END) AS c2 FROM s JOIN c USING (id) GROUP BY s.id, right_), {_mixed(['right_', 'c1', 'c2'], 4)}""")
def task_narrative(t: Tables) -> DataFrame:
    return _flat(tasks.narrative(long_items(t), 4))


_ALIKE_EVENT = f"""z AS (SELECT a.id, b.id AS candidate, min(CASE WHEN a.event = b.event THEN 0 ELSE 1 END) AS tag, any_value({digest_sql('{seed}', 'b.id')}) AS h FROM long_items a JOIN long_items b ON (a.event = b.event OR a.scenario = b.scenario) AND a.id <> b.id GROUP BY ALL),
s AS (SELECT id, candidate FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY tag, h, candidate) = 1)"""


@query(f"WITH {LONG_ITEMS}, {_ALIKE_EVENT.replace('{seed}', '5')} SELECT id, id || '__then__' || candidate || ',' || candidate || '__then__' || id AS options, 0::BIGINT AS gold_index FROM s ORDER BY id LIMIT 1024")
def task_coarse_order(t: Tables) -> DataFrame:
    """A budget of 1,024 items is the task's own."""
    return _flat(tasks.coarse_order(long_items(t), 1024, 5))


@query(f"WITH {LONG_ITEMS} SELECT id, mode || ',' || CASE WHEN mode = 'single_speaker' THEN 'multi_speaker' ELSE 'single_speaker' END AS options, 0::BIGINT AS gold_index FROM long_items WHERE mode <> 'unknown'")
def task_overlap(t: Tables) -> DataFrame:
    return _flat(tasks.overlap(long_items(t)))


@query(f"""WITH {CLIPS}, {_ALIKE}, p AS (SELECT id, candidate, row_number() OVER (PARTITION BY id ORDER BY {digest_sql(5, 'id', 'candidate')}, candidate) AS pick FROM least_ QUALIFY pick <= 3),
o AS (SELECT id, max(CASE WHEN pick = 1 THEN candidate END) AS c1, max(CASE WHEN pick = 2 THEN candidate END) AS c2, max(CASE WHEN pick = 3 THEN candidate END) AS c3 FROM p GROUP BY id), {_mixed(['id', 'c1', 'c2', 'c3'], 5)}""")
def task_phonic_target(t: Tables) -> DataFrame:
    return _flat(tasks.phonic_target(clips(t), 5))


def cue_candidates(t: Tables) -> DataFrame:
    label = F.when(F.length("text") % 2 == 0, "short_acknowledgment").otherwise("not_short_acknowledgment")
    return t.conversations.select(label.alias("label"), "text", (F.length("text") / 10.0).alias("seconds"), (F.col("turn") / 4.0).alias("clear_score"), (F.col("conv_id") % 7 / 7.0).alias("dover_score"), F.format_string("%d:%d", "conv_id", "turn").alias("source_item_id"))


@query("""WITH c AS (SELECT CASE WHEN length(text) % 2 = 0 THEN 'short_acknowledgment' ELSE 'not_short_acknowledgment' END AS label, text, length(text) / 10.0::DOUBLE AS seconds, turn / 4.0::DOUBLE AS clear_score, (conv_id % 7) / 7.0::DOUBLE AS dover_score, conv_id || ':' || turn AS source_item_id FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(seconds - 18), clear_score DESC, dover_score DESC, source_item_id) AS o FROM c WHERE NOT regexp_matches(text, '(?i)\\b(fuck|fucking|shit|bitch|cunt|dick|asshole)\\b') AND trim(text) <> '')
SELECT printf('acknowledgment_cue_detection_%s_%05d', label, o) AS id, label AS gold_label, least(greatest(seconds, 12), 24)::DOUBLE AS window_duration_seconds, source_item_id FROM k WHERE o <= 144""")
def task_cues(t: Tables) -> DataFrame:
    """The 144 best candidates of each label are the task's own number."""
    return tasks.cues(cue_candidates(t), "acknowledgment_cue_detection", 144).select("id", "gold_label", "window_duration_seconds", "source_item_id")
