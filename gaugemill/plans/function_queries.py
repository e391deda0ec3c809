"""Queries of functions, loaders, runs and scores that the other modules' queries don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import arrays as A, seeded, text as T
from ..operators import metrics as M, models, sampling as S, scoring as P
from ..sources import readers, writers
from . import pipelines, tasks
from .bindings import BIG_ROWS, CLIPS, LABEL_ROWS, MODEL_SCORES, SRC_ITEMS, big_rows, clips, digest_sql, draw_sql, label_rows, model_scores, src_items
from .evaluation_queries import _CI, _G, _P, MACRO, _replicates, _tried
from .registry import Tables, query

_TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')".format


@query("""SELECT page_id, url || '|' || html[1:90] || '|' || 'z' || '|' || page_id::VARCHAR || '|' || 'first by name' AS leaves, 5::BIGINT AS n FROM pages""")
def json_leaves(t: Tables) -> DataFrame:
    """Strings of nested documents in their order there, down to a depth of twelve; other values aren't leaves."""
    deep = F.col("page_id").cast("string")
    for _ in range(12):
        deep = F.struct(deep.alias("inner"))
    doc = F.to_json(F.struct(F.col("url").alias("u"), F.struct(F.array(F.struct(F.substring("html", 1, 90).alias("w"))).alias("a"), F.array(F.lit("z")).alias("b"), F.lit(5).alias("c")).alias("v"), deep.alias("x"), F.lit("first by name").alias("a")))
    found = T.string_leaves(t.pages.select("page_id", doc.alias("doc")), "doc")
    rows = found.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("path", "leaf"))).alias("s"), F.count("*").alias("n"))
    return rows.select("page_id", F.array_join(F.transform("s", lambda x: x["leaf"]), "|").alias("leaves"), "n")


_FILES = "f AS (SELECT DISTINCT coalesce(nullif(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'item') AS stem FROM pages)"


@query(f"""WITH {_FILES}, k AS (SELECT DISTINCT CASE WHEN length(stem) % 3 = 0 THEN stem WHEN length(stem) % 3 = 1 THEN stem[1:12] ELSE stem[6:] END AS key FROM f),
m AS (SELECT key, '/media/' || stem || '.wav' AS path, CASE WHEN stem = key THEN 0 WHEN starts_with(stem, key) THEN 1 ELSE 2 END AS kind FROM k JOIN f ON contains(stem, key))
SELECT key, path, kind FROM m WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY kind, path) = 1""")
def file_resolution(t: Tables) -> DataFrame:
    """Keys that are a file's whole name, its beginning, or a part of it, each with the file they stand for."""
    stems = t.pages.select(T.slug("url").alias("stem")).distinct()
    n = F.length("stem") % 3
    keys = stems.select(F.when(n == 0, F.col("stem")).when(n == 1, F.substring("stem", 1, 12)).otherwise(F.substring("stem", 6, 1 << 20)).alias("key")).distinct()
    return readers.resolved(keys, stems.withColumn("path", F.concat(F.lit("/media/"), "stem", F.lit(".wav"))), "key", ".wav")


@query("""SELECT doc_id, format('{:.4f}', n_chars / 7.0::DOUBLE) AS number, lang AS word, '' AS nothing, doc_id::VARCHAR AS sized, 'v' || doc_id AS short, 'v' || doc_id || '_clip_3' AS whole,
 CASE WHEN n_chars % 2 = 0 THEN 'None.' ELSE lang END AS narration, 'multiple_speakers|' || lang || '|true|long' AS signature FROM documents""")
def names_and_numbers(t: Tables) -> DataFrame:
    clip = F.format_string("v%d_clip_3", "doc_id")
    return t.documents.select(
        "doc_id", T.four_decimals(F.col("n_chars") / 7.0).alias("number"), T.four_decimals("lang").alias("word"), T.four_decimals(F.lit(None).cast("double")).alias("nothing"),
        T.video_id(F.format_string("%d_640x480_full_video_3", "doc_id")).alias("sized"), T.video_id(clip, short=True).alias("short"), T.video_id(clip).alias("whole"),
        T.narration(F.when(F.col("n_chars") % 2 == 0, " ").otherwise(F.col("lang"))).alias("narration"), T.controlled_signature(F.lit("multiple_speakers"), "lang", F.lit(True), F.lit("long")).alias("signature"),
    )


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, {_TOKENS('a.text')} AS x, {_TOKENS('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
o AS (SELECT conv_id, turn, len(list_intersect(list_distinct(x), list_distinct(y))) AS n, len(list_distinct(x)) AS nx, len(list_distinct(y)) AS ny, greatest(len(x), len(y)) AS most FROM p),
c AS (SELECT conv_id, turn, sum(least(nx, ny)) AS m FROM (SELECT conv_id, turn, z, sum(s = 1) AS nx, sum(s = 2) AS ny FROM (SELECT conv_id, turn, unnest(x) AS z, 1 AS s FROM p UNION ALL SELECT conv_id, turn, unnest(y), 2 FROM p) GROUP BY ALL) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN nx > 0 AND ny > 0 THEN n / (nx + ny - n) ELSE 0 END, 9)::DOUBLE AS overlap, round(CASE WHEN nx > 0 AND ny > 0 THEN coalesce(m, 0) / most ELSE 0 END, 9)::DOUBLE AS multiset, round(1 + n * 0.05::DOUBLE, 9) AS shared FROM o LEFT JOIN c USING (conv_id, turn)""")
def turn_overlaps(t: Tables) -> DataFrame:
    """Overlap, multiset similarity and shared traits of each turn's tokens and the next one's."""
    w = t.conversations.select("conv_id", "turn", T.tokens("text").alias("w"))
    pairs = w.select("conv_id", "turn", F.col("w").alias("x")).join(w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("y")), ["conv_id", "turn"])
    x, y = F.col("x"), F.col("y")
    traits = T.shared_traits({"video": F.col("conv_id"), "turn": F.col("turn")}, {"video": F.col("conv_id"), "turn": F.col("turn") + 1}, {"video": 1.0, "turn": 1.0}, (x, y), 0.05)
    return pairs.select("conv_id", "turn", F.round(T.overlap(x, y), 9).alias("overlap"), F.round(T.multiset_similarity(x, y), 9).alias("multiset"), F.round(traits, 9).alias("shared"))


@query("""WITH l AS (SELECT conv_id, turn, c, instr(upper(text), c) AS p FROM conversations, (SELECT unnest(['A', 'B', 'C']) AS c)), s AS (SELECT conv_id, turn, string_agg(ascii(c) - 65, ',' ORDER BY p) AS r, count(*) AS n FROM l WHERE p > 0 GROUP BY ALL)
SELECT c.conv_id, c.turn, coalesce(split_part(r, ',', 1)::BIGINT, 0) AS predicted_index, CASE WHEN n > 1 THEN r END AS predicted_ranking FROM conversations c LEFT JOIN s USING (conv_id, turn)""")
def answer_letters(t: Tables) -> DataFrame:
    """Free answers as choices among three letters."""
    rows = t.conversations.select("conv_id", "turn", P.choice(F.col("text"), 3).alias("c"))
    return rows.select("conv_id", "turn", F.col("c.predicted_index").alias("predicted_index"), F.array_join(F.transform("c.predicted_ranking", lambda v: v.cast("string")), ",").alias("predicted_ranking"))


@query("""SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'unknown' ELSE 'keep' END AS decision, CASE WHEN n_chars % 3 = 0 THEN 'no ' || lang ELSE lang END AS reason, source || '_' || lang AS event, lang AS context FROM documents""")
def replies_and_contexts(t: Tables) -> DataFrame:
    """Fenced JSON replies, plain ones among them; events' names and rows' contexts from the first value that isn't blank."""
    made = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit("keep").alias("decision"), F.col("lang").alias("reason"))), F.lit("\n```"))
    read = t.documents.withColumn("r", T.reply(F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit(" no "), "lang")).otherwise(made)))
    return read.select("doc_id", F.col("r.decision").alias("decision"), F.col("r.reason").alias("reason"), T.safe_event(F.lit(" "), F.concat_ws("  ", "source", F.upper("lang"))).alias("event"), T.row_context(F.lit(""), F.concat(F.lit(" "), "lang")).alias("context"))


@query(f"""WITH {SRC_ITEMS} SELECT id, replace(name, '_', ' ') AS phrase, split_part(name, '_', 1) AS group_key, '- Name: ' || name || chr(10) || '- Noise: unknown' AS bullets FROM src_items""")
def item_phrases(t: Tables) -> DataFrame:
    lines = T.bullets([("Name", F.col("name")), ("Place", F.lit("N/A")), ("Noise", F.lit(None).cast("string"))])
    return src_items(t).select("id", T.event_phrase("name").alias("phrase"), T.group_key("name").alias("group_key"), lines.alias("bullets"))


_SHAPES = f"""{LABEL_ROWS}, {SRC_ITEMS}, s AS (SELECT id, flag, [{draw_sql('10', 5, 'id', '0')}, {draw_sql('10', 5, 'id', '1')}, {draw_sql('10', 5, 'id', '2')}] AS v FROM src_items),
u AS (SELECT id, unnest(v) AS x, unnest([0, 1, 2]) AS i FROM s), r AS (SELECT id, i FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY x DESC, i) = 1)"""


@query(f"""WITH {_SHAPES}
SELECT 'l' || doc_id AS id, 'label' AS gold_kind, 'label:' || gold_label || '|bucket:' || lang AS gold_key, (gold_label = predicted_label)::INT::DOUBLE AS primary_metric FROM label_rows
UNION ALL SELECT 'r' || id, 'rank', 'rank0:1', (i = 1)::INT::DOUBLE FROM r
UNION ALL SELECT 'i' || id, 'index', 'index:' || flag, (i = flag)::INT::DOUBLE FROM s JOIN r USING (id)""")
def score_dispatch(t: Tables) -> DataFrame:
    """Label, ranking and index rows in one table, each scored by its own rule, with its gold's key."""
    none = lambda kind: F.lit(None).cast(kind)
    scores = F.array(*(seeded.draw(F.lit(10), 5, F.col("id"), F.lit(i)).cast("double") for i in range(3)))
    shape = lambda df, **c: df.select(*(c.get(k, none(v)).cast(v).alias(k) for k, v in SHAPE.items()))
    three = F.array(*map(F.lit, "abc"))
    labels = shape(label_rows(t), id=F.concat(F.lit("l"), F.col("doc_id").cast("string")), task_name=F.lit("t"), gold_label=F.col("gold_label"), label_space=F.col("label_space"), predicted_index=F.col("predicted_index"), balance_bucket=F.col("lang"))
    items = src_items(t).withColumn("s", scores).withColumn("id", F.col("id").cast("string"))
    ranks = shape(items, id=F.concat(F.lit("r"), "id"), task_name=F.lit(P.RANKING_TASK), gold_ranking=F.array(F.lit(1), F.lit(0), F.lit(2)), candidate_audio_paths=three, scores=F.col("s"))
    index = shape(items, id=F.concat(F.lit("i"), "id"), task_name=F.lit("t"), gold_index=F.col("flag"), text_options=three, scores=F.col("s"))
    scored = P.score(labels.unionByName(ranks).unionByName(index))
    key = P.gold_key(F.col("gold_label"), F.col("gold_ranking"), F.col("gold_index"), F.col("balance_bucket"))
    return scored.select("id", "gold_kind", key.alias("gold_key"), "primary_metric")


SHAPE = {
    "id": "string", "task_name": "string", "gold_label": "string", "gold_index": "bigint", "gold_ranking": "array<bigint>", "label_space": "array<string>", "text_options": "array<string>",
    "candidate_audio_paths": "array<string>", "scores": "array<double>", "predicted_ranking": "array<bigint>", "predicted_index": "bigint", "balance_bucket": "string",
}


@query(f"WITH {LABEL_ROWS} SELECT lang AS tier, 'task_' || source AS task_dir, source AS task_name, count(*) AS n FROM label_rows GROUP BY ALL")
def suite_round_trip(t: Tables) -> DataFrame:
    """A suite written as a directory for each task of each tier, walked again, with each task's own name."""
    path = t.new_folder()
    rows = label_rows(t).select(F.col("lang").alias("tier"), F.concat(F.lit("task_"), "source").alias("task_dir"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("task_name"), "label_space", "gold_label")
    writers.suite(rows, path)
    read = readers.suite(t.spark, path, "*.json")
    names = readers.task_names(read.withColumn("task_dir", F.concat_ws("/", "tier", "task_dir")))
    return names.select(F.split_part("task_dir", F.lit("/"), F.lit(1)).alias("tier"), F.split_part("task_dir", F.lit("/"), F.lit(2)).alias("task_dir"), "task_name", "n")


@query("SELECT page_id::VARCHAR AS youtube_id, '5' AS start_seconds, url AS label, 'train' AS split FROM pages")
def label_csv_round_trip(t: Tables) -> DataFrame:
    """Labels without a header, with blanks around values and a field too many."""
    path = t.new_folder()
    t.pages.select(F.concat(F.lit(" "), F.col("page_id").cast("string")), F.lit("5 "), F.concat("url", F.lit(" ")), F.lit("train"), F.lit("more")).write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.label_csv(t.spark, path)


@query("""SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'benchmark' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'sft' WHEN lang = 'en' THEN 'all' ELSE 'unassigned' END AS split FROM documents""")
def split_membership(t: Tables) -> DataFrame:
    members = {"benchmark": t.labels.where("toxic = 1").select("doc_id"), "sft": t.labels.select("doc_id"), "all": t.documents.where("lang = 'en'").select("doc_id")}
    return readers.split_membership(t.documents.select("doc_id", "lang"), "doc_id", members).select("doc_id", "split")


@query("""WITH r AS (SELECT conv_id::VARCHAR AS source_item_id, role AS display_name, 'a' || turn AS audio_path, text AS context_text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1) SELECT * FROM r""")
def source_pool(t: Tables) -> DataFrame:
    """The first row of each source item, with what it lacks taken from elsewhere."""
    sample = F.struct(F.format_string("a%d", "turn").alias("audio_path"), F.lit("").alias("short_context_text"))
    rows = t.conversations.select(F.col("conv_id").cast("string").alias("source_item_id"), F.lit("").alias("display_name"), F.col("role").alias("task_id"), sample.alias("positive_sample"), F.col("text").alias("context_text"), F.col("turn").alias("row_ord"))
    return readers.source_pool(rows)


@query(f"""WITH {MODEL_SCORES}, y AS (SELECT a.lang AS task_dir, a.doc_id, a.metric - b.metric AS m FROM model_scores a JOIN model_scores b USING (doc_id) WHERE a.model = 'model_1' AND b.model = 'model_0'),
x AS (SELECT * FROM y UNION ALL SELECT NULL, doc_id, m FROM y), {_replicates('x', ['task_dir'], 'm', 'doc_id', 60, 42)},
e AS (SELECT task_dir, {_CI}, {_P} FROM r GROUP BY task_dir), f AS (SELECT task_dir, count(*) AS n, round(avg(m), 9) AS observed_difference, {_G} FROM x GROUP BY task_dir)
SELECT f.*, ci_low, ci_high, p_value FROM f JOIN e ON f.task_dir IS NOT DISTINCT FROM e.task_dir""")
def run_comparison(t: Tables) -> DataFrame:
    """Two runs compared on the ids they share, by task and over all; of repeated ids the last row counts."""
    run = lambda m: model_scores(t).where(F.col("model") == m).select(F.col("lang").alias("task_dir"), F.col("doc_id").alias("id"), F.col("metric").alias("primary_metric"), F.lit(1).alias("row_ord"))
    stale = run("model_1").withColumn("primary_metric", F.lit(-9.0)).withColumn("row_ord", F.lit(0))
    made = pipelines.compare(run("model_1").unionByName(stale), run("model_0"), 60)
    return made.select("task_dir", "n", *(F.round(c, 9).alias(c) for c in ("observed_difference", "hedges_g", "ci_low", "ci_high", "p_value")))


@query(f"""WITH {LABEL_ROWS}, g AS (SELECT lang, doc_id, (gold_label = 'high')::BIGINT AS gold, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM label_rows), p AS (SELECT lang, predicted_index, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM label_rows WHERE doc_id % 2 = 0)
SELECT lang, count(*) AS n, round(avg(coalesce((p.predicted_index = g.gold)::INT, 0)), 9) AS accuracy FROM g LEFT JOIN p USING (lang, i) GROUP BY lang""")
def positional_scores(t: Tables) -> DataFrame:
    """Predictions met by their place in the task; gold rows beyond them count as wrong."""
    rows = label_rows(t).select("lang", F.col("doc_id").alias("row_ord"), F.col("doc_id").alias("id"), (F.col("gold_label") == "high").cast("long").alias("gold_index"), "predicted_index")
    made = pipelines.positional(rows.drop("predicted_index"), rows.where("id % 2 = 0").drop("gold_index"), ["lang"])
    return made.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("primary_metric"), 9).alias("accuracy"))


_KEPT = "SELECT w.task, w.id, w.gold_key FROM w JOIN f ON w.task = f.task AND w.size = f.size AND w.attempt = f.attempt WHERE rn = 1 AND violation <= 0"


@query(f"WITH {BIG_ROWS}, {_tried(400, 384, 16)} {_KEPT}")
def validated_subset(t: Tables) -> DataFrame:
    """The rows of each task's best sample that passes its gates; other tasks are dropped."""
    rows = big_rows(t).withColumnRenamed("task", "task_dir")
    kept, _ = pipelines.validated_subset(rows, 400, 384, 16)
    return kept.select(F.col("task_dir").alias("task"), "id", "gold_key")


@query(f"WITH {BIG_ROWS}, {_tried(400, 400, 4)} SELECT 'tier1' AS tier, task AS task_dir, 42 AS seed, 400 AS max_per_task, n, size, attempt::INT + 1 AS attempts, violation <= 0 AS kept FROM f JOIN a USING (task, size, attempt) WHERE rn = 1")
def release_manifest(t: Tables) -> DataFrame:
    """What a release says of every task of its one tier: its seed, size and attempts, and whether it was kept."""
    rows = big_rows(t).withColumn("tier", F.lit("tier1")).withColumnRenamed("task", "task_dir")
    _, notes = pipelines.release(rows, {"tier1": 400}, 4)
    return notes.select("tier", "task_dir", "seed", "max_per_task", "n", "size", "attempts", "kept")


@query("""SELECT task_name, count(*) AS n FROM (SELECT 'q' || l_linenumber AS task_name, l_linestatus FROM lineitem) WHERE task_name IN ('q1', 'q2', 'q3', 'q4') AND task_name <> 'q2' AND task_name <> 'q3' GROUP BY task_name""")
def allowed_tasks(t: Tables) -> DataFrame:
    """Tasks by a list of names, without those excluded or dropped before."""
    rows = t.lineitem.select(F.format_string("q%d", "l_linenumber").alias("task_name")).withColumn("task_dir", F.concat(F.lit("task_"), "task_name"))
    dropped = rows.where("task_name = 'q3'").select("task_dir")
    return pipelines.allowed_tasks(rows, ["q1", "q2", "q3", "q4"], ["q2"], dropped).groupBy("task_name").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, (CASE WHEN length(text) / 10.0 BETWEEN 12 AND 22 THEN 5 ELSE 0 END + CASE WHEN NOT regexp_matches(text, '(?i)\\b(fuck|fucking|shit|bitch|cunt|dick|asshole)\\b') THEN 3 ELSE 0 END
 + CASE WHEN role = 'user' AND len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) <= 3 THEN 6 ELSE 0 END)::INTEGER AS priority FROM conversations""")
def cue_priorities(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("seconds", F.length("text") / 10.0).withColumn("label", F.when(F.col("role") == "user", "short_acknowledgment").otherwise("not_short_acknowledgment"))
    return rows.select("conv_id", "turn", pipelines.cue_priority("text", "seconds", "acknowledgment_cue_detection", "label").alias("priority"))


@query(f"""WITH {SRC_ITEMS}, u AS (SELECT id, unnest([{draw_sql('10', 5, 'id', '0')}, {draw_sql('10', 5, 'id', '1')}, {draw_sql('10', 5, 'id', '2')}]) AS x, unnest([0, 1, 2]) AS i FROM src_items), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, i) AS k FROM u)
SELECT id, max(CASE WHEN k = 1 THEN i END)::BIGINT AS best, string_agg(i::VARCHAR, '>' ORDER BY k) AS ranking, flag || CASE flag WHEN 0 THEN '>1>2' ELSE '>0>2' END AS with_rest FROM r JOIN src_items USING (id) GROUP BY id, flag""")
def ranks_of_scores(t: Tables) -> DataFrame:
    """Best index and ranking of scores, ties to the first; and the ranking that an index alone stands for."""
    scores = F.array(*(seeded.draw(F.lit(10), 5, F.col("id"), F.lit(i)).cast("double") for i in range(3)))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ">")
    return src_items(t).select("id", A.argmax(scores).alias("best"), text(A.ranking(scores)).alias("ranking"), text(A.with_rest(F.col("flag"), F.lit(3))).alias("with_rest"))


@query("SELECT doc_id, lang, n_chars FROM documents")
def csv_union_round_trip(t: Tables) -> DataFrame:
    """Two tables of different columns in one file under the union of their names, and read again."""
    path = t.new_folder()
    half = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "lang")
    writers.csv_union([half.where("doc_id % 2 = 0"), half.where("doc_id % 2 = 1").withColumn("extra", F.lit("x"))], path)
    read = readers.csv(t.spark, path, ["doc_id", "extra", "lang"]).select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang")
    return read.join(t.documents.select("doc_id", "n_chars"), "doc_id")


def _run(t: Tables) -> DataFrame:
    """A plug-in model over a whole suite: predictions and scores."""
    rows = label_rows(t).select(F.col("lang").alias("tier"), F.concat(F.lit("task_"), "source").alias("task_dir"), F.col("source").alias("task_name"), F.col("doc_id").cast("string").alias("id"), "label_space", "gold_label", F.col("predicted_index").alias("hint"))
    for name, kind in (("gold_index", "bigint"), ("gold_ranking", "array<bigint>"), ("text_options", "array<string>"), ("candidate_audio_paths", "array<string>")):
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    return pipelines.evaluate(rows, _hinted)


@query(f"""WITH {LABEL_ROWS}, s AS (SELECT lang, source, avg((gold_label = predicted_label)::INT) AS m, count(*) AS n FROM label_rows GROUP BY ALL)
SELECT lang AS tier, 'task_' || source AS task_dir, n, round(m, 9) AS mean FROM s""")
def evaluation_run(t: Tables) -> DataFrame:
    """Each task's count and mean."""
    return pipelines.summary(_run(t), 20).select("tier", "task_dir", "n", F.round("mean", 9).alias("mean"))


_X = f"{LABEL_ROWS}, x AS (SELECT lang AS tier, 'task_' || source AS task_dir, doc_id::VARCHAR AS id, gold_label, predicted_label, (gold_label = predicted_label)::INT::DOUBLE AS m FROM label_rows)"


@query(f"""WITH {_X}, {_replicates('x', ['tier', 'task_dir'], 'm', 'id', 30, 42)}, e AS (SELECT tier, task_dir, {_CI} FROM r GROUP BY ALL), y AS (SELECT tier, task_dir, count(*) AS n, round(avg(m), 9) AS mean FROM x GROUP BY ALL),
z AS ({MACRO.format(by='tier, task_dir', src='x').replace('e AS', 'WITH e2 AS', 1).replace('FROM e GROUP', 'FROM e2 GROUP')})
SELECT * FROM y JOIN e USING (tier, task_dir) JOIN z USING (tier, task_dir)""")
def evaluation_report(t: Tables) -> DataFrame:
    """Each task's count, mean with interval, and macro-averaged precision, recall and F1, as one run reports them."""
    made = pipelines.task_report(_run(t), 30)
    return made.select("tier", "task_dir", "n", *(F.round(c, 9).alias(c) for c in ("mean", "ci_low", "ci_high", "macro_precision", "macro_recall", "macro_f1")), "n_labels")


def _hinted():
    return lambda row: {"predicted_index": row["hint"]}


@query(f"""WITH {SRC_ITEMS} SELECT id, {draw_sql('3', 9, 'id')} AS drawn, {digest_sql(9, 'id')} AS digest FROM src_items""")
def seeded_draws(t: Tables) -> DataFrame:
    return src_items(t).select("id", seeded.draw(F.lit(3), 9, F.col("id")).alias("drawn"), seeded.digest(9, F.col("id")).alias("digest"))


@query(f"""WITH {CLIPS}, s AS (SELECT video, count(*) AS n FROM clips GROUP BY video), k AS (SELECT n AS gold, count(*) AS c FROM s GROUP BY n)
SELECT gold::VARCHAR AS gold_key, c AS n, sum(c) OVER ()::BIGINT AS total FROM k""")
def label_distribution(t: Tables) -> DataFrame:
    """Counts of each gold and of all, as a task's metadata has them."""
    rows = clips(t).groupBy("video").agg(F.count("*").cast("string").alias("gold_key")).withColumn("task_dir", F.lit("t"))
    meta = writers.task_metadata(rows, "none", 1)
    return meta.select(F.explode("label_distribution").alias("gold_key", "n"), F.col("count").alias("total"))
