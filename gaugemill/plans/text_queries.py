"""Queries of the scalar functions, predicates and loaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import arrays as A, seeded, text as T
from .bindings import CLIPS, clips
from ..sources import readers
from .registry import Tables, query


@query("""
SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))::BIGINT AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')))::BIGINT AS n_distinct,
       len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n_ascii FROM documents""")
def tokenize_stats(t: Tables) -> DataFrame:
    own = T.tokens("text")
    return t.documents.select("doc_id", F.size(own).cast("long").alias("n_tokens"), F.size(F.array_distinct(own)).cast("long").alias("n_distinct"), F.size(T.ascii_terms("text")).cast("long").alias("n_ascii"))


@query("""
WITH i AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS b FROM benchmark),
d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS a FROM documents),
s AS (SELECT doc_id, item_id, len(list_intersect(a, b)) AS n, len(a) AS x, len(b) AS y FROM d, i)
SELECT doc_id, round(max(n / (x + y - n)), 9) AS best_overlap, count(*) AS n_items FROM s WHERE n > 0 GROUP BY doc_id""")
def jaccard_prompt_option(t: Tables) -> DataFrame:
    """Token overlap of every document with every item that it shares a token with, met by token."""
    words = lambda df, key: df.select(key, F.array_distinct(T.tokens("text")).alias("w")).select(key, F.size("w").alias(f"n_{key}"), F.explode("w").alias("w"))
    met = words(t.documents, "doc_id").join(words(t.benchmark, "item_id"), "w").groupBy("doc_id", "item_id", "n_doc_id", "n_item_id").agg(F.count("*").alias("n"))
    share = F.col("n") / (F.col("n_doc_id") + F.col("n_item_id") - F.col("n"))
    return met.groupBy("doc_id").agg(F.round(F.max(share), 9).alias("best_overlap"), F.count("*").alias("n_items"))


@query("""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
c AS (SELECT conv_id, turn, z, sum(s = 1) AS nx, sum(s = 2) AS ny FROM (SELECT conv_id, turn, unnest(x) AS z, 1 AS s FROM p UNION ALL SELECT conv_id, turn, unnest(y), 2 FROM p) GROUP BY ALL),
m AS (SELECT conv_id, turn, sum(least(nx, ny)) AS n FROM c GROUP BY ALL)
SELECT p.conv_id, p.turn, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN coalesce(n, 0) / greatest(len(x), len(y)) ELSE 0 END, 9)::DOUBLE AS similarity FROM p LEFT JOIN m USING (conv_id, turn)""")
def lexical_similarity(t: Tables) -> DataFrame:
    """Multiset similarity of each turn and the next one; tokens are counted by row, not searched in arrays."""
    w = t.conversations.select("conv_id", "turn", T.ascii_terms("text").alias("w"))
    pairs = w.select("conv_id", "turn", F.col("w").alias("x")).join(w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("y")), ["conv_id", "turn"])
    side = lambda c, s: pairs.select("conv_id", "turn", F.explode(c).alias("z"), F.lit(s).alias("s"))
    counts = side("x", 1).unionByName(side("y", 2)).groupBy("conv_id", "turn", "z").agg(F.least(F.count_if(F.col("s") == 1), F.count_if(F.col("s") == 2)).alias("n"))
    shared = counts.groupBy("conv_id", "turn").agg(F.sum("n").alias("n"))
    longest = F.greatest(F.size("x"), F.size("y"))
    value = F.when((F.size("x") > 0) & (F.size("y") > 0), F.coalesce("n", F.lit(0)) / longest).otherwise(F.lit(0.0))
    return pairs.join(shared, ["conv_id", "turn"], "left").select("conv_id", "turn", F.round(value, 9).alias("similarity"))


@query("""
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'item') AS slug,
       coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g')[1:80], ''), 'item') AS file_slug,
       coalesce(try_cast(regexp_extract_all(url, '[0-9]+')[-1] AS BIGINT), 0) AS last_integer, try_cast(nullif(regexp_extract(url, '-?[0-9]+'), '') AS BIGINT) AS first_integer,
       split_part(url, '/en/', 1) AS head, lpad(page_id::VARCHAR, 10, '0') AS padded FROM pages""")
def slug_and_ids(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", T.slug("url").alias("slug"), T.file_slug("url").alias("file_slug"), T.last_integer("url").alias("last_integer"), T.first_integer("url").alias("first_integer"),
        F.split_part("url", F.lit("/en/"), F.lit(1)).alias("head"), F.format_string("%010d", "page_id").alias("padded"),
    )


@query(f"""
WITH {CLIPS}, l AS (SELECT CASE WHEN regexp_matches(lower(text), 'laugh|chuckle|giggle') THEN 'laughter' WHEN regexp_matches(lower(text), 'shout|yell|scream|cheer') THEN 'high_energy'
  WHEN regexp_matches(lower(text), 'whisper|murmur|soft|quietly') THEN 'soft' ELSE 'neutral_speech' END AS delivery_label,
  CASE WHEN duration < 2.5 THEN 'short' WHEN duration < 5 THEN 'medium' ELSE 'long' END AS bucket, CASE WHEN clip_index > 1 THEN 'multiple_speakers' ELSE 'single_speaker' END AS speakers FROM clips)
SELECT delivery_label, bucket, speakers, count(*) AS n FROM l GROUP BY ALL""")
def delivery_bucket_labels(t: Tables) -> DataFrame:
    labelled = clips(t).select(T.delivery("text").alias("delivery_label"), T.duration_bucket("duration").alias("bucket"), T.speaker_count_label("clip_index").alias("speakers"))
    return labelled.groupBy("delivery_label", "bucket", "speakers").agg(F.count("*").alias("n"))


@query("""SELECT p_name, (sum(i * ascii(c)) % 100000)::BIGINT AS seed_offset FROM (SELECT p_name, unnest(string_split(p_name, '')) AS c, unnest(range(1, length(p_name) + 1)) AS i FROM (SELECT DISTINCT p_name FROM part)) GROUP BY p_name""")
def seed_offset(t: Tables) -> DataFrame:
    return t.part.select("p_name").distinct().select("p_name", seeded.seed_offset(F.col("p_name")).cast("long").alias("seed_offset"))


@query("""
WITH e AS (SELECT event_id, event_type, props, regexp_extract(props, '"k": *([0-9]+)', 1) AS k FROM events)
SELECT event_id, coalesce(nullif(k, ''), nullif(event_type, ''), 'none') AS first_value, coalesce(try_cast(k AS DOUBLE), 0) AS as_double, coalesce(try_cast(nullif(k, '') AS BIGINT), -1) AS as_int FROM e""")
def falsy_coalesce_safe_cast(t: Tables) -> DataFrame:
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1)
    return t.events.select("event_id", F.coalesce(A.first_truthy(k, F.col("event_type")), F.lit("none")).alias("first_value"), A.safe_double(k).alias("as_double"), A.safe_int(k, -1).alias("as_int"))


@query("""
SELECT lang, count(*) AS n, sum((length(trim(text)) > 0)::INT)::BIGINT AS with_text, sum((greatest(0, least(n_chars / 100.0, 24)) >= 12)::INT)::BIGINT AS long_enough
FROM documents WHERE coalesce(n_chars / 1000.0, 0) >= 0.45 AND len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) >= 4 AND NOT regexp_matches(text, '(?i)\\b(fuck|fucking|shit|bitch|cunt|dick|asshole)\\b') GROUP BY lang""")
def quality_filters(t: Tables) -> DataFrame:
    kept = t.documents.where((F.coalesce(F.col("n_chars") / 1000.0, F.lit(0.0)) >= 0.45) & (F.size(T.tokens("text")) >= 4) & T.is_safe("text"))
    window = F.greatest(F.lit(0.0), F.least(F.col("n_chars") / 100.0, F.lit(24.0)))
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim("text")) > 0).alias("with_text"), F.count_if(window >= 12).alias("long_enough"))


@query("""
WITH p AS (SELECT a.conv_id, a.turn, lower(a.text) AS a, lower(b.text) AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
SELECT conv_id, turn, ((trim(a) <> trim(b))::INT""" + "".join(f" + 3 * (contains(a, '{x}') AND contains(b, '{y}'))::INT" for x, y in T.CONTRASTS) + "".join(f" + (contains(b, '{w}') AND NOT contains(a, '{w}'))::INT" for w in T.SURROUNDINGS) + ")::BIGINT AS score FROM p")
def contrast_score(t: Tables) -> DataFrame:
    a = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("a"))
    b = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", T.contrast_score("a", "b").cast("long").alias("score"))


@query("""
SELECT conv_id, right(string_agg(coalesce(role, 'message') || ': ' || CASE WHEN length(text) > 260 THEN text[1:260] || '...' ELSE text END, chr(10) ORDER BY turn), 700) AS prompt, count(*) AS n FROM conversations WHERE NOT contains(text, 'Sometimes, the user may need') GROUP BY conv_id""")
def compact_prompts(t: Tables) -> DataFrame:
    messages = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    kept = t.conversations.where(~F.contains("text", F.lit("Sometimes, the user may need")))
    return kept.groupBy("conv_id").agg(T.compact_prompt(messages).alias("prompt"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT *, conv_id % 3 AS k FROM conversations), r AS (SELECT conv_id::VARCHAR AS doc, turn, text, CASE k WHEN 0 THEN 'v' || conv_id END AS video_uid, CASE k WHEN 0 THEN CASE WHEN turn % 2 = 0 THEN 'own' ELSE 'val' END WHEN 1 THEN 'train' END AS split, CASE WHEN k < 2 THEN 'social' END AS scenario FROM c)
SELECT doc, turn, length(text)::BIGINT AS n_chars, video_uid, split, scenario FROM r""")
def variant_flatten(t: Tables) -> DataFrame:
    """Nested documents of three shapes as records: videos with clips, some with their own split; videos alone; other lists."""
    own = F.when(F.col("turn") % 2 == 0, "own")
    rows = t.conversations.withColumn("clip", F.struct("turn", "text", own.alias("split"))).withColumn("video", F.struct("turn", "text"))
    lists = rows.groupBy("conv_id").agg(F.collect_list("clip").alias("clips"), F.collect_list("video").alias("plain"))
    k = F.col("conv_id") % 3
    clips = F.to_json(F.struct(F.lit("val").alias("split"), F.array(F.struct(F.format_string("v%d", "conv_id").alias("video_uid"), "clips"), F.lit(None)).alias("videos")))
    doc = F.when(k == 0, clips).when(k == 1, F.to_json(F.struct(F.col("plain").alias("videos")))).otherwise(F.to_json(F.struct(F.col("plain").alias("turns"), F.lit("x").alias("videos"))))
    documents = lists.select(F.col("conv_id").cast("string").alias("doc"), doc.alias("json"), F.lit("social").alias("stem"))
    found = readers.flattened(documents, "json", "stem")
    return found.select("doc", F.expr("variant_get(record, '$.turn', 'bigint')").alias("turn"), F.length(F.expr("variant_get(record, '$.text', 'string')")).cast("long").alias("n_chars"), "video_uid", "split", "scenario")


@query("SELECT page_id, 'a' || chr(65533) || substr(regexp_replace(html, '[^a-z]', '', 'g'), 1, 40) AS said FROM pages")
def lossy_documents(t: Tables) -> DataFrame:
    """Documents of a line each, all with a byte that isn't UTF-8."""
    path = t.new_folder()
    text = F.substring(F.regexp_replace("html", "[^a-z]", ""), 1, 40)
    line = F.concat(F.lit('{"said": "a').cast("binary"), F.unhex(F.lit("FF")), text.cast("binary"), F.lit('", "page_id": ').cast("binary"), F.col("page_id").cast("string").cast("binary"), F.lit("}").cast("binary"))
    t.pages.select(line.cast("string").alias("value")).write.mode("overwrite").text(path)
    return readers.lossy_json(t.spark, path, "page_id bigint, said string", lines=True).select("page_id", "said")


@query("""
WITH u AS (SELECT 'd' || doc_id AS id, 'document' AS kind, doc_id AS ord, length(text) AS n FROM documents UNION ALL SELECT 'p' || page_id, 'page', page_id, length(html) FROM pages
UNION ALL SELECT 'c' || conv_id, 'conversation', turn, length(text) FROM conversations)
SELECT kind, count(*) AS n, sum(n)::BIGINT AS characters FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM u) WHERE rn = 1 GROUP BY kind""")
def nested_loader_union(t: Tables) -> DataFrame:
    """Three sources as one pool, the first row of each id."""
    from ..operators.metrics import deduplicated

    part = lambda df, p, key, kind, order, text: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(order).alias("ord"), F.length(text).alias("n"))
    pool = part(t.documents, "d", "doc_id", "document", "doc_id", "text").unionByName(part(t.pages, "p", "page_id", "page", "page_id", "html")).unionByName(part(t.conversations, "c", "conv_id", "conversation", "turn", "text"))
    return deduplicated(pool, ["id"], ["ord"]).groupBy("kind").agg(F.count("*").alias("n"), F.sum("n").alias("characters"))


@query("""
SELECT lang, CASE WHEN n_chars < 400 THEN 'too_short' WHEN n_chars > 12000 THEN 'too_long' WHEN regexp_matches(text, '(?i)\\b(fuck|fucking|shit|bitch|cunt|dick|asshole)\\b') THEN 'unsafe' ELSE 'ok' END AS reason, count(*) AS n FROM documents GROUP BY ALL""")
def reason_audit(t: Tables) -> DataFrame:
    """Rows by the first policy they fail."""
    reason = F.when(F.col("n_chars") < 400, "too_short").when(F.col("n_chars") > 12000, "too_long").when(~T.is_safe("text"), "unsafe").otherwise("ok")
    return t.documents.groupBy("lang", reason.alias("reason")).agg(F.count("*").alias("n"))
