"""Logical views of the evaluation data over the given tables, in Spark and, for checking, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import seeded, text as T
from .registry import Tables


def src_items(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("grp"), (F.col("p_size") % 2).alias("flag"))


SRC_ITEMS = "src_items AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, split_part(p_name, ' ', 1) AS grp, p_size % 2 AS flag FROM part)"


def clips(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.format_string("%d:%d", "conv_id", "turn").alias("id"), F.col("conv_id").alias("video"), F.col("turn").alias("clip_index"), F.col("role").alias("delivery"), (F.length("text") / 100.0).alias("duration"), "text", F.array_join(F.slice(T.tokens("text"), 1, 12), " ").alias("caption"), (F.col("turn") % 3 + 1).alias("speakers"), (F.length("text") % 2 == 0).alias("is_talking")
    )


CLIPS = "clips AS (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS id, conv_id AS video, turn AS clip_index, role AS delivery, length(text) / 100.0::DOUBLE AS duration, text, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1:12], ' ') AS caption, turn % 3 + 1 AS speakers, length(text) % 2 = 0 AS is_talking FROM conversations)"


#: Twentieths that clips ``a`` and ``z`` have in common; their words are ``w``.
CLIP_SCORE = "20 * ((a.speakers = z.speakers)::INT + (a.is_talking = z.is_talking)::INT + (a.delivery = z.delivery)::INT) + len(list_intersect(a.w, z.w))"


def long_items(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("event"), (F.col("user_id") % 50).alias("scenario"), F.when(F.col("value") < 50, "unknown").otherwise("single_speaker").alias("mode"), F.col("props").alias("text"), F.format_string("scenario_%d", F.col("user_id") % 50).alias("secondary"))


LONG_ITEMS = "long_items AS (SELECT event_id AS id, event_type AS event, user_id % 50 AS scenario, CASE WHEN value < 50 THEN 'unknown' ELSE 'single_speaker' END AS mode, props AS text, 'scenario_' || (user_id % 50) AS secondary FROM events)"


def label_rows(t: Tables) -> DataFrame:
    """Documents with a quality label; the prediction says high from 1500 characters."""
    joined = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id")
    return joined.select(
        "doc_id", "lang", "source", F.array(F.lit("low"), F.lit("high")).alias("label_space"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("gold_label"), (F.col("n_chars") >= 1500).cast("long").alias("predicted_index")
    )


LABEL_ROWS = (
    "label_rows AS (SELECT doc_id, lang, source, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS gold_label, (n_chars >= 1500)::BIGINT AS predicted_index, "
    "CASE WHEN n_chars >= 1500 THEN 'high' ELSE 'low' END AS predicted_label FROM documents JOIN labels USING (doc_id))"
)


def big_rows(t: Tables) -> DataFrame:
    """Order lines as a large set of tasks: three options, gold from the return flag, bucket from the status."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    gold = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("long")
    return t.lineitem.select(key.alias("id"), F.col("l_linenumber").alias("task"), gold.alias("gold_index"), F.lit(3).alias("n_options"), F.concat_ws("|", F.concat(F.lit("index:"), gold.cast("string")), F.concat(F.lit("bucket:"), F.col("l_linestatus"))).alias("gold_key"))


BIG_ROWS = (
    "big_rows AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_linenumber AS task, g AS gold_index, 3 AS n_options, 'index:' || g::VARCHAR || '|bucket:' || l_linestatus AS gold_key "
    "FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS g FROM lineitem))"
)


def model_scores(t: Tables) -> DataFrame:
    """Three pseudo models over the label rows: each is right with a seeded share of the rows."""
    rows = label_rows(t).select("doc_id", "lang", "source", "gold_label")
    models = rows.withColumn("m", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    right = seeded.draw(F.lit(10), 7, F.col("m"), F.col("doc_id")) < 5 + F.col("m")
    return models.select("doc_id", "lang", "source", "gold_label", F.format_string("model_%d", "m").alias("model"), right.cast("double").alias("metric"), (right == (F.col("gold_label") == "high")).cast("long").alias("predicted_index"))


def draw_sql(n: str, seed: int, *key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'({k})::VARCHAR' for k in key)})), 1, 12))::BIGINT % {n})"


def digest_sql(seed: int | str, *key: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'({k})::VARCHAR' for k in key)}))"


MODEL_SCORES = (
    f"{LABEL_ROWS}, model_scores AS (SELECT doc_id, lang, source, gold_label, 'model_' || m AS model, right_::INT::DOUBLE AS metric, (right_ = (gold_label = 'high'))::BIGINT AS predicted_index "
    f"FROM (SELECT *, {draw_sql('10', 7, 'm', 'doc_id')} < 5 + m AS right_ FROM label_rows, (SELECT unnest([0, 1, 2]) AS m)))"
)


def index_rows(t: Tables, k: int = 3) -> DataFrame:
    """Each vector as a query over itself and the next ``k`` of all, in seeded option order."""
    from ..operators.pools import cyclic_pairs

    others = cyclic_pairs(t.embeddings.select("vec_id"), "vec_id", 11, k).groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "candidate"))), lambda s: s["candidate"]).alias("rest"))
    mixed = others.withColumn("mixed", seeded.shuffled(F.concat(F.array("vec_id"), "rest"), 12, F.col("vec_id")))
    return mixed.select("vec_id", F.transform("mixed", lambda s: s["v"]).alias("candidates"), (F.array_position(F.transform("mixed", lambda s: s["i"]), F.lit(0)) - 1).alias("gold_index"))
