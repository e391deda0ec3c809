"""The registered queries of the corpus operators: each reads its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, hpylm, infill, lshforest, packing, pii, pq, sharding, substring, toxicity, warc, whiten, wrappers
from .scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    chain = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, chain, keep=["doc_id"])
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
        F.get("spans", F.lit(0))["start"].alias("first_span_start"),
    )


def op2_decontamination_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"), F.col("start").cast("long").alias("start_word"))


def op3_lm_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return hpylm.Model(documents, Scratch(spark, "hpylm")).score(documents)


def op4_sharding_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", pii.spans_text(F.concat("base", "learnt")).alias("spans"), F.size("learnt").alias("n_learnt"))


def op6_packing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archives")
    warc.archive(table(spark, sf_dir, "pages"), path)
    records = warc.read(spark, path)
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    there = F.col("record_type") == "response"
    return records.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(there, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(there, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )


def op8_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pq.link(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_substring_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removals(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("removed").alias("n_ranges"))


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lshforest.group(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op11_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return whiten.apply(embeddings, whiten.fit(embeddings), ["vec_id"])


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"], output=False).drop("output")


def queries() -> dict[str, Query]:
    return {"op1_toxicity_crf": op1_toxicity_crf, "op2_decontamination_simhash": op2_decontamination_simhash, "op3_lm_pitman_yor": op3_lm_pitman_yor, "op4_sharding_differencing": op4_sharding_differencing, "op5_pii_bootstrap": op5_pii_bootstrap, "op6_packing_buckets": op6_packing_buckets, "op7_warc_source": op7_warc_source, "op8_embedding_pq": op8_embedding_pq, "op9_substring_anchors": op9_substring_anchors, "op10_minhash_forest": op10_minhash_forest, "op11_html_wrappers": op11_html_wrappers, "op12_embedding_whitening": op12_embedding_whitening, "op13_fill_in_middle": op13_fill_in_middle}


_SPACE = r"[\x20\x09-\x0D]+"
_REACH = """r AS (SELECT {id} AS x, {id} AS y FROM {nodes} UNION SELECT r.x, e.b FROM r JOIN (SELECT a, b FROM e UNION SELECT b, a FROM e) AS e ON r.y = e.a), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)"""

ORACLES = {
    "op2_decontamination_simhash": rf"""
WITH w AS (SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents
 UNION ALL SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(text), '{_SPACE}'), lambda x: x <> '') FROM benchmark),
s AS (SELECT kind, id, len(ws) - 4 AS m, unnest(range(len(ws) - 4)) AS p, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS h FROM w WHERE len(ws) >= 5),
i AS (SELECT id AS item_id, m, h, count(*) AS n FROM s WHERE kind = 'i' GROUP BY ALL),
hit AS (SELECT s.id AS doc_id, s.m AS len, s.p, s.h, i.item_id, i.m, i.n FROM s JOIN i USING (h) WHERE kind = 'd'),
b AS (SELECT DISTINCT doc_id, item_id, len, m, greatest(0, least(p, len - m)) AS start FROM hit),
k AS (SELECT b.doc_id, b.item_id, b.len, b.m, b.start, hit.h, least(count(*), any_value(hit.n)) AS n FROM b JOIN hit ON b.doc_id = hit.doc_id AND b.item_id = hit.item_id AND hit.p >= b.start AND hit.p < b.start + b.m GROUP BY ALL),
j AS (SELECT doc_id, item_id, start, sum(n) / (least(m, len) + m - sum(n)) AS similarity FROM k GROUP BY doc_id, item_id, len, m, start)
SELECT doc_id, item_id, round(max(similarity), 9) AS similarity, min_by(start, (-similarity, start))::BIGINT AS start_word FROM j WHERE similarity >= 0.75 GROUP BY doc_id, item_id""",
    "op7_warc_source": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages), b AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS best FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to FROM b""",
    "op8_embedding_pq": f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
e AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p, v q WHERE p.vec_id < q.vec_id AND list_dot_product(p.x, q.x) / (p.n * q.n) >= 0.95), {_REACH.format(id='vec_id', nodes='v')},
l AS (SELECT z, count(*) AS n FROM (SELECT a AS z FROM e UNION ALL SELECT b FROM e) GROUP BY z)
SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.x = v.vec_id LEFT JOIN l ON l.z = v.vec_id""",
    "op9_substring_anchors": rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, unnest(list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i:i+19], ' ')))) AS h FROM w WHERE len(ws) >= 20),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM p),
k AS (SELECT DISTINCT doc_id, i + o AS pos FROM g, (SELECT unnest(range(20)) AS o) WHERE rn > 1),
r AS (SELECT doc_id, count(*) AS n, sum(fresh) AS ranges, list(pos) AS gone FROM (SELECT doc_id, pos, (coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -9) <> pos - 1)::INT AS fresh FROM k) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256, coalesce(ranges, 0)::INTEGER AS n_ranges FROM w LEFT JOIN r USING (doc_id)""",
    "op10_minhash_forest": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i+4], ' '))) WHEN len(ws) > 0 THEN [md5(array_to_string(ws, ' '))] ELSE []::VARCHAR[] END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.h = q.h AND p.doc_id < q.doc_id GROUP BY ALL) JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)), {_REACH.format(id='doc_id', nodes='documents')}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    # The pages of the given tables mark their main text as articles of headings and paragraphs.
    "op11_html_wrappers": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)( [^>]*)?/?>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS x FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d""",
    "op13_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(x, '[^\n]*\n|[^\n]+') AS ls, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS d FROM t),
c AS (SELECT *, len(ls) AS n, least(d[1] % (len(ls) + 1), d[2] % (len(ls) + 1)) AS a, greatest(d[1] % (len(ls) + 1), d[2] % (len(ls) + 1)) AS b FROM l),
p AS (SELECT *, array_to_string(ls[1:a], '') AS pre, array_to_string(ls[a+1:b], '') AS mid, array_to_string(ls[b+1:n], '') AS suf,
 CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN x WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256 FROM p""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
