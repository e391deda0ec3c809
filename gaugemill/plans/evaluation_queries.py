"""Queries of sampling, pools, scoring, statistics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import arrays as A, seeded, text as T
from ..operators import metrics as M, models, pools, sampling as S, scoring as P
from ..operators.resample import replicate_means
from .bindings import BIG_ROWS, CLIP_SCORE, CLIPS, LABEL_ROWS, MODEL_SCORES, SRC_ITEMS, big_rows, clips, digest_sql, draw_sql, index_rows, label_rows, model_scores, src_items
from .pipelines import results_table
from .registry import Tables, query


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


MACRO = """
e AS (SELECT {by}, gold_label AS label, 1 AS g, 0 AS p, (gold_label = predicted_label)::INT AS t FROM {src} UNION ALL SELECT {by}, predicted_label, 0, 1, 0 FROM {src}),
s AS (SELECT {by}, label, sum(g) AS g, sum(p) AS p, sum(t) AS t FROM e GROUP BY ALL),
f AS (SELECT {by}, CASE WHEN p > 0 THEN t / p ELSE 0 END AS pr, CASE WHEN g > 0 THEN t / g ELSE 0 END AS re FROM s)
SELECT {by}, round(avg(pr), 9) AS macro_precision, round(avg(re), 9) AS macro_recall, round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END), 9) AS macro_f1, count(*) AS n_labels FROM f GROUP BY {by}"""


@query(f"WITH {LABEL_ROWS}, {MACRO.format(by='lang', src='label_rows')}")
def macro_f1(t: Tables) -> DataFrame:
    rows = label_rows(t).withColumn("predicted_label", F.get("label_space", F.col("predicted_index").cast("int")))
    return _rounded(M.macro_f1(rows, ["lang"], "gold_label", "predicted_label"), "macro_precision", "macro_recall", "macro_f1")


@query(f"WITH {LABEL_ROWS} SELECT doc_id, (gold_label = predicted_label)::INT::DOUBLE AS primary_metric, predicted_label AS predicted_label_text FROM label_rows")
def score_label(t: Tables) -> DataFrame:
    made = P.label_metrics(F.col("label_space"), F.col("predicted_index"), F.col("gold_label"))
    return label_rows(t).select("doc_id", *(v.alias(k) for k, v in made.items()))


INDEX_ROWS = f"""
o AS (SELECT vec_id, row_number() OVER (ORDER BY {digest_sql(11, 'vec_id')}, vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings),
c AS (SELECT a.vec_id, z.vec_id AS candidate, s AS pos FROM o a, (SELECT unnest([1, 2, 3]) AS s) JOIN o z ON z.i = (a.i + s) % a.n WHERE s < a.n UNION ALL SELECT vec_id, vec_id, 0 FROM o WHERE n > 1),
m AS (SELECT vec_id, candidate, pos, row_number() OVER (PARTITION BY vec_id ORDER BY {digest_sql(12, 'vec_id', 'pos')}, pos) - 1 AS idx FROM c),
g AS (SELECT vec_id, max(CASE WHEN pos = 0 THEN idx END) AS gold_index FROM m GROUP BY vec_id)"""


@query(f"""WITH {INDEX_ROWS},
s AS (SELECT m.vec_id, m.idx, g.gold_index, CASE WHEN m.pos = 0 THEN {draw_sql('1000', 13, 'm.vec_id', 'm.idx')} + 150 ELSE {draw_sql('1000', 13, 'm.vec_id', 'm.idx')} END AS score FROM m JOIN g USING (vec_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, idx) AS rnk FROM s)
SELECT vec_id, gold_index::BIGINT AS gold_index, rnk::DOUBLE AS rank, (rnk = 1)::INT::DOUBLE AS primary_metric, round(1.0 / rnk, 9)::DOUBLE AS mrr, round(1.0 / rnk, 9)::DOUBLE AS average_precision, round(1 / log2(rnk + 1), 9) AS ndcg,
 (rnk <= 1)::INT::DOUBLE AS recall_at_1, (rnk <= 2)::INT::DOUBLE AS recall_at_2, (rnk <= 3)::INT::DOUBLE AS recall_at_3 FROM r WHERE idx = gold_index""")
def score_index(t: Tables) -> DataFrame:
    """Retrieval metrics of seeded scores over four candidates."""
    rows = index_rows(t)
    score = F.transform("candidates", lambda c, i: (seeded.draw(F.lit(1000), 13, F.col("vec_id"), i) + F.when(c == F.col("vec_id"), 150).otherwise(0)).cast("double"))
    ranked = rows.withColumn("predicted", P.predicted_ranking(F.lit(None).cast("array<bigint>"), score, F.lit(None).cast("long"), F.size("candidates")))
    made = ranked.select("vec_id", F.col("gold_index").cast("long").alias("gold_index"), *(v.alias(k) for k, v in P.index_metrics(F.col("gold_index"), F.col("predicted")).items()))
    return _rounded(made, "mrr", "average_precision", "ndcg")


@query(f"""WITH {INDEX_ROWS},
s AS (SELECT m.vec_id, m.idx, g.gold_index, list_dot_product(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) AS score
 FROM m JOIN g USING (vec_id) JOIN embeddings q ON q.vec_id = m.vec_id JOIN embeddings x ON x.vec_id = m.candidate)
SELECT vec_id, round(max(CASE WHEN idx <> gold_index THEN score END), 6) AS best_other, round(max(score), 6) AS best, count(*) AS n FROM s GROUP BY vec_id""")
def embedding_retrieval(t: Tables) -> DataFrame:
    """Cosines of stored embeddings of a query with its candidates, met by id."""
    pairs = index_rows(t).select("vec_id", F.posexplode("candidates").alias("idx", "candidate"), "gold_index")
    vec = lambda name, key: t.embeddings.select(F.col("vec_id").alias(key), F.col("embedding").alias(name))
    both = pairs.join(vec("q", "vec_id"), "vec_id").join(vec("x", "candidate"), "candidate")
    scored = both.withColumn("score", models.cosine_scores(F.col("q"), F.array("x"))[0])
    return scored.groupBy("vec_id").agg(F.round(F.max(F.when(F.col("idx") != F.col("gold_index"), F.col("score"))), 6).alias("best_other"), F.round(F.max("score"), 6).alias("best"), F.count("*").alias("n"))


def _even(i: int) -> str:
    return f"{draw_sql(str(1 << 30), 17, 'id', str(i))} / {float(1 << 30)}"


@query(f"""WITH {SRC_ITEMS}, s AS (SELECT id, [{_even(0)}, {_even(1)}, {_even(2)}] AS s FROM src_items), p AS (SELECT id, list_max(s) AS best, list_position(s, list_max(s)) - 1 AS i FROM s)
SELECT id, round(best, 9) AS best, i::BIGINT AS predicted_index, (i = 0)::INT::DOUBLE AS primary_metric FROM p""")
def random_model(t: Tables) -> DataFrame:
    """Even scores for three options of every item, the best of them taken, and scored as if the first were right."""
    three = F.array(*map(F.lit, "abc"))
    rows = src_items(t).select("id", three.alias("text_options"), *(F.lit(None).cast("array<string>").alias(c) for c in ("candidate_audio_paths", "label_space")))
    scored = models.predict(rows, models.backend("random", seed=17), ["id"])
    ranked = P.predicted_ranking(F.lit(None).cast("array<bigint>"), F.col("scores"), F.lit(None).cast("long"), F.lit(3))
    made = scored.withColumn("_r", ranked).withColumn("primary_metric", P.index_metrics(F.lit(0).cast("long"), F.col("_r"))["primary_metric"])
    return made.select("id", F.round(F.array_max("scores"), 9).alias("best"), "predicted_index", "primary_metric")


@query(f"""
WITH {SRC_ITEMS}, g AS (SELECT id, [0, 1, 2] AS gold, s FROM (SELECT id, [{draw_sql('10', 5, 'id', '0')}, {draw_sql('10', 5, 'id', '1')}, {draw_sql('10', 5, 'id', '2')}] AS s FROM src_items)),
u AS (SELECT id, unnest(s) AS x, unnest([0, 1, 2]) AS i FROM g), r AS (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY x DESC, i) AS k FROM u)
SELECT id, (min(CASE WHEN k = 1 THEN i END) = 0)::INT::DOUBLE AS primary_metric, (sum(CASE WHEN k = i + 1 THEN 1 ELSE 0 END) = 3)::INT::DOUBLE AS exact_ranking_accuracy,
 round(max(CASE WHEN i = 0 THEN 1.0 / k END), 9)::DOUBLE AS mrr, round(sum((3 - i) / log2(k + 1)) / (3 + 2 / log2(3) + 0.5), 9) AS ndcg FROM r GROUP BY id""")
def score_ranking(t: Tables) -> DataFrame:
    scores = F.array(*(seeded.draw(F.lit(10), 5, F.col("id"), F.lit(i)).cast("double") for i in range(3)))
    gold = F.array(*(F.lit(i).cast("long") for i in range(3)))
    made = P.ranking_metrics(gold, P.predicted_ranking(F.lit(None).cast("array<bigint>"), scores, F.lit(None).cast("long"), F.lit(3)))
    return _rounded(src_items(t).select("id", *(v.alias(k) for k, v in made.items())), "mrr", "ndcg")


@query(f"""WITH {LABEL_ROWS}, x AS (SELECT lang, source, (gold_label = predicted_label)::INT::DOUBLE AS m FROM label_rows)
SELECT lang, source, count(*) AS n, round(avg(m), 9) AS mean, 0::BIGINT AS level FROM x GROUP BY ALL UNION ALL SELECT lang, NULL, count(*), round(avg(m), 9), 1 FROM x GROUP BY lang UNION ALL SELECT NULL, NULL, count(*), round(avg(m), 9), 3 FROM x
UNION ALL SELECT NULL, NULL, count(*), round(avg(a), 9), 9 FROM (SELECT avg(m) AS a FROM x GROUP BY lang)""")
def metric_levels(t: Tables) -> DataFrame:
    made = P.label_metrics(F.col("label_space"), F.col("predicted_index"), F.col("gold_label"))
    rows = label_rows(t).select("lang", "source", made["primary_metric"].alias("m"))
    return _rounded(M.levels(rows, "lang", "source", "m"), "mean")


def _replicates(src: str, by: list[str], value: str, key: str, samples: int, seed: int) -> str:
    """The means of replicates that draw as many rows as a group has; for groups of up to a block of rows."""
    cols, same = ", ".join(by), " AND ".join(f"o.{c} IS NOT DISTINCT FROM k.{c}" for c in by)
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {cols} ORDER BY {digest_sql(seed, key)}, {key}) - 1 AS i, count(*) OVER (PARTITION BY {cols}) AS n FROM {src}),
k AS (SELECT {cols}, n, b, unnest(range(1, n + 1)) AS k FROM (SELECT DISTINCT {cols}, n FROM o), (SELECT unnest(range({samples})) AS b)),
r AS (SELECT {', '.join('k.' + c for c in by)}, b, avg(o.{value}) AS mean, count(*) AS drawn FROM k JOIN o ON {same} AND o.i = {draw_sql('k.n', seed, *(f'k.{c}' for c in by), 'b', '0', 'k')} GROUP BY ALL)"""


_CI = "round(quantile_cont(mean, 0.025), 9) AS ci_low, round(quantile_cont(mean, 0.975), 9) AS ci_high"
_P = "round(least(1.0, 2.0 * least(sum((mean >= 0)::INT) + 1, sum((mean <= 0)::INT) + 1) / (count(*) + 1)), 9)::DOUBLE AS p_value"
_G = "round(CASE WHEN count(*) >= 2 AND stddev_samp(m) > 1e-12 THEN avg(m) / stddev_samp(m) * (1 - 3.0 / greatest(1, 4 * count(*) - 5)) ELSE 0 END, 9) AS hedges_g"
_LEVELS = "l AS (SELECT doc_id, m, lang, source, 0 AS level FROM x UNION ALL SELECT doc_id, m, lang, NULL, 1 FROM x UNION ALL SELECT doc_id, m, NULL, NULL, 3 FROM x)"
_SAME = "f.lang IS NOT DISTINCT FROM e.lang AND f.source IS NOT DISTINCT FROM e.source AND f.level = e.level"


@query(f"""WITH {LABEL_ROWS}, x AS (SELECT lang, doc_id, (gold_label = predicted_label)::INT::DOUBLE AS m FROM label_rows), {_replicates('x', ['lang'], 'm', 'doc_id', 100, 42)},
e AS (SELECT lang, {_CI}, min(drawn) AS least_drawn, max(drawn) AS most_drawn FROM r GROUP BY lang)
SELECT lang, round(avg(m), 9) AS mean, count(*) AS n, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high, any_value(least_drawn) AS least_drawn, any_value(most_drawn) AS most_drawn FROM x JOIN e USING (lang) GROUP BY lang""")
def bootstrap_ci(t: Tables) -> DataFrame:
    """Every replicate draws as many rows as there are, which ``least_drawn`` and ``most_drawn`` show."""
    made = P.label_metrics(F.col("label_space"), F.col("predicted_index"), F.col("gold_label"))
    rows = label_rows(t).select("lang", "doc_id", made["primary_metric"].alias("m"))
    drawn = replicate_means(rows, ["lang"], "m", ["doc_id"], 100, 42).groupBy("lang").agg(F.min("drawn").alias("least_drawn"), F.max("drawn").alias("most_drawn"))
    return _rounded(M.bootstrap_ci(rows, ["lang"], "m", ["doc_id"]).join(drawn, "lang"), "mean", "ci_low", "ci_high")


@query(f"""WITH {LABEL_ROWS}, x AS (SELECT lang, source, doc_id, (gold_label = predicted_label)::INT::DOUBLE AS m FROM label_rows), {_LEVELS}, {_replicates('l', ['lang', 'source', 'level'], 'm', 'doc_id', 100, 42)},
e AS (SELECT lang, source, level, {_CI} FROM r GROUP BY lang, source, level), f AS (SELECT lang, source, level, count(*) AS n, round(avg(m), 9) AS mean FROM l GROUP BY ALL)
SELECT f.*, e.ci_low, e.ci_high FROM f JOIN e ON {_SAME}""")
def metric_intervals(t: Tables) -> DataFrame:
    """Accuracy with its interval by source, by language and over all."""
    made = P.label_metrics(F.col("label_space"), F.col("predicted_index"), F.col("gold_label"))
    rows = label_rows(t).select("lang", "source", "doc_id", made["primary_metric"].alias("m"))
    return _rounded(M.level_intervals(rows, "lang", "source", "m", ["doc_id"]), "mean", "ci_low", "ci_high")


_PAIRED = f"{MODEL_SCORES}, x AS (SELECT a.lang, a.source, a.doc_id, a.metric - b.metric AS m FROM model_scores a JOIN model_scores b USING (doc_id) WHERE a.model = 'model_2' AND b.model = 'model_0')"


def _paired(t: Tables) -> DataFrame:
    rows = model_scores(t)
    side = lambda m, name: rows.where(F.col("model") == m).select("lang", "source", "doc_id", F.col("metric").alias(name))
    return side("model_2", "current").join(side("model_0", "reference").drop("lang", "source"), "doc_id")


@query(f"""WITH {_PAIRED}, {_replicates('x', ['lang'], 'm', 'doc_id', 100, 42)}, e AS (SELECT lang, {_CI}, {_P} FROM r GROUP BY lang)
SELECT lang, count(*) AS n, round(avg(m), 9) AS observed_difference, {_G}, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high, any_value(p_value) AS p_value FROM x JOIN e USING (lang) GROUP BY lang""")
def paired_bootstrap(t: Tables) -> DataFrame:
    return _rounded(M.paired_comparison(_paired(t), ["lang"], "current", "reference", ["doc_id"]), "observed_difference", "hedges_g", "ci_low", "ci_high", "p_value")


@query(f"""WITH {_PAIRED}, {_LEVELS}, {_replicates('l', ['lang', 'source', 'level'], 'm', 'doc_id', 100, 42)}, e AS (SELECT lang, source, level, {_CI}, {_P} FROM r GROUP BY lang, source, level),
f AS (SELECT lang, source, level, count(*) AS n, round(avg(m), 9) AS observed_difference, {_G} FROM l GROUP BY lang, source, level)
SELECT f.*, e.ci_low, e.ci_high, e.p_value FROM f JOIN e ON {_SAME}""")
def comparison_levels(t: Tables) -> DataFrame:
    """Two models' paired difference by source, by language and over all."""
    return _rounded(M.level_comparison(_paired(t), "lang", "source", "current", "reference", ["doc_id"]), "observed_difference", "hedges_g", "ci_low", "ci_high", "p_value")


PICKED = """
k AS (SELECT *, row_number() OVER (PARTITION BY task, gold_key ORDER BY {d}, id) AS rnd, count(*) OVER (PARTITION BY task, gold_key) AS sz FROM big_rows),
w AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY rnd, sz, gold_key) AS pick FROM k)""".format(d=digest_sql(42, "id"))


@query(f"WITH {BIG_ROWS}, {PICKED} SELECT task, id, gold_key, pick::INT AS pick FROM w WHERE pick <= 150")
def balanced_sample(t: Tables) -> DataFrame:
    return S.round_robin(big_rows(t), ["task"], "gold_key", ["id"], 42, 150).select("task", "id", "gold_key", "pick")


def _guessed(seed: int, *key: str) -> str:
    """Right guesses of 64 trials over three options."""
    h = digest_sql(seed, *key)
    return f"list_sum(list_transform(range(64), lambda t: ((('0x' || substr({h}, 1, 10))::BIGINT + ('0x' || substr({h}, 11, 10))::BIGINT * t) % {M.GUESSES} % 3 = gold_index)::INT))"


BASELINES = f"""
c AS (SELECT task, gold_index, count(*) AS c FROM big_rows GROUP BY ALL), m AS (SELECT task, max(c) AS c FROM c GROUP BY task),
a AS (SELECT task, count(*) AS n, 1.0 / 3 AS chance, avg((gold_index = 0)::INT) AS always_first, sum({_guessed(42, 'task', 'id')}) / (64 * count(*)) AS rnd FROM big_rows GROUP BY task)"""


@query(f"WITH {BIG_ROWS}, {BASELINES} SELECT task, n, round(chance, 9)::DOUBLE AS chance, round(m.c / n, 9) AS majority, round(always_first, 9) AS always_first, round(rnd, 9) AS random FROM a JOIN m USING (task)")
def trivial_baselines(t: Tables) -> DataFrame:
    return _rounded(M.baselines(big_rows(t), ["task"], "id", "gold_index", "n_options"), "chance", "majority", "always_first", "random")


@query(f"""WITH {BIG_ROWS}, {BASELINES}, v AS (SELECT task, greatest(0, m.c / n - (chance + 0.10), always_first - (chance + 0.10), rnd - (chance + 0.05)) AS violation FROM a JOIN m USING (task))
SELECT task, round(violation, 9)::DOUBLE AS violation, violation <= 0 AS passed FROM v""")
def gate_and_violation(t: Tables) -> DataFrame:
    return _rounded(M.gates(M.baselines(big_rows(t), ["task"], "id", "gold_index", "n_options")).select("task", "violation", "passed"), "violation")


def _tried(most: int, least: int, attempts: int) -> str:
    """The whole search: every size and attempt of every task, and of these the best."""
    grid = S.size_grid(min(least, most), most)
    mixing = ", ".join(f"xor(u{i}, u{i} >> {shift}) * {factor} % {S.MODULUS} AS u{i + 1 if i < 2 else ''}" for i, (shift, factor) in enumerate(S.MIXING))
    return f"""c AS (SELECT task, gold_key, count(*) AS n FROM big_rows GROUP BY ALL), t AS (SELECT task, sum(n)::BIGINT AS total, least({most}, sum(n))::BIGINT AS upper FROM c GROUP BY task),
z AS (SELECT task, total, upper, unnest(CASE WHEN upper <= {least} THEN [upper] ELSE list_distinct(list_append(list_filter({grid}::BIGINT[], lambda s: s <= upper), upper)) END) AS size FROM t),
l AS (SELECT task, size, min(lv) AS lv FROM (SELECT task, size, lv, sum(least(n, lv)) AS s FROM z JOIN c USING (task), (SELECT unnest(range(1, {most} + 1)) AS lv) WHERE lv <= size GROUP BY ALL) WHERE s >= size GROUP BY ALL),
q AS (SELECT task, size, gold_key, n, upper, total, CASE WHEN n < lv THEN n WHEN row_number() OVER (PARTITION BY task, size, n >= lv ORDER BY n, gold_key) <= size - sum(least(n, lv - 1)) OVER (PARTITION BY task, size) THEN lv ELSE lv - 1 END AS quota FROM z JOIN l USING (task, size) JOIN c USING (task)),
h AS (SELECT *, ('0x' || substr({digest_sql(42, 'id')}, 1, 10))::BIGINT AS ha, ('0x' || substr({digest_sql(42, 'id')}, 11, 10))::BIGINT AS hb FROM big_rows),
k AS (SELECT h.task, h.id, h.gold_index, h.gold_key, size, attempt, quota, (ha + ((upper - size) * {S.SIZE_STEP} + attempt * {S.ATTEMPT_STEP}) * hb) % {S.MODULUS} AS u0, {mixing} FROM h JOIN q USING (task, gold_key), (SELECT unnest(range({attempts})) AS attempt)
 WHERE (attempt = 0 OR size < total) AND u < {S.MODULUS}::DOUBLE * (quota + 10 * sqrt(quota) + 30) / n),
w AS (SELECT task, id, gold_index, gold_key, size, attempt FROM k QUALIFY row_number() OVER (PARTITION BY task, size, attempt, gold_key ORDER BY u, id) <= quota),
d AS (SELECT task, size, attempt, gold_index, count(*) AS c FROM w GROUP BY ALL), m AS (SELECT task, size, attempt, max(c) AS c FROM d GROUP BY ALL),
a AS (SELECT task, size, attempt, count(*) AS n, 1.0::DOUBLE / 3 AS chance, avg((gold_index = 0)::INT) AS always_first, sum({_guessed(42, 'task', 'size', 'attempt', 'id')}) / (64 * count(*)) AS rnd FROM w GROUP BY ALL),
v AS (SELECT task, size, attempt, greatest(0, m.c / n - (chance + 0.10::DOUBLE), always_first - (chance + 0.10::DOUBLE), rnd - (chance + 0.05::DOUBLE)) AS violation FROM a JOIN m USING (task, size, attempt)),
f AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY violation > 0, round(violation, 12), size DESC, attempt) AS rn FROM v)"""


_BEST = "SELECT task, size, attempt::INT AS attempt, round(violation, 9) AS violation, violation <= 0 AS passed FROM f WHERE rn = 1"


def _chosen(t: Tables, most: int, least: int, strategy: str = "balanced") -> DataFrame:
    best = S.adaptive_search(big_rows(t), ["task"], "gold_key", "id", "gold_index", "n_options", most, least, strategy=strategy)
    return _rounded(best.select("task", "size", "attempt", "violation", "passed"), "violation")


@query(f"WITH {BIG_ROWS}, {_tried(60, 60, 128)} {_BEST}")
def retry_sampler(t: Tables) -> DataFrame:
    """Samples of 60 rows a task, with up to 128 attempts."""
    return _chosen(t, 60, 60)


@query(f"WITH {BIG_ROWS}, {_tried(96, 48, 128)} {_BEST}")
def adaptive_sampler(t: Tables) -> DataFrame:
    """All sizes from 96 down to 48, each with up to 128 attempts."""
    return _chosen(t, 96, 48)


@query(f"WITH {BIG_ROWS.replace('big_rows AS', 'keyed AS')}, big_rows AS (SELECT * REPLACE ('' AS gold_key) FROM keyed), {_tried(120, 112, 128)} {_BEST}")
def random_sampler(t: Tables) -> DataFrame:
    """As ``adaptive_sampler`` with samples of all rows alike."""
    return _chosen(t, 120, 112, "random")


LABEL_WORDS = ("red", "metal", "wid", "gad", "b")


@query(f"""
WITH {SRC_ITEMS}, k AS (SELECT *, regexp_matches(lower(name), '{'|'.join(T.PEOPLE)}')::INT AS people, row_number() OVER (PARTITION BY grp, name ORDER BY {digest_sql(42, 'id')}, id) AS rnd FROM src_items WHERE regexp_matches(lower(name), '{'|'.join(LABEL_WORDS)}'))
SELECT grp, id, name, row_number() OVER (PARTITION BY grp ORDER BY rnd, -people, name)::INT AS pick FROM k WHERE rnd <= 5 QUALIFY pick <= 40""")
def keyword_round_robin(t: Tables) -> DataFrame:
    """Names in turn, those about people first, five rows a name at most."""
    kept = src_items(t).where(T.matches_keywords("name", LABEL_WORDS))
    return S.round_robin(kept, ["grp"], "name", ["id"], 42, 40, cap=5, priority=[-T.people_priority("name")], small_first=False).select("grp", "id", "name", "pick")


@query(f"""WITH k AS (SELECT event_id, user_id % 50 AS scenario, event_type, row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY {digest_sql(42, 'event_id')}, event_id) AS rnd FROM events)
SELECT scenario, event_id, event_type, row_number() OVER (PARTITION BY scenario ORDER BY rnd, event_type)::INT AS pick FROM k QUALIFY pick <= 64""")
def event_round_robin(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", (F.col("user_id") % 50).alias("scenario"), "event_type")
    return S.round_robin(rows, ["scenario"], "event_type", ["event_id"], 42, 64, small_first=False).select("scenario", "event_id", "event_type", "pick")


@query(f"SELECT doc_id, lang FROM documents ORDER BY {digest_sql(42, 'doc_id')}, doc_id LIMIT 100")
def random_sample(t: Tables) -> DataFrame:
    return S.random_sample(t.documents.select("doc_id", "lang"), ["doc_id"], 42, 100)


SCORED = f"""{SRC_ITEMS}, t AS (SELECT DISTINCT name, grp, list_distinct(string_split(name, '_')) AS w FROM src_items),
s AS (SELECT a.name AS an, b.name AS bn, (len(list_intersect(a.w, b.w)) + CASE WHEN a.grp = b.grp THEN 2 ELSE 0 END + CASE WHEN starts_with(a.name, 'people_') AND starts_with(b.name, 'people_') THEN 1 ELSE 0 END)::DOUBLE AS score FROM t a, t b),
f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM src_items),
q AS (SELECT a.id, b.id AS candidate, s.score FROM src_items a JOIN s ON s.an = a.name JOIN f b ON b.name = s.bn AND b.n <= 10 WHERE a.id <> b.id)"""


def _top(order: str) -> str:
    return f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {order}, candidate) AS rank FROM q QUALIFY rank <= 9)
SELECT id, candidate, score, rank::INT AS rank, row_number() OVER (PARTITION BY id ORDER BY {digest_sql(42, 'id', 'candidate')}, candidate)::INT AS pick FROM r QUALIFY pick <= 3"""


@query(_top("score DESC"))
def similar_topk(t: Tables) -> DataFrame:
    return pools.top_similar(src_items(t), 9, 3, 42)


@query(_top("score"))
def dissimilar_topk(t: Tables) -> DataFrame:
    return pools.top_dissimilar(src_items(t), 9, 3, 42)


@query(f"""WITH {CLIPS}, b AS (SELECT *, CASE WHEN duration < 2.5 THEN 'short' WHEN duration < 5 THEN 'medium' ELSE 'long' END AS bucket, list_distinct(string_split(caption, ' ')) AS w FROM clips)
SELECT a.id, z.id AS candidate, round(({CLIP_SCORE}) / 20, 9) AS score, row_number() OVER (PARTITION BY a.id ORDER BY {CLIP_SCORE} DESC, z.id DESC)::INT AS rank FROM b a JOIN b z ON a.clip_index = z.clip_index AND a.bucket = z.bucket AND a.delivery <> z.delivery QUALIFY rank <= 8""")
def filtered_topk(t: Tables) -> DataFrame:
    rows = clips(t).withColumn("bucket", T.duration_bucket("duration"))
    return _rounded(pools.clips_by_score(rows, rows, 8, ["clip_index", "bucket"], ["delivery"], "most_last"), "score")


FALLBACK = f"""
l AS (SELECT event_id AS id, event_type || user_id AS ev, user_id AS sc, {digest_sql(42, 'event_id')} AS h FROM events),
z AS (SELECT a.id, b.id AS candidate, min(CASE WHEN a.ev = b.ev THEN 0 ELSE 1 END) AS tag, any_value(b.h) AS h FROM l a JOIN l b ON (a.sc = b.sc) WHERE a.id <> b.id GROUP BY ALL)
SELECT id, candidate, tag, row_number() OVER (PARTITION BY id ORDER BY tag, h, candidate)::INT AS pick FROM z QUALIFY pick <= 3"""


@query(f"WITH {FALLBACK}")
def fallback_pools(t: Tables) -> DataFrame:
    """Others of the same event type and user, topped up by the same user's."""
    rows = t.events.select(F.col("event_id").alias("id"), F.concat("event_type", F.col("user_id").cast("string")).alias("ev"), F.col("user_id").alias("sc"))
    return pools.fallback_pool(rows, rows, "ev", "sc", 3, 42)


@query(f"""WITH {CLIPS}, o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY clip_index, id) AS n FROM clips)
SELECT a.id, b.id AS neighbour FROM o a JOIN o b ON a.video = b.video AND b.n = CASE WHEN a.n = 1 THEN 2 ELSE 1 END""")
def neighbour_first(t: Tables) -> DataFrame:
    return pools.first_neighbour(clips(t), "video", "clip_index", "id")


@query(f"""WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY {digest_sql(11, 'vec_id')}, vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)
SELECT a.vec_id, s::INT AS step, z.vec_id AS candidate FROM o a, (SELECT unnest([1, 2]) AS s) JOIN o z ON z.i = (a.i + s) % a.n WHERE s < a.n""")
def modular_pairing(t: Tables) -> DataFrame:
    return pools.cyclic_pairs(t.embeddings.select("vec_id"), "vec_id", 11, 2)


@query(f"""WITH {SRC_ITEMS}, u AS (SELECT id, unnest([name, grp, 'none', 'other']) AS v, unnest([0, 1, 2, 3]) AS i FROM src_items),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {digest_sql(9, 'id', 'i')}, i) - 1 AS k FROM u)
SELECT id, string_agg(v, ',' ORDER BY k) AS options, max(CASE WHEN i = 0 THEN k END)::BIGINT AS gold_index FROM r GROUP BY id""")
def option_shuffle(t: Tables) -> DataFrame:
    mixed = seeded.shuffled(F.array("name", "grp", F.lit("none"), F.lit("other")), 9, F.col("id"))
    rows = src_items(t).withColumn("m", mixed)
    return rows.select("id", F.array_join(F.transform("m", lambda s: s["v"]), ",").alias("options"), (F.array_position(F.transform("m", lambda s: s["i"]), F.lit(0)) - 1).alias("gold_index"))


@query(f"""WITH p AS (SELECT doc_id, source, -abs(n_chars / 100.0 - 18)::DOUBLE AS prio, n_chars FROM documents WHERE NOT regexp_matches(text, '(?i)\\b(fuck|fucking|shit|bitch|cunt|dick|asshole)\\b') AND length(trim(text)) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY prio DESC, n_chars DESC, doc_id) AS o FROM p)
SELECT source, doc_id, printf('%s_%05d', source, o) AS item, least(greatest(n_chars / 100.0, 12), 24)::DOUBLE AS seconds FROM r WHERE o <= 6""")
def cue_top_n(t: Tables) -> DataFrame:
    """The six best candidates of each source, with running numbers in their names and clamped windows."""
    rows = t.documents.where(T.is_safe("text") & (F.length(F.trim("text")) > 0)).withColumn("prio", -F.abs(F.col("n_chars") / 100.0 - 18))
    best = S.top_n(rows, ["source"], [F.col("prio").desc(), F.col("n_chars").desc(), F.col("doc_id")], 6)
    return best.select("source", "doc_id", F.format_string("%s_%05d", "source", "ordinal").alias("item"), F.least(F.greatest(F.col("n_chars") / 100.0, F.lit(12.0)), F.lit(24.0)).alias("seconds"))


@query(f"""WITH {MODEL_SCORES}, h AS (SELECT model, lang, doc_id, predicted_index, gold_label, row_number() OVER (PARTITION BY model, lang ORDER BY doc_id) AS i FROM model_scores),
g AS (SELECT model, lang, gold_label AS g, row_number() OVER (PARTITION BY model, lang ORDER BY {digest_sql(3, 'doc_id')}, doc_id) AS i FROM model_scores)
SELECT h.model, h.lang, count(*) AS n, round(avg((h.predicted_index = (h.gold_label = 'high')::INT)::INT), 9) AS original, round(avg((h.predicted_index = (g.g = 'high')::INT)::INT), 9) AS shuffled FROM h JOIN g USING (model, lang, i) GROUP BY ALL""")
def label_shuffle_probe(t: Tables) -> DataFrame:
    """Accuracy before and after the gold labels of a task are dealt anew."""
    rows = model_scores(t).withColumn("original", F.col("gold_label"))
    mixed = S.permuted_gold(rows, ["model", "lang"], "doc_id", "doc_id", ["gold_label"], 3)
    right = lambda c: F.round(F.avg((F.col("predicted_index") == (F.col(c) == "high").cast("int")).cast("double")), 9)
    return mixed.groupBy("model", "lang").agg(F.count("*").alias("n"), right("original").alias("original"), right("gold_label").alias("shuffled"))


@query(f"""WITH {MODEL_SCORES}, x AS (SELECT model, lang, avg((predicted_index = 1 - (gold_label = 'high')::INT)::INT) AS m FROM model_scores GROUP BY ALL) SELECT model, round(avg(m), 9) AS flipped_macro, count(*) AS n_tasks FROM x GROUP BY model""")
def binary_flip_probe(t: Tables) -> DataFrame:
    rows = model_scores(t).withColumn("gold_index", (F.col("gold_label") == "high").cast("long")).withColumn("options", F.array(F.lit("low"), F.lit("high")))
    flipped = S.binary_flip(rows, ["model", "lang"], "options", "gold_index")
    task = flipped.groupBy("model", "lang").agg(F.avg((F.col("predicted_index") == F.col("gold_index")).cast("double")).alias("m"))
    return task.groupBy("model").agg(F.round(F.avg("m"), 9).alias("flipped_macro"), F.count("*").alias("n_tasks"))


@query(f"""WITH {MODEL_SCORES}, s AS (SELECT lang, model, avg(metric) AS score FROM model_scores GROUP BY ALL), b AS (SELECT lang, model, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, model) AS rn FROM s),
p AS (SELECT lang, max(CASE WHEN model = 'model_0' THEN score END) AS m0, max(CASE WHEN model = 'model_1' THEN score END) AS m1, max(CASE WHEN model = 'model_2' THEN score END) AS m2 FROM s GROUP BY lang)
SELECT t.lang, round(m0, 6) AS model_0, round(m1, 6) AS model_1, round(m2, 6) AS model_2, b.model AS best_model, round(b.score, 6) AS best_score FROM (SELECT DISTINCT lang FROM documents) t LEFT JOIN p ON p.lang = t.lang LEFT JOIN b ON b.lang = t.lang AND b.rn = 1""")
def results_pivot(t: Tables) -> DataFrame:
    """A row for each task, a column for each model, and the best of them; tasks without results stay."""
    scores = model_scores(t).groupBy(F.lit("all").alias("tier"), F.col("lang").alias("task_dir"), "model").agg(F.avg("metric").alias("score"))
    tasks = t.documents.select(F.lit("all").alias("tier"), F.col("lang").alias("task_dir")).distinct()
    wide = results_table(tasks, scores, ["model_0", "model_1", "model_2"])
    return _rounded(wide.select(F.col("task_dir").alias("lang"), "model_0", "model_1", "model_2", "best_model", "best_score"), "model_0", "model_1", "model_2", "best_score", digits=6)


@query(f"""WITH {LABEL_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM label_rows)
SELECT source AS task_name, printf('%s/item_%02d', source, rn) AS item_dir, 'A. low' || chr(10) || 'B. high' AS options, gold_label AS answer_key FROM r WHERE rn <= 8""")
def public_packet(t: Tables) -> DataFrame:
    """The first eight items of each task with neutral names, and the key that people don't see."""
    first = S.top_n(label_rows(t), ["source"], [F.col("doc_id")], 8)
    return first.select(F.col("source").alias("task_name"), F.format_string("%s/item_%02d", "source", "ordinal").alias("item_dir"), T.option_lines(F.col("label_space")).alias("options"), F.col("gold_label").alias("answer_key"))


RULES = [("purchase", "event_type = 'purchase'", 20), ("high", "value > 90", 20), ("early", "user_id < 50", 20), ("click", "event_type = 'click'", 20)]


def _rules_sql() -> str:
    parts, taken = [], []
    for name, rule, cap in RULES:
        anti = "".join(f" AND user_id NOT IN (SELECT user_id FROM {x})" for x in taken)
        parts.append(f"{name}_ AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE {rule}{anti} GROUP BY user_id ORDER BY 2 LIMIT {cap})")
        taken.append(f"{name}_")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT user_id, event_id, '{n}' AS category FROM {n}_" for n, _, _ in RULES)


@query(_rules_sql())
def rule_selection(t: Tables) -> DataFrame:
    """Rules in turn, each takes the first users that none before it took."""
    rows = t.events.select("user_id", "event_id", "event_type", "value")
    return S.first_matches(rows, [(n, F.expr(r)) for n, r, _ in RULES], "user_id", "event_id", 20).select("user_id", "event_id", "category")


@query(f"""WITH {CLIPS}, o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY clip_index, id) AS n FROM clips), p AS (SELECT a.id, b.id AS positive, b.text AS pt FROM o a JOIN o b ON a.video = b.video AND b.n = CASE WHEN a.n = 1 THEN 2 ELSE 1 END)
SELECT id, positive, len(regexp_extract_all(lower(pt), '[\\p{{L}}\\p{{N}}]+'))::BIGINT AS n_tokens, {draw_sql('2', 21, 'id')} AS gold_index FROM p WHERE len(regexp_extract_all(lower(pt), '[\\p{{L}}\\p{{N}}]+')) >= 4""")
def task_continuation(t: Tables) -> DataFrame:
    """Turn-holding items: the first other clip of the same video with enough tokens, and a seeded place for it."""
    rows = clips(t)
    pairs = pools.first_neighbour(rows, "video", "clip_index", "id").select("id", F.col("neighbour").alias("positive"))
    n = F.size(T.tokens("pt"))
    return pairs.join(rows.select(F.col("id").alias("positive"), F.col("text").alias("pt")), "positive").where(n >= 4).select("id", "positive", n.cast("long").alias("n_tokens"), seeded.draw(F.lit(2), 21, F.col("id")).alias("gold_index"))
