"""Replicates against the law of drawing n of n with replacement."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugemill.operators import metrics as M, resample


def test_small_groups_have_the_exact_law(spark):
    """Of three rows, a replicate's counts are one of ten, with multinomial chances."""
    rows = spark.createDataFrame([(0, 1.0), (1, 10.0), (2, 100.0)], "id long, v double")
    got = Counter(round(3 * r.mean) for r in resample.replicate_means(rows, [], "v", ["id"], 6000, 7).collect())
    want = {a + 10 * b + 100 * c: math.factorial(3) / (math.factorial(a) * math.factorial(b) * math.factorial(c)) / 27 for a in range(4) for b in range(4 - a) for c in [3 - a - b]}
    assert set(got) == set(want)
    assert sum((got[k] - 6000 * p) ** 2 / (6000 * p) for k, p in want.items()) < 27.9  # chi square, 9 degrees, one in a thousand


@pytest.mark.parametrize("block", [4096, 16])
def test_replicates_draw_as_many_rows_as_there_are(spark, monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").when(F.col("id") < 999, "small").alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    got = resample.replicate_means(rows, ["g"], "v", ["id"], 200, 3).collect()
    assert Counter((r.g, r.drawn) for r in got) == {("big", 900): 200, ("small", 99): 200, (None, 1): 200}
    means = [r.mean for r in got if r.g == "big"]
    true, spread = sum(i % 7 for i in range(900)) / 900, math.sqrt(4.0 / 900)
    assert abs(sum(means) / 200 - true) < 4 * spread / math.sqrt(200)
    assert 0.8 < math.sqrt(sum((m - true) ** 2 for m in means) / 200) / spread < 1.2


def test_draws_of_blocks(spark, monkeypatch):
    """A tree over uneven blocks: the draws of a replicate add up, and follow the blocks' sizes."""
    n, blocks, samples = 10 * 4096 + 5, 11, 400
    each = spark.range(samples).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    got = each.withColumn("c", resample.block_draws(F.lit(n), F.col("block"), 1, F.col("id"))).groupBy("id").pivot("block", list(range(blocks))).sum("c").collect()
    assert all(sum(r[1:]) == n and min(r[1:]) >= 0 for r in got)
    first = [r[1] for r in got]
    p = 4096 / n
    assert abs(sum(first) / samples - n * p) < 5 * math.sqrt(n * p * (1 - p) / samples)
    assert 0.85 < math.sqrt(sum((x - n * p) ** 2 for x in first) / samples / (n * p * (1 - p))) < 1.15
    assert 0.5 < sum(r[11] for r in got) / samples / 5 < 2


def test_levels_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], None if i == 0 else "xyz"[i % 3], float(i % 2)) for i in range(60)], "id long, tier string, task string, m double")
    got = {(r.level, r.tier, r.task): r for r in M.level_intervals(rows, "tier", "task", "m", ["id"], 50).collect()}
    assert got[3, None, None].n == 60 and got[3, None, None].ci_low < 0.5 < got[3, None, None].ci_high
    assert got[1, "a", None].n == 30 and got[0, "a", None].n == 1 and got[1, "a", None].ci_high == 0.0
    assert M.level_intervals(rows.limit(0), "tier", "task", "m", ["id"], 50).count() == 0
    pair = rows.withColumn("r", F.lit(0.0))
    over = M.level_comparison(pair, "tier", "task", "m", "r", ["id"], 50).where("level = 3").first()
    assert over.observed_difference == 0.5 and over.p_value < 0.05


def test_guesses_of_trials_are_as_cheap_as_a_batch(spark):
    """64 terms for each row in one expression are more code than the JVM compiles; golds may be missing."""
    rows = spark.range(2_000_000).select("id", (F.col("id") % 2).alias("t"), F.when(F.col("id") != 7, F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, 3).alias("n"))
    plan = M.baselines(rows, ["t"], "id", "g", "n")._jdf.queryExecution().executedPlan().toString()
    assert "1099511627776" not in plan
    got = {r.t: r.random for r in M.baselines(rows, ["t"], "id", "g", "n").collect()}
    assert all(abs(x - (0.8 / 3 + 0.2 / 3)) < 0.005 for x in got.values())
