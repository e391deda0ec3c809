"""Samplers against loops that follow the rules."""

import pytest
from pyspark.sql import functions as F

from gaugemill.operators import sampling as S


def turns(sizes, limit):
    """Rows of each group that a round robin takes, small groups first, then by name."""
    left, taken = dict(sizes), dict.fromkeys(sizes, 0)
    order = sorted(sizes, key=lambda k: (sizes[k], k))
    while sum(taken.values()) < limit and any(left.values()):
        for k in order:
            if left[k] and sum(taken.values()) < limit:
                left[k] -= 1
                taken[k] += 1
    return {k: n for k, n in taken.items() if n}


def test_quotas_follow_the_turns(spark):
    tasks = {"t": {"a": 1, "b": 3, "c": 3, "d": 9}, "u": {"x": 5}, "v": {"k": 2, "a": 2, "m": 100}}
    groups = spark.createDataFrame([(t, g, n) for t, gs in tasks.items() for g, n in gs.items()], "task string, g string, n long")
    sizes = S.task_sizes(groups, ["task"], 12, 1)
    got = {}
    for r in S.quotas(groups, ["task"], "g", sizes).collect():
        got.setdefault((r.task, r["size"]), {})[r.g] = r.quota
    for (task, size), taken in got.items():
        assert taken == turns(tasks[task], size), (task, size)
    assert {k[1] for k in got if k[0] == "u"} == set(range(1, 6)) and {k[1] for k in got if k[0] == "t"} == set(range(1, 13))


def test_sizes_follow_the_grid(spark):
    groups = spark.createDataFrame([("big", "g", 700), ("small", "g", 20), ("tiny", "g", 9)], "task string, g string, n long")
    got = {}
    for r in S.task_sizes(groups, ["task"], 600, 16).collect():
        got.setdefault(r.task, set()).add(r["size"])
    whole = {*range(16, 65), *range(80, 601, 16), 600, 512, 384, 256, 192, 160, 128, 96, 80, 64, 48, 40, 32, 24, 16}
    assert got == {"big": whole, "small": {16, 17, 18, 19, 20}, "tiny": {9}}


def rows(spark):
    gold = F.when(F.col("id") % 4 == 0, 0).when(F.col("id") % 4 == 1, 1).otherwise(2).cast("long")
    return spark.range(4000).select("id", F.when(F.col("id") < 3900, "even").when(F.col("id") < 3990, "small").otherwise("tiny").alias("task"), gold.alias("gold"), F.lit(3).alias("n"), F.concat(F.lit("index:"), gold.cast("string")).alias("k"))


@pytest.mark.parametrize("strategy", ["balanced", "random"])
def test_search_and_its_rows(spark, strategy):
    table = rows(spark)
    best = {r.task: r for r in S.adaptive_search(table, ["task"], "k", "id", "gold", "n", 90, 30, 8, 3, 16, strategy).collect()}
    assert best["tiny"]["size"] == 10 and best["tiny"].attempt == 0 and best["tiny"].n == 10
    if strategy == "balanced":
        assert best["even"].passed and best["even"]["size"] == 90 and best["even"].attempt == 0
        assert best["small"].passed and best["small"]["size"] < 90  # all 90 rows have half their golds in one
    made = S.adaptive_search(table, ["task"], "k", "id", "gold", "n", 90, 30, 8, 3, 16, strategy)
    drawn = S.samples_of(table, ["task"], "k", "id", made, 90, 30, 3, strategy)
    assert {r.task: r["count"] for r in drawn.groupBy("task").count().collect()} == {t: r.n for t, r in best.items()}
    assert drawn.select("id").distinct().count() == drawn.count()
    top = {r.task: r.c for r in drawn.groupBy("task", "gold").count().groupBy("task").agg(F.max("count").alias("c")).collect()}
    assert all(abs(top[t] / r.n - r.majority) < 1e-9 for t, r in best.items())


def test_samples_are_even_draws(spark):
    """Over many attempts every row of a group is drawn about as often, also when too few rows are below the bound."""
    table = spark.range(200).select("id", F.lit("t").alias("task"), F.lit("g").alias("_group"))
    wanted = spark.createDataFrame([("t", "g", 200, 20, 20, 20, list(range(400)))], "task string, _group string, n long, size long, upper long, quota long, attempt array<int>")
    got = S.drawn(table, ["task"], "_group", "id", wanted, 5)
    assert {r["count"] for r in got.groupBy("attempt").count().collect()} == {20} and got.groupBy("attempt").count().count() == 400
    counts = [r["count"] for r in got.groupBy("id").count().collect()]
    assert len(counts) == 200 and 10 <= min(counts) and max(counts) <= 75
    far = spark.createDataFrame([("t", "g", 10**9, 20, 20, 20, [0, 1])], "task string, _group string, n long, size long, upper long, quota long, attempt array<int>")
    assert S.drawn(table, ["task"], "_group", "id", far, 5).count() == 40  # the bound is far too low; all rows are drawn from again


def test_no_rows(spark):
    table = rows(spark).limit(0)
    best = S.adaptive_search(table, ["task"], "k", "id", "gold", "n", 90, 30, 8)
    assert best.count() == 0 and S.samples_of(table, ["task"], "k", "id", best, 90, 30).count() == 0
    with pytest.raises(ValueError):
        S.adaptive_search(table, ["task"], "k", "id", "gold", "n", 90, 30, 8, strategy="other")


def test_rows_are_made_only_for_attempts_they_take_part_in(spark):
    """By batches; a row for every attempt of every row would grow 128 times the table before its filter."""
    from gaugemill.operators import sampling

    cases = [(i * 7_368_787 + 11, i * 99_991 + 5, i * sampling.SIZE_STEP, sampling.MODULUS // 9, i % 3, 0 if i == 4 else 40) for i in range(50)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a long, b long, s long, bound long, first int, n int")
    got = {r.i: r.x for r in rows.select("i", sampling._takes_part()("a", "b", "s", "bound", "first", "n").alias("x")).collect()}

    def place(a, b, step):
        u = (a + step * b) % sampling.MODULUS
        for shift, factor in sampling.MIXING:
            u = (u ^ u >> shift) * factor % sampling.MODULUS
        return u

    want = {i: [k for k in range(f, f + n) if place(a, b, s + k * sampling.ATTEMPT_STEP) < bound] for i, (a, b, s, bound, f, n) in enumerate(cases)}
    assert got == want and any(want.values()) and not want[4]
