"""Seeded samples: balanced round robin, capped, random, with retries and with a search over sizes.

A round robin over groups is an order by (position in the group, group), so one window and one sort by task give what
a loop over groups gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.seeded import digest
from . import metrics
from .order import placed, settled, spread


def round_robin(rows: DataFrame, by: list[str], group: str, key: list[str], seed: Column | int, limit: Column | int, cap: int | None = None, priority: list[Column] = (), small_first: bool = True) -> DataFrame:
    """Up to ``limit`` rows of each task, group by group in turn, in seeded order within a group; adds ``pick`` from 1.

    Groups are visited by ``priority``, then (with ``small_first``) by size, then by name. ``cap`` bounds rows a group.
    No more than ``limit`` rows of a group can be picked, so only these go on to the task's own order; sizes are counted
    apart, so that the bound reaches the rows before they are shuffled.
    """
    inner = Window.partitionBy(*by, group).orderBy(digest(seed, *map(F.col, key)), *key)
    bound = limit if cap is None else min(cap, limit) if isinstance(limit, int) else F.least(F.lit(cap), limit)
    sized = rows.withColumn("_round", F.row_number().over(inner)).where(F.col("_round") <= bound)
    if small_first:
        sized = sized.join(rows.groupBy(*by, group).agg(F.count("*").alias("_size")), [*by, group])
    turn = [F.col("_round"), *priority, *([F.col("_size")] if small_first else []), F.col(group)]
    picked = sized.withColumn("pick", F.row_number().over(Window.partitionBy(*by).orderBy(*turn)))
    return picked.where(F.col("pick") <= limit).select(*rows.columns, "pick")


def random_sample(rows: DataFrame, key: list[str], seed: int, limit: int) -> DataFrame:
    """``limit`` rows without replacement, in seeded order."""
    return rows.orderBy(digest(seed, *map(F.col, key)), *key).limit(limit)


def top_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1 as ``ordinal``."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("ordinal") <= n)


def filled(candidates: DataFrame, by: list[str], order: list[Column], n: int, attempt: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(successes, failures): each group's first ``n`` candidates for which ``attempt`` succeeds, and those that failed before.

    ``attempt`` takes candidates and gives them back with ``error``, null where it succeeded. Successes are numbered from 1 as
    ``ordinal``, which failures don't use up. ``order`` is ascending and must tell a group's rows apart; rows without a group
    must be left out before. The first ``n`` of a group are tried, then, of groups that fell short, as many again as were
    tried so far, so at most about twice as many are tried as one after the other. Only groups that fell short are put in
    order whole, and no task holds a group. What was tried is written, so no attempt is made twice for a lost executor.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = candidates.select("*", *(c.alias(name) for c, name in zip(order, names, strict=True)))
    first = top_n(keyed, by, [F.col(c) for c in names], n).withColumnRenamed("ordinal", "_rank")
    tried, upto, ranked = settled(attempt(first.drop(*names))), n, None
    while True:
        got = tried.groupBy(*by).agg(F.count_if(F.col("error").isNull()).alias("_got"), F.count("*").alias("_tried"))
        short = settled(got.where((F.col("_got") < n) & (F.col("_tried") == upto)).select(*by))
        if short.isEmpty():
            break
        if ranked is None:
            at = placed(keyed.join(short, by, "left_semi"), [*by, *names], "_at")
            begins = at.groupBy(*by).agg(F.min("_at").alias("_begin"))
            ranked = at.join(begins, by).withColumn("_rank", F.col("_at") - F.col("_begin") + 1).select(*candidates.columns, "_rank")
        more = ranked.where((F.col("_rank") > upto) & (F.col("_rank") <= 2 * upto)).join(short, by, "left_semi")
        tried, upto = settled(tried.unionByName(attempt(more))), 2 * upto
    succeeded = F.count_if(F.col("error").isNull()).over(Window.partitionBy(*by).orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = tried.withColumn("ordinal", succeeded)
    done = told.where(F.col("error").isNull() & (F.col("ordinal") <= n)).drop("_rank", "error")
    return done, told.where(F.col("error").isNotNull() & (F.col("ordinal") < n)).drop("_rank", "ordinal")


#: A row's place in an attempt is below this: a number linear in the attempt's, with its bits mixed by steps of
#: (shift, factor). One digest a row serves all attempts, and rows of an attempt are independent.
MODULUS = 1 << 40
MIXING = ((17, 8388593), (19, 7340033), (21, 1))
#: Steps of that number from size to size and from attempt to attempt.
SIZE_STEP, ATTEMPT_STEP = 7919, 9973
#: Sizes that are tried besides the small and the even ones.
FIXED_SIZES = (512, 384, 256, 192, 160, 128, 96, 80, 64, 48, 40, 32, 24, 16)


def size_grid(least: int, upper: int, fixed: tuple[int, ...] = FIXED_SIZES) -> list[int]:
    """Sizes to try, largest first: each up to 64, then every 16th, the fixed ones and the upper end."""
    sizes = {*range(least, min(64, upper) + 1), *range(80, upper + 1, 16), *(f for f in fixed if least <= f <= upper), upper, least}
    return sorted((n for n in sizes if least <= n <= upper), reverse=True)


def task_sizes(groups: DataFrame, by: list[str], most: int, least: int) -> DataFrame:
    """(by, size, upper, all): the sizes of each task, which end at its number of rows; where that or ``most`` isn't above
    ``least``, it is the only one. ``groups`` has the columns ``by`` and ``n``, the rows of a group."""
    tasks = groups.groupBy(*by).agg(F.sum("n").alias("all")).withColumn("upper", F.least(F.lit(most).cast("long"), F.col("all")))
    grid = F.array(*(F.lit(n).cast("long") for n in size_grid(min(least, most), most)))
    own = F.when(F.col("upper") <= least, F.array("upper")).otherwise(F.array_union(F.filter(grid, lambda n: n <= F.col("upper")), F.array("upper")))
    return tasks.withColumn("size", F.explode(own)).select(*by, "size", "upper", "all")


def quotas(groups: DataFrame, by: list[str], group: str, sizes: DataFrame) -> DataFrame:
    """How many rows of each group a round robin takes for each size: groups in turn, small ones first, then by name.

    All groups give up to a level, where their sum first reaches the size; in the last round only the first ones do.
    """
    together = groups.groupBy(*by).agg(F.collect_list("n").alias("_ns"))
    given = lambda l: F.aggregate("_ns", F.lit(0).cast("long"), lambda s, n: s + F.least(n, l))  # noqa: E731, E741
    level = F.element_at(F.filter(F.sequence(F.lit(1).cast("long"), F.col("size")), lambda l: given(l) >= F.col("size")), 1)  # noqa: E741
    levels = sizes.join(together, by).withColumn("_level", level).withColumn("_rest", F.col("size") - given(F.col("_level") - 1)).drop("_ns")
    each = groups.join(levels, by)
    turn = F.row_number().over(Window.partitionBy(*by, "size", F.col("n") >= F.col("_level")).orderBy("n", group))
    quota = F.when(F.col("n") < F.col("_level"), F.col("n")).when(turn <= F.col("_rest"), F.col("_level")).otherwise(F.col("_level") - 1)
    return each.withColumn("quota", quota.cast("long")).where("quota > 0").drop("_level", "_rest")


def _takes_part() -> Callable[..., Column]:
    """The attempts, of ``count`` from ``first`` on, in which a row's place is below its bound: by batches, so that no row is
    made for an attempt that it takes no part in."""

    def attempts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            a, b, step, bound, first, count = (x.to_numpy(np.int64, copy=True) for x in batch)
            found = np.empty(len(a), object)
            found[:] = [[]] * len(a)
            upto = first + count
            for k in range(int(first.min(initial=0)), int(upto.max(initial=0))):
                u = (a + (step + k * ATTEMPT_STEP) * b) & (MODULUS - 1)
                for shift, factor in MIXING:
                    u ^= u >> shift
                    u *= factor
                    u &= MODULUS - 1
                for i in np.flatnonzero((u < bound) & (first <= k) & (k < upto)):
                    found[i] = [*found[i], k]
            yield pd.Series(found)

    return F.pandas_udf(attempts, "array<int>")


def drawn(rows: DataFrame, by: list[str], group: str, key: str, wanted: DataFrame, seed: int) -> DataFrame:
    """The rows of balanced samples: of every (task, group, size, attempt) in ``wanted``, which also has n, quota and upper,
    the ``quota`` first rows in seeded order. ``attempt`` there is an array of successive numbers.

    A row takes part in an attempt only if its place is below a bound by the group's size that leaves some more rows than
    are wanted, so what is shuffled follows the samples and not the table. Groups in which too few are below are drawn
    again from all their rows.
    """
    hashed = digest(seed, F.col(key))
    part = lambda i: F.conv(F.substring(hashed, i, 10), 16, 10).cast("long")
    step = (F.col("upper") - F.col("size")) * SIZE_STEP + F.col("attempt") * ATTEMPT_STEP
    below = lambda u: u.bitwiseAND(F.lit(MODULUS - 1))  # noqa: E731  the remainder, as none is negative
    place = below(F.col("_a") + step * F.col("_b"))
    bound = F.when(F.col("all"), F.lit(MODULUS)).otherwise(F.least(F.lit(MODULUS).cast("double"), F.lit(float(MODULUS)) * (F.col("quota") + 8 * F.sqrt("quota") + 16) / F.col("n")).cast("long"))
    named = rows.withColumn("_a", part(1)).withColumn("_b", part(11))
    of = [*by, group, "size", "attempt"]

    def taken(asked: DataFrame) -> DataFrame:
        spread = asked.withColumn("_bound", bound).groupBy(*by, group).agg(F.collect_list(F.struct("size", "upper", "quota", "_bound", F.col("attempt").alias("tries"))).alias("_w"))
        met = named.join(spread, [*by, group]).select(*rows.columns, "_a", "_b", F.explode("_w").alias("_w")).select(*rows.columns, "_a", "_b", "_w.*")
        own = _takes_part()("_a", "_b", (F.col("upper") - F.col("size")) * SIZE_STEP, "_bound", F.element_at("tries", 1), F.size("tries"))
        each = met.withColumn("attempt", F.explode(own)).drop("tries").withColumn("_u", place)
        for shift, factor in MIXING:
            each = each.withColumn("_u", below(F.col("_u").bitwiseXOR(F.shiftright("_u", shift)) * factor))
        ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy(*of).orderBy("_u", key)))
        return ranked.where(F.col("_r") <= F.col("quota")).select(*rows.columns, "size", "attempt")

    asked = wanted.withColumn("all", F.lit(False))
    first = settled(taken(asked))
    counts = first.groupBy(*of).agg(F.count("*").alias("_k"))
    tries = wanted.withColumn("attempt", F.explode("attempt"))
    short = tries.join(counts, of, "left").where(F.coalesce("_k", F.lit(0)) < F.col("quota")).drop("_k")
    if short.isEmpty():
        return first
    again = taken(short.withColumn("attempt", F.array("attempt")).withColumn("all", F.lit(True)))
    return first.join(short.select(*of), of, "left_anti").unionByName(again)


def _wanted(groups: DataFrame, by: list[str], group: str, sizes: DataFrame, n_attempts: int) -> DataFrame:
    """Quotas with the attempts of each size; a task with no more rows than the size is taken whole, once."""
    tries = F.when(F.col("size") >= F.col("all"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(n_attempts - 1)))
    return quotas(groups, by, group, sizes).withColumn("attempt", tries).select(*by, group, "n", "size", "upper", "quota", "attempt")


def adaptive_search(rows: DataFrame, by: list[str], group: str, key: str, gold: str, n_options: str, most: int, least: int, n_attempts: int = 128, seed: int = 42, trials: int = 64, strategy: str = "balanced") -> DataFrame:
    """Of each task the size and attempt that the search ends at, with its diagnostics; ``samples_of`` gives its rows.

    Sizes are tried from ``most`` down to ``least``, each with up to ``n_attempts`` samples of its own seed, balanced over
    ``group`` or (``strategy`` "random") over all rows alike. The first sample that passes the gates ends a task's search;
    if none does, the one with the least violation is best: of the same, the larger, then the earlier. Sizes run in batches,
    one, then two, four and so on, and only for the tasks that are still open.
    """
    dealt, groups = _grouped(rows, by, group, strategy)
    order = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("size"))) - 1
    grid = settled(task_sizes(groups, by, most, least).withColumn("_turn", order))
    light = spread(dealt.select(*by, "_group", key, gold, n_options), key)
    begin, count, tried = 0, 1, None
    while True:
        batch = grid.where((F.col("_turn") >= begin) & (F.col("_turn") < begin + count))
        if tried is not None:
            batch = batch.join(tried.where("passed").select(*by).distinct(), by, "left_anti")
        if batch.isEmpty():
            break
        samples = drawn(light, by, "_group", key, _wanted(groups, by, "_group", batch, n_attempts), seed)
        made = settled(metrics.gates(metrics.baselines(samples, [*by, "size", "attempt"], key, gold, n_options, trials, seed)))
        tried = made if tried is None else tried.unionByName(made)
        begin, count = begin + count, count * 2
    if tried is None:  # there are no rows
        empty = light.withColumn("size", F.lit(0).cast("long")).withColumn("attempt", F.lit(0))
        return metrics.gates(metrics.baselines(empty, [*by, "size", "attempt"], key, gold, n_options, trials, seed))
    return settled(best_attempt(tried, by))


def samples_of(rows: DataFrame, by: list[str], group: str, key: str, best: DataFrame, most: int, least: int, seed: int = 42, strategy: str = "balanced") -> DataFrame:
    """The rows of the tasks, sizes and attempts in ``best``, as the search with these parameters drew them."""
    dealt, groups = _grouped(rows, by, group, strategy)
    sizes = task_sizes(groups, by, most, least).join(best.select(*by, "size"), [*by, "size"])
    chosen = quotas(groups, by, "_group", sizes).join(best.select(*by, "size", F.array("attempt").alias("attempt")), [*by, "size"])
    return drawn(dealt, by, "_group", key, chosen.select(*by, "_group", "n", "size", "upper", "quota", "attempt"), seed).drop("_group")


def _grouped(rows: DataFrame, by: list[str], group: str, strategy: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the group that a strategy balances, and the sizes of the groups."""
    if strategy not in ("balanced", "random"):
        raise ValueError(f"strategy {strategy!r} is neither balanced nor random")
    dealt = rows.withColumn("_group", F.col(group).cast("string") if strategy == "balanced" else F.lit(""))
    return dealt, settled(dealt.groupBy(*by, "_group").agg(F.count("*").alias("n")))


def best_attempt(tried: DataFrame, by: list[str]) -> DataFrame:
    """The largest size's first attempt that passes, or else the least violation, the larger size, the earlier attempt."""
    failing = F.when(F.col("passed"), F.lit(0.0)).otherwise(F.col("violation"))
    w = Window.partitionBy(*by).orderBy(~F.col("passed"), F.round(failing, 12), F.col("size").desc(), "attempt")
    return tried.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def permuted_gold(rows: DataFrame, by: list[str], order: str, key: str, gold: list[str], seed: int) -> DataFrame:
    """Gold columns dealt anew among the rows of a task."""
    here = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    there = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(digest(seed, F.col(key)), key))).select(*by, "_i", *gold)
    return here.drop(*gold).join(there, [*by, "_i"]).drop("_i")


def binary_flip(rows: DataFrame, by: list[str], options: str, gold_index: str) -> DataFrame:
    """Rows of tasks in which every row has two options, with the other option as gold."""
    w = Window.partitionBy(*by)
    return rows.withColumn("_two", F.bool_and(F.size(options) == 2).over(w)).where("_two").drop("_two").withColumn(gold_index, 1 - F.col(gold_index))


def first_matches(rows: DataFrame, rules: list[tuple[str, Column]], key: str, order: str, cap: int) -> DataFrame:
    """For each rule in turn the first ``cap`` keys that no earlier rule took; what is beyond the cap stays for later ones."""
    taken = None
    first = metrics.deduplicated
    for name, rule in rules:
        open_rows = rows.where(rule)
        if taken is not None:
            open_rows = open_rows.join(taken.select(key), key, "left_anti")
        chosen = first(open_rows, [key], [order]).orderBy(order).limit(cap).withColumn("category", F.lit(name))
        taken = chosen if taken is None else taken.unionByName(chosen)
    return taken
