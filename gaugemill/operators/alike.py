"""The most and the least alike rows of every row, by weighted features in common.

A row has features with whole weights: tokens, or traits that count as much as several tokens. The few commonest features
make a row's signature. Between two signatures what they share is known at once, so for every signature the candidates
can be listed in order of it, and then of ids: what isn't listed shares no less (no more, from the other end) of the common
features. A row without other features is done with its signature's list. Towards the least alike the others are scored
with the rows of their list, and done if what isn't listed can't be better.

What lists can't settle is compared in blocks: some thousand targets with some thousand rows of the pool of equal values,
by bits and small indexes, and of every target only the best rows leave a block. So results are exact, and no shuffle or
task grows with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .order import settled, spread

#: Rows of a list; a feature that one row of a block in so many has is a bit, others are indexed; towards the least alike
#: pools of so few rows aren't listed. Parts that the rows of a signature are dealt into.
LISTED, INDEXED, WHOLE, PARTS = 32, 64, 1024, 8
#: Signatures at most, features in them at most; a feature in them is had by one row in so many at least.
SIGNATURES, COMMONEST, COMMON = 256, 64, 64
#: Entries of all lists together up to which every task takes all lists.
CARRIED = 1 << 15
#: Rows of the pool and targets of a block.
BLOCK, TARGETS = 1 << 15, 1 << 14


def _features(columns: dict[int, str]) -> Column:
    """``weight:feature`` strings, each once."""

    def weighed(weight: int, name: str) -> Column:
        return F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda v: F.concat(F.lit(f"{weight}:"), v))

    return F.array_distinct(F.filter(F.concat(*(weighed(w, c) for w, c in columns.items())), lambda v: v.isNotNull()))


def _weight(features: Column) -> Column:
    return F.aggregate(features, F.lit(0), lambda n, v: n + F.substring_index(v, ":", 1).cast("int"))


def _shaped(rows: DataFrame, id_: str, equal: list[str], differ: list[str], features: dict[int, str]) -> DataFrame:
    """id, equal values, other values (as 64-bit numbers, as they are only compared) and features."""
    same = F.to_json(F.struct(*equal)) if equal else F.lit("")
    other = F.array(*(F.xxhash64(F.to_json(F.struct(F.col(c).alias("v")))) for c in differ)) if differ else F.array().cast("array<bigint>")
    return rows.select(F.col(id_).alias("id"), same.alias("e"), other.alias("d"), F.array_sort(_features(features)).alias("f"))


def _commonest(pool: DataFrame) -> list[str]:
    """The commonest features, as many as leave SIGNATURES signatures at most."""
    total = pool.count()
    counts = pool.select(F.explode("f").alias("f")).groupBy("f").count().where(F.col("count") * COMMON >= total).orderBy(F.desc("count"), "f").limit(COMMONEST)
    names = [r["f"] for r in counts.collect()]
    sizes = [n for n in (2, 4, 6, 8, 12, 16, 24, 32, 48, 64) if n < len(names)] + ([len(names)] if names else [])
    if not sizes:
        return []
    kinds = pool.select(F.array_intersect(F.array(*map(F.lit, names)), "f").alias("f")).distinct()
    seen = kinds.agg(*(F.approx_count_distinct(F.array_join(F.array_intersect(F.array(*map(F.lit, names[:n])), "f"), "\n")).alias(f"n{n}") for n in sizes)).first()
    return names[: max((n for n in sizes if seen[f"n{n}"] <= SIGNATURES), default=0)]


def ranked(targets: DataFrame, pool: DataFrame, id_: str, cap: int, features: dict[int, str], equal: list[str] = (), differ: list[str] = (), end: str = "least") -> DataFrame:
    """For every target the ``cap`` first rows of ``pool`` that have another id, equal values in ``equal`` and other ones in
    every column of ``differ``: by (score, id), or with ``end`` "most" by (score descending, id), with "most_last" by both
    descending. Columns id, candidate, score, rank (from 1).

    ``features`` names the arrays of features by their weight; repeats count once, nulls not at all. Nulls are values like
    others in ``equal`` and ``differ``. Equal rows of the pool are one; repeated targets are rows like others.
    """
    out = best(targets, pool, id_, cap, features, equal, differ, end).select("id", F.posexplode("best").alias("rank", "x"))
    return out.select("id", "x.candidate", "x.score", (F.col("rank") + 1).alias("rank"))


def best(targets: DataFrame, pool: DataFrame, id_: str, cap: int, features: dict[int, str], equal: list[str] = (), differ: list[str] = (), end: str = "least", kept: bool = False) -> DataFrame:
    """As ``ranked``, with a row for each target: id, best (an array of candidate and score in their order). ``kept``: what
    reads it more than once compares nothing twice."""
    known = lambda rows: _shaped(rows, id_, list(equal), list(differ), features).where(F.col("id").isNotNull())
    pool = settled(spread(known(pool), "id").distinct())
    common = _commonest(pool)
    hot = F.array(*map(F.lit, common)) if common else F.array().cast("array<string>")
    hashed = lambda w: F.transform(F.filter("rare", lambda v: F.startswith(v, F.lit(f"{w}:"))), lambda v: F.xxhash64(v))

    def signed(rows: DataFrame) -> DataFrame:
        """With the signature, as text too, and by weight the other features."""
        cut = rows.withColumn("sign", F.array_intersect(hot, "f")).withColumn("s", F.array_join("sign", "\n")).withColumn("rare", F.array_except("f", hot))
        return cut.withColumn("r", F.struct(*(hashed(w).alias(f"f{w}") for w in features)))

    pool = signed(pool)
    open_ = settled(signed(spread(known(targets), "id")).withColumn("row", F.monotonically_increasing_id()).withColumn("plain", F.size("rare") == 0).drop("rare"))
    counts = pool.groupBy("e").agg(F.count("*").alias("n"))
    few = counts.where(F.col("n") <= WHOLE).select("e", F.lit(True).alias("few"))
    last, sense = end == "most_last", -1 if end == "most" else 1
    parts, rest = [], open_.where("not plain")
    sides = [(open_.where("plain"), True)]
    if end == "least":
        sides.append((rest.join(few, "e", "left_anti"), False))
        rest = rest.join(few, "e", "left_semi")
    classes = None
    for side, plain in sides:
        if side.isEmpty():
            continue
        if classes is None:
            classes = settled(pool.groupBy("e", "s").agg(F.count("*").alias("n"), F.first("sign").alias("sign")))
        met = settled(_by_lists(side, pool, classes, cap, plain, features, len(differ), sense, last))
        parts.append(met.where("done").select("id", "best"))
        rest = rest.unionByName(open_.join(met.where("not done").select("row"), "row", "left_semi"))
    if not rest.isEmpty():
        compared = _by_blocks(rest, pool, counts, cap, features, sense, last)
        parts.append(settled(compared) if kept else compared)
    if not parts:
        parts.append(open_.select("id", F.array().cast(f"array<struct<o:int,id:{open_.schema['id'].dataType.simpleString()}>>").alias("best")).limit(0))
    told = F.transform("best", lambda x: F.struct(x["id"].alias("candidate"), (sense * x["o"]).alias("score")))
    return reduce(DataFrame.unionByName, parts).select("id", told.alias("best"))


def _by_lists(open_: DataFrame, pool: DataFrame, classes: DataFrame, cap: int, plain: bool, features: dict[int, str], differ: int, sense: int, last: bool) -> DataFrame:
    """(row, id, best, done): the best of the lists. With ``plain`` targets have no features outside their signatures, so a
    list is in their order; else their rows are scored, towards the least alike."""
    listed = cap + 1 if plain and not differ else max(LISTED, 4 * cap)  # a plain target leaves out itself at most
    lists = settled(_lists(open_, pool, classes, listed, sense, last, plain))
    asked = open_.select("row", "id", "e", "s", "d", *([] if plain else ["r"]))
    if lists.count() * listed <= CARRIED:
        met = asked.join(F.broadcast(lists), ["e", "s"], "left")
    else:
        copied = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        dealt = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
        met = spread(dealt, "e", "s", "part").join(copied, ["e", "s", "part"], "left")
    held = F.coalesce("held", F.array().cast(lists.schema["held"].dataType))
    fits = lambda x: reduce(lambda a, i: a & (F.get(x["d"], F.lit(i)) != F.get(F.col("d"), F.lit(i))), range(differ), x["id"] != F.col("id"))
    more = lambda x: F.lit(0) if plain else reduce(lambda a, w: a + F.lit(w) * F.size(F.array_intersect(x["r"][f"f{w}"], F.col("r")[f"f{w}"])), features, F.lit(0))
    scored = F.transform(F.filter(held, fits), lambda x: F.struct((x["o"] + more(x)).cast("int").alias("o"), x["id"].alias("id")))
    met = met.withColumn("best", F.slice(scored if plain else F.sort_array(scored), 1, cap))
    edge = F.struct(F.try_element_at("held", F.lit(-1))["o"].cast("int").alias("o"), F.try_element_at("held", F.lit(-1))["id"].alias("id"))
    beats = F.lit(True) if plain else F.coalesce(F.get("best", F.lit(cap - 1)) <= edge, F.lit(False))
    return met.select("row", "id", "best", (F.coalesce("whole", F.lit(True)) | ((F.size("best") >= cap) & beats)).alias("done"))


def _lists(open_: DataFrame, pool: DataFrame, classes: DataFrame, listed: int, sense: int, last: bool, plain: bool) -> DataFrame:
    """(e, s, held, whole): for every signature the first ``listed`` rows of the pool by what they share of it, and by id;
    whether that is all of them."""
    way = (lambda c: F.col(c).desc()) if last else (lambda c: F.col(c).asc())
    rows = pool.withColumn("_n", F.row_number().over(Window.partitionBy("e", "s").orderBy(way("id")))).where(F.col("_n") <= listed).select("e", F.col("s").alias("t"), "id", "d", *([] if plain else ["r"]))
    asked = open_.select("e", "s", "sign").distinct()
    sides = asked.join(classes.select("e", F.col("s").alias("t"), "n", F.col("sign").alias("theirs")), "e")
    sides = sides.withColumn("o", sense * _weight(F.array_intersect("sign", "theirs"))).withColumn("p", F.col("o") * (-1 if last else 1))
    by = Window.partitionBy("e", "s")
    before = F.coalesce(F.sum("n").over(by.orderBy("p").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = sides.withColumn("before", before).withColumn("all", F.sum("n").over(by)).where(F.col("before") < listed)
    entries = near.select("e", "s", "t", "o", "p", "all").join(rows, ["e", "t"])
    first = entries.withColumn("_r", F.row_number().over(by.orderBy("p", way("id")))).where(F.col("_r") <= listed)
    held = F.transform(F.array_sort(F.collect_list(F.struct("_r", F.struct("o", "id", "d", *([] if plain else ["r"])).alias("x")))), lambda y: y["x"])
    return first.groupBy("e", "s").agg(held.alias("held"), (F.first("all") <= listed).alias("whole"))


def _by_blocks(open_: DataFrame, pool: DataFrame, counts: DataFrame, cap: int, features: dict[int, str], sense: int, last: bool) -> DataFrame:
    """(id, best): each target's best of its whole pool. Targets and pool are cut into pieces, every piece of targets meets
    every piece of its pool, and small pools share a block."""
    sizes = settled(counts.join(open_.groupBy("e").agg(F.count("*").alias("m")), "e"))
    small = F.col("n") + F.col("m") <= BLOCK // 16
    shares = int(sizes.agg(F.sum(F.when(small, F.col("n") + F.col("m")))).first()[0] or 0) // BLOCK + 1
    cuts = settled(sizes.select(
        "e", F.when(small, F.concat(F.lit("#"), F.pmod(F.xxhash64("e"), F.lit(shares)).cast("string"))).otherwise(F.concat(F.lit("="), "e")).alias("lot"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("m") / TARGETS).cast("int").alias("asks"),
    ))
    blocks = int(cuts.groupBy("lot").agg(F.max(F.col("rows") * F.col("asks")).alias("x")).agg(F.sum("x")).first()[0] or 0)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    piece = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    plain = lambda w: F.transform(F.filter("f", lambda v: F.startswith(v, F.lit(f"{w}:"))), lambda v: F.xxhash64(v)).alias(f"f{w}")
    shown = ["e", "id", "d", *(plain(w) for w in features)]
    asking = open_.join(cuts, "e").select("lot", each("rows").alias("at"), piece("row", "asks").alias("of"), F.col("row"), *shown)
    there = pool.join(cuts, "e").select("lot", piece("id", "rows").alias("at"), each("asks").alias("of"), F.lit(None).cast("long").alias("row"), *shown)
    parallel = open_.sparkSession.sparkContext.defaultParallelism
    dealt = asking.unionByName(there).repartition(max(parallel, min(2 * blocks, 2000)), "lot", "at", "of")
    kind = open_.schema["id"].dataType
    found = dealt.groupBy("lot", "at", "of").applyInArrow(_compared(list(features), cap, sense, last), f"row long, target {kind.simpleString()}, o int, id {kind.simpleString()}")
    first = F.slice(F.sort_array(F.collect_list(F.struct("o", "id")), asc=not last), 1, cap)
    return found.groupBy("row").agg(F.first("target").alias("id"), first.alias("best")).select("id", "best")


def _compared(weights: list[int], cap: int, sense: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """A block's function: of every target (a row with a number) the best of the block's other rows."""
    weights, bits, most = sorted(weights, reverse=True), INDEXED, sense < 0 or last

    def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        array = column.combine_chunks()
        offsets = array.offsets.to_numpy()
        return np.repeat(np.arange(len(array)), np.diff(offsets)), array.values.to_numpy()[offsets[0] : offsets[-1]]

    def compared(block: pa.Table) -> pa.Table:
        number = block["row"].combine_chunks()
        asks = ~np.asarray(number.is_null().to_numpy(zero_copy_only=False))
        ids = block["id"].combine_chunks().dictionary_encode()
        rank = np.empty(len(ids.dictionary), np.int64)
        rank[pc.sort_indices(ids.dictionary).to_numpy()] = np.arange(len(rank))
        place = rank[ids.indices.to_numpy()] * (-1 if last else 1)  # candidates stand in the order that ties ask for
        same = block["e"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((place, asks, same))
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        place, asks, same = place[order], asks[order], same[order]
        which, others = lists(block["d"])
        differ = len(others) // max(1, len(order))
        others = others.reshape(len(order), differ)[order]
        held = []
        for w in weights:
            r, v = lists(block[f"f{w}"])
            r = at[r]
            by = np.argsort(r, kind="stable")
            held.append((r[by], v[by]))
        rows, candidates, scores = [], [], []
        ends = np.flatnonzero(np.diff(same, append=-1)) + 1
        for a, z in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
            middle = a + int(np.searchsorted(asks[a:z], True))
            for t, found, score in _group(a, middle, z, place, others, held, weights, cap, most, bits):
                rows.append(np.full(len(found), order[t]))
                candidates.append(order[found])
                scores.append(score)
        joined = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        t, c = joined(rows, np.int64), joined(candidates, np.int64)
        return pa.table({"row": number.take(t), "target": block["id"].take(t), "o": pa.array(joined(scores, np.int32) * sense, pa.int32()), "id": block["id"].take(c)})

    return compared


def _group(a: int, middle: int, z: int, place: np.ndarray, others: np.ndarray, held: list, weights: list[int], cap: int, most: bool, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every target in middle..z the positions in a..middle of its best rows, unordered, with their scores.

    Common features are bits of a word, the others have short lists of rows. Scores are small numbers, so the last one that
    counts is found by counting, and of the rows that have it the first ones are taken.
    """
    n, m = middle - a, z - middle
    if not n or not m:
        return
    parts, top = [], 1
    for (row, value), w in zip(held, weights, strict=True):
        i, j, k = np.searchsorted(row, (a, middle, z))
        names, code, count = np.unique(value[i:j], return_inverse=True, return_counts=True)
        bit = np.zeros(len(names), np.uint64)
        common = np.argsort(-count, kind="stable")[:64]
        common = common[count[common] * bits >= n]
        bit[common] = np.left_shift(np.uint64(1), np.arange(len(common), dtype=np.uint64))
        masks, asked = np.zeros(n, np.uint64), np.zeros(m, np.uint64)
        np.bitwise_or.at(masks, row[i:j] - a, bit[code])
        rare = bit[code] == 0
        by = np.argsort(code[rare], kind="stable")
        posted = (row[i:j][rare] - a)[by]
        starts = np.searchsorted(code[rare][by], np.arange(len(names) + 1))
        theirs, mine = value[j:k], row[j:k] - middle
        spot = np.searchsorted(names, theirs)
        known = np.flatnonzero(names[np.minimum(spot, len(names) - 1)] == theirs) if len(names) else np.empty(0, np.int64)
        spot, mine = spot[known], mine[known]
        np.bitwise_or.at(asked, mine, bit[spot])
        seldom = bit[spot] == 0
        parts.append((w, masks, asked, posted, starts, spot[seldom], np.searchsorted(mine[seldom], np.arange(m + 1))))
        top += w * int(np.bincount(row[j:k] - middle, minlength=1).max(initial=0))
    kind = np.uint8 if top < 255 else np.int32
    words, few, value, total, over = np.empty(n, np.uint64), np.empty(n, np.uint8), np.empty(n, kind), np.empty(n, kind), np.empty(n, bool)
    base, last = None, None
    barred = []
    for c in range(others.shape[1]):
        by = np.argsort(others[a:middle, c], kind="stable")
        barred.append((by, others[a:middle, c][by]))
    for t in np.argsort(parts[0][2], kind="stable"):
        total.fill(1)
        for p, (w, masks, asked, _, _, _, _) in enumerate(parts):
            if p == 0 and last is not None and asked[t] == last:
                total += base
                continue
            np.bitwise_and(masks, asked[t], out=words)
            np.bitwise_count(words, out=few)
            np.multiply(few, w, out=value, casting="unsafe")
            if p == 0:
                base, last = value.copy(), asked[t]
            total += value
        for w, _, _, posted, starts, spot, begins in parts:
            for f in spot[begins[t] : begins[t + 1]]:
                total[posted[starts[f] : starts[f + 1]]] += w
        if not most:
            np.subtract(top + 1, total, out=total, casting="unsafe")
        x, y = np.searchsorted(place[a:middle], (place[middle + t], place[middle + t] + 1))
        total[x:y] = 0
        for c, (by, values) in enumerate(barred):
            x, y = np.searchsorted(values, others[middle + t, c]), np.searchsorted(values, others[middle + t, c], side="right")
            total[by[x:y]] = 0
        low, high = 1, int(total.max())
        while low < high:
            half = (low + high + 1) // 2
            if np.count_nonzero(np.greater_equal(total, half, out=over)) >= cap:
                low = half
            else:
                high = half - 1
        if high == 0:
            continue
        above = np.flatnonzero(np.greater(total, low, out=over))
        found = np.concatenate((above, np.flatnonzero(np.equal(total, low, out=over))[: cap - len(above)]))
        score = total[found].astype(np.int32)
        yield middle + t, found + a, score - 1 if most else top - score
