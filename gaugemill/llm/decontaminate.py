"""Benchmark items in documents: SimHash windows of an item's size, Hamming blocks, exact check. DataFrame operations only.

1. Items are sorted by size (shingles). Only windows that hold, of any items of that size, as many shingles as the
   similarity asks for, and begin at one of them, can be best ones; the others aren't printed. This loses nothing and
   tells of no item: each position's shingle is looked up once, without an item.
2. Each such window, and each item, gets a SimHash of 64 bits over its shingles, counted with their multiplicity.
3. Fingerprints within ``RADIUS`` differ in at most ``RADIUS // BLOCKS`` bits in one of their blocks: items are indexed
   under all such values of every block, windows are looked up by size, block and value, and Hamming distances decide
   which items a document may hold. A window at the threshold is 11 bits from its item on average (deviation 3), so that
   a radius of 19 misses three pairs in a thousand there and next to none of higher similarity.
4. Of these documents and items all windows are confirmed by multiset Jaccard similarity of the shingles.

The items' shingles (eight bytes and a size each) are broadcast up to ``MOST_BROADCAST`` of them, which is counted first;
beyond, the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

SHINGLE, NEED = 5, (75, 100)
BLOCKS, RADIUS = 4, 19
MOST_BROADCAST = 1_000_000
WORDS = r"filter(split(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once a row: the optimizer doesn't copy an expression across a generator, as it
    would copy one that is used in several places, down into lambdas and pushed filters."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _shingled(df: DataFrame, size: int) -> DataFrame:
    """Adds ``hashes``, the hashes of the runs of ``size`` of ``words``, in order."""
    parts = ", ".join(f"words[i + {k}]" for k in range(size))
    return _once(df, "hashes", F.expr(f"case when size(words) >= {size} then transform(sequence(0, size(words) - {size}), i -> xxhash64({parts})) else cast(array() as array<bigint>) end"))


def _printed(rows: DataFrame, *by: str) -> DataFrame:
    """size and SimHash (``print``) of each group's shingle hashes ``h``, counted ``n`` times; a sum counts two bits."""
    one = lambda b: F.shiftright("h", b).bitwiseAND(F.lit(1).cast("long"))
    sums = [F.sum(F.col("n") * (one(b) + F.shiftleft(one(b + 1), 32))).alias(f"_s{b}") for b in range(0, 64, 2)]
    most = "transform(array({}), (s, i) -> shiftleft(cast(2 * (s & 4294967295L) > size as bigint), 2 * i) | shiftleft(cast(2 * shiftrightunsigned(s, 32) > size as bigint), 2 * i + 1))"
    bits = most.format(", ".join(f"_s{b}" for b in range(0, 64, 2)))
    return rows.groupBy(*by).agg(F.sum("n").alias("size"), *sums).select(*by, "size", F.expr(f"aggregate({bits}, 0L, (x, y) -> x | y)").alias("print"))


def _blocks(df: DataFrame, near: bool) -> DataFrame:
    """A row for each block of ``print``; with ``near``, for each value of it within the bits that one block may differ."""
    width = 64 // BLOCKS
    values = F.array(*(F.shiftrightunsigned("print", width * j).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for j in range(BLOCKS)))
    out = df.select("*", F.posexplode(values).alias("block", "value"))
    if near:
        masks = F.expr(f"filter(sequence(0L, {(1 << width) - 1}L), x -> bit_count(x) <= {RADIUS // BLOCKS})")
        out = out.withColumn("mask", F.explode(masks)).withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
    return out


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, similarity, start): documents that hold a benchmark item, each with its best window.

    Similarity is that of the multisets of five-word shingles of the item and of a run of as many words of the document,
    0.75 or more; of equally good windows that begin with a shared shingle, or end with the document, the first ``start``
    (in words) is given. Items of under five words are one shingle and
    must come exactly. A document that is shorter than an item is compared whole. Null and empty texts neither leak nor
    are leaked. Items that share an id are one row each, merged in the result; ``key`` tells rows with one id but
    different texts apart, and equal rows are found once. Texts of any length are read whole; a shingle that is repeated
    in an item or a window counts as often as both have it. Other columns of either table aren't read.
    """
    scratch = Scratch(documents.sparkSession, "leaks")
    words = _once(benchmark.select("item_id", "text"), "words", F.expr(WORDS)).select("item_id", "words").where("size(words) > 0")
    words = words.withColumn("k", F.least(F.lit(SHINGLE), F.size("words"))).withColumn("item", F.xxhash64("item_id", F.array_join("words", " ")))
    sizes = sorted(r.k for r in words.select("k").distinct().collect())  # five values at most
    found = None
    for k in sizes:
        one = _leaks(documents, words.where(F.col("k") == k), k, scratch)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = documents.join(words, F.lit(False)).select("doc_id", F.lit(0).cast("long").alias("key"), "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("start"))
    best = F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start")))
    return found.groupBy("doc_id", "key", "item_id").agg(best.alias("b")).select("doc_id", "key", "item_id", "b.similarity", "b.start")


def key() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _leaks(documents: DataFrame, words: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    items = scratch.save(_shingled(words, k).select("item_id", "item", "hashes", F.size("hashes").alias("m")).dropDuplicates(["item"]), f"items{k}")
    counted = scratch.save(items.select("item_id", "item", "m", F.explode("hashes").alias("h")).groupBy("item_id", "item", "m", "h").agg(F.count("*").alias("n")), f"shingles{k}")
    # the least shared shingles of windows with m and with at most m shingles: J >= need, J = s / (m + m' - s), m' >= s
    need = F.ceil(F.col("m") * NEED[0] / F.lit(float(NEED[1] + NEED[0])) * 2 - 1e-9)
    short = F.ceil(F.col("m") * NEED[0] / F.lit(float(NEED[1])) - 1e-9)
    asked = scratch.save(counted.select("h", "m").distinct(), f"asked{k}")
    asked = F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked
    read = _shingled(_once(documents.select("doc_id", key().alias("key"), "text"), "words", F.expr(WORDS)).select("doc_id", "key", "words"), k).select("doc_id", "key", "hashes")
    hits = (
        read.select("doc_id", "key", F.size("hashes").alias("len"), F.posexplode("hashes").alias("pos", "h"))
        .join(asked, "h")
        .groupBy("doc_id", "key", "len", "m")
        .agg(F.sort_array(F.collect_set("pos")).alias("at"))
    )
    # saved before the filter: with the filter's conditions on its own expressions, planning takes minutes
    hits = scratch.save(hits.where(F.size("at") >= F.least(need, short)), f"hits{k}").withColumn("need", F.when(F.col("len") < F.col("m"), short).otherwise(need).cast("int"))
    hits = hits.where(F.size("at") >= F.col("need"))
    begins = F.expr("transform(filter(sequence(0, size(at) - need), i -> at[i + need - 1] - at[i] < m), i -> greatest(0, least(at[i], len - m)))")
    starts = scratch.save(hits.select("doc_id", "key", "m", F.explode(F.array_distinct(begins)).alias("start")).distinct(), f"starts{k}")
    # the texts are shuffled at every size: what has leaked grows with them
    slots = starts.groupBy("doc_id", "key").agg(F.collect_set(F.struct("m", "start")).alias("slots")).hint("merge")
    same = (F.col("d.key") == F.col("s.key")) & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))
    texts = documents.select("doc_id", key().alias("key"), "text").alias("d").join(slots.alias("s"), same).select("d.doc_id", "d.key", "d.text", "s.slots").dropDuplicates(["doc_id", "key"])
    cut = _shingled(_once(texts, "words", F.expr(WORDS)), k).select("doc_id", "key", F.size("hashes").alias("len"), "hashes", F.explode("slots").alias("s"))
    windows = cut.select("doc_id", "key", "len", "s.m", "s.start", F.explode(F.expr("slice(hashes, s.start + 1, s.m)")).alias("h"))
    shared = scratch.save(windows.groupBy("doc_id", "key", "len", "m", "start", "h").agg(F.count("*").alias("n")), f"windows{k}")

    printed = scratch.save(_printed(counted, "item_id", "item", "m"), f"item_prints{k}")
    of_items = _blocks(printed, True).select("item_id", "item", "m", "block", "value", F.col("print").alias("item_print")).hint("merge")
    of_windows = _blocks(scratch.save(_printed(shared, "doc_id", "key", "m", "start"), f"window_prints{k}"), False)
    pairs = of_windows.join(of_items, ["m", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    pairs = scratch.save(pairs.select("doc_id", "key", "m", "item_id", "item").distinct(), f"pairs{k}")

    w = shared.withColumnRenamed("n", "n_window").alias("w")
    both = pairs.join(w, (F.col("w.key") == pairs["key"]) & (F.col("w.m") == pairs["m"]) & F.col("w.doc_id").eqNullSafe(pairs["doc_id"]))
    both = both.select(pairs["doc_id"], pairs["key"], pairs["m"], "w.start", F.least("w.m", "w.len").alias("size"), "item_id", "item", "w.h", "n_window")
    met = both.join(counted.select("item", "h", F.col("n").alias("n_item")), ["item", "h"])
    checked = met.groupBy("doc_id", "key", "m", "start", "size", "item_id", "item").agg(F.sum(F.least("n_window", "n_item")).alias("shared"))
    union = F.col("size") + F.col("m") - F.col("shared")
    return checked.where(NEED[1] * F.col("shared") >= NEED[0] * union).select("doc_id", "key", "item_id", (F.col("shared") / union).alias("similarity"), "start")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a benchmark item; columns as they are."""
    found = leaks(documents, benchmark).select("key", F.col("doc_id").alias("id")).distinct().hint("merge")
    marked = documents.select(F.struct("*").alias("row"), key().alias("key"), F.col("doc_id").alias("id"))
    return marked.join(found, (marked["key"] == found["key"]) & marked["id"].eqNullSafe(found["id"]), "left_anti").select("row.*")
