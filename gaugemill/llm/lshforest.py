"""Near duplicates by word shingles, found with an LSH forest.

Every distinct shingle set gets a MinHash signature. A tree of the forest is one order of the signature's positions;
sets are sorted by it, and the neighbours with the longest common prefix, at least ``LEAST_DEPTH`` values, are
candidates. Where many sets share a prefix, the order itself goes deeper, by eight values in all. Candidates are
confirmed on the full shingle sets: first the best of each set, then, after the confirmed links are contracted, all that
would still join two components. A window of neighbours can't hold all pairs of a region with more sets than it; in such
regions all sets of different components are then compared in full, tile by tile, and only links are returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .scratch import Scratch
from .textops import blocks, mix, set_of, windows

SHINGLE, NEED = 5, (75, 100)
#: Positions of a signature; trees, each starting two positions after the one before; values that a candidate shares.
POSITIONS, TREES, LEAST_DEPTH = 64, 32, 3
#: Neighbours looked at on either side, best ones confirmed in the first round, and agreeing sketch bits of 64 below
#: which no pair of the wanted similarity is expected (4.6 standard deviations at 0.75).
NEIGHBOURS, BEST, LEAST_AGREEING = 4, 3, 44
#: Members of a group of regions that make a component large, so that it gets tiles of its own; members in a tile.
LARGE, TILE = 512, 512
#: Part of rows that are compared with rows of the same part.
WHOLE = -1
_FACTORS = np.random.Generator(np.random.PCG64(77)).integers(0, 2**64, POSITIONS, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each position's hash, hashed again to 64 even bits."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, np.multiply.outer(_FACTORS, shingles[i : i + 4096]).min(1))
    return mix(low)


def sets(documents: DataFrame) -> DataFrame:
    """doc_id, set size, digest of the set, 64 values of 16 bits, and a sketch of one bit for each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, values, sketch = [], [], [], []
            for w in blocks(batch.column("text")):
                h = w.hashes()
                s = windows(h, SHINGLE)
                for row in range(w.hi - w.lo):
                    own = set_of(w, h, s, row, SHINGLE)
                    sig = signature(own)
                    size.append(len(own))
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    values.append((sig >> np.uint64(48)).astype(np.uint16).tobytes())
                    sketch.append(int(np.packbits((sig & np.uint64(1)).astype(np.uint8)).view(">i8")[0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(values, pa.binary()), pa.array(sketch, pa.int64())],
                names=["doc_id", "n_shingles", "digest", "signature", "sketch"],
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary, sketch long")


def _forest(kept: DataFrame) -> DataFrame:
    """Each set in every tree: tree and first values in one order key, deeper values in a second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sig = np.array([np.frombuffer(x.as_py(), np.uint16) for x in batch.column("signature")], np.uint64).reshape(n, POSITIONS)
            ids, sketch = batch.column("doc_id").to_numpy(), batch.column("sketch").to_numpy()
            for tree in range(TREES):
                v = sig[:, (2 * tree + np.arange(8)) % POSITIONS]
                high = (np.uint64(tree) << np.uint64(59)) | (v[:, 0] << np.uint64(43)) | (v[:, 1] << np.uint64(27)) | (v[:, 2] << np.uint64(11)) | (v[:, 3] >> np.uint64(5))
                deep = (v[:, 4] << np.uint64(48)) | (v[:, 5] << np.uint64(32)) | (v[:, 6] << np.uint64(16)) | v[:, 7]
                yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(deep.view(np.int64)), pa.array(ids), pa.array(sketch)], names=["high", "deep", "doc_id", "sketch"])

    return kept.select("doc_id", "signature", "sketch").mapInArrow(run, "high long, deep long, doc_id long, sketch long")


def _neighbours(ordered: DataFrame) -> DataFrame:
    """Pairs (a, b) of near rows of an order that share a prefix and whose sketches don't speak against the similarity;
    and, with a null b, the first and last rows of each partition, which may have neighbours in the next one."""
    prefix = np.uint64(11)
    kinds = {"a": pa.int64(), "b": pa.int64(), "high": pa.int64(), "deep": pa.int64(), "sketch": pa.int64(), "part": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("high", "doc_id", "sketch", "deep", "part")]
            table = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            old = 0 if held is None else len(held[0])
            yield from pairs(table, old)
            if held is None:
                yield edge([x[:NEIGHBOURS] for x in table])
            held = [x[-NEIGHBOURS:] for x in table]
        if held is not None:
            yield edge(held)

    def edge(rows) -> pa.RecordBatch:
        high, ids, sketch, deep, part = rows
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(high), pa.array(deep), pa.array(sketch), pa.array(part)], names=list(kinds))

    def pairs(table, old: int) -> Iterator[pa.RecordBatch]:
        key, ids, sketch, part = table[0].view(np.uint64) >> prefix, table[1], table[2].view(np.uint64), table[4]
        for k in range(1, min(NEIGHBOURS, len(key) - 1) + 1):
            right = np.arange(max(k, old), len(key))
            right = right[(key[right] == key[right - k]) & ((part[right] != part[right - k]) | (part[right] == WHOLE))]
            right = right[64 - np.bitwise_count(sketch[right] ^ sketch[right - k]).astype(int) >= LEAST_AGREEING]
            both = np.stack([ids[right], ids[right - k]])
            none = pa.nulls(len(right), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(both.min(0)), pa.array(both.max(0)), none, none, none, pa.nulls(len(right), pa.int32())], names=list(kinds))

    return ordered.select("high", "deep", "doc_id", "sketch", "part").mapInArrow(run, "a long, b long, high long, deep long, sketch long, part int")


def _dense_links(classes: DataFrame, named: DataFrame, documents: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between components, of all sets in regions with more sets than the window of neighbours.

    Regions that share a set are one group. A group's sets are dealt into tiles, a large component's into tiles of its
    own, and all tiles meet but those of one large component; two tiles return links enough to join what their links
    join. So each pair of the group's sets in two components is compared in full, wherever it is in an order.
    """
    forest = _forest(classes).select("doc_id", F.shiftright("high", 11).alias("prefix"))
    placed = forest.join(named.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    regions = placed.groupBy("prefix").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.min("component").alias("c"), F.max("component").alias("d"))
    dense = regions.where((F.col("n") > NEIGHBOURS + 1) & (F.col("c") != F.col("d"))).select("prefix", "least")
    stars = scratch.save(placed.join(dense, "prefix").select("doc_id", "component", "least").distinct(), "dense")
    if stars.isEmpty():
        return stars.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    groups = components(stars.select(F.col("doc_id").alias("a"), F.col("least").alias("b")), scratch, "dense_stars")
    members = scratch.save(stars.select("doc_id", "component").distinct().join(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("grp")), "doc_id"), "members")
    sizes = members.groupBy("grp", "component").agg(F.count("*").alias("n"))
    own = F.col("n") >= LARGE
    blocks_ = sizes.select("grp", "component", "n", own.alias("own"), F.when(own, F.col("component")).otherwise(F.col("grp")).alias("block"))
    counts = blocks_.groupBy("grp", "own", "block").agg(F.ceil(F.sum("n") / F.lit(TILE)).cast("int").alias("tiles"))
    dealt = members.join(blocks_.drop("n"), ["grp", "component"]).join(counts, ["grp", "own", "block"])
    at = F.struct("own", "block", F.pmod(F.xxhash64("doc_id"), "tiles").cast("int").alias("tile"))
    dealt = scratch.save(dealt.select("doc_id", "component", "grp", at.alias("at")), "dealt")
    tiles = dealt.select("grp", "at").distinct()
    met = tiles.withColumnRenamed("at", "x").join(tiles.withColumnRenamed("at", "y"), "grp").where("x <= y and not (x.own and y.own and x.block = y.block)")
    cell = F.struct("x", "y").alias("cell")
    sides = met.select("grp", F.col("x").alias("at"), cell, F.lit(True).alias("home")).unionByName(met.where("x <> y").select("grp", F.col("y").alias("at"), cell, F.lit(False).alias("home")))
    places = dealt.join(sides, ["grp", "at"]).drop("at")

    def own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owned = []
            for w in blocks(batch.column("text")):
                h = w.hashes()
                s = windows(h, SHINGLE)
                owned += [set_of(w, h, s, row, SHINGLE).tobytes() for row in range(w.hi - w.lo)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(owned, pa.binary())], names=["doc_id", "own"])

    texts = documents.select(F.col("doc_id").cast("long"), "text").join(members.select("doc_id").hint("merge"), "doc_id", "left_semi")
    sent = places.join(texts.mapInArrow(own_sets, "doc_id long, own binary"), "doc_id")

    def match(table):
        home, ids, part = table.column("home").to_numpy(), table.column("doc_id").to_numpy(), table.column("component").to_numpy()
        owned = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("own")]
        inside = np.flatnonzero(home)
        alone = len(inside) == len(ids)
        size = np.array([len(owned[i]) for i in inside], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *(owned[i] for i in inside)])
        owner = np.repeat(np.arange(len(inside)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        values, first = np.unique(flat, return_index=True)
        ends = np.append(first, len(flat))
        _, root = np.unique(part, return_inverse=True)
        a, b = [], []
        for i in inside if alone else np.flatnonzero(~home):
            place = np.minimum(np.searchsorted(values, owned[i]), max(0, len(values) - 1))
            place = place[values[place] == owned[i]] if len(values) else place[:0]
            lo, n = ends[place], ends[place + 1] - ends[place]
            index = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            shared = np.bincount(owner[index], minlength=len(inside))
            found = np.flatnonzero((NEED[1] * shared >= NEED[0] * (size + len(owned[i]) - shared)) & (shared > 0))
            for j in inside[found]:
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    a.append(ids[i])
                    b.append(ids[j])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return sent.groupBy("grp", "cell").applyInArrow(match, "a long, b long")


def confirmed(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Both sides read one shuffle of the texts by id; what follows a pair to its second document is one packed set.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    asked = pairs.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("others"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, ids = batch.column("others"), batch.column("id")
            for w in blocks(batch.column("text")):
                h = w.hashes()
                s = windows(h, SHINGLE)
                owned = [set_of(w, h, s, row, SHINGLE).tobytes() for row in range(w.hi - w.lo)]
                rows = [(b, ids[w.lo + i].as_py(), own) for i, own in enumerate(owned) for b in others[w.lo + i].as_py()]
                b, a, own = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(a, pa.int64()), pa.array(own, pa.binary())], names=["id", "a", "own"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch.column("a"), batch.column("id"), []
            last, mine = None, np.zeros(0, np.uint64)
            texts_, owns = batch.column("text"), batch.column("own")
            for i in range(batch.num_rows):
                if b[i].as_py() != last or texts_[i] != texts_[i - 1]:
                    last = b[i].as_py()
                    w = next(blocks(texts_.slice(i, 1)))
                    h = w.hashes()
                    mine = set_of(w, h, windows(h, SHINGLE), 0, SHINGLE)
                other = np.frombuffer(owns[i].as_py(), np.uint64)
                small, large = sorted((mine, other), key=len)
                if NEED[1] * len(small) < NEED[0] * len(large) or not len(small):
                    continue
                shared = int(np.sum(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small))
                if NEED[1] * shared >= NEED[0] * (len(small) + len(large) - shared):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], names=["a", "b"])

    sent = asked.join(texts, "id").select("id", "text", "others").mapInArrow(first, "id long, a long, own binary")
    return sent.join(texts, "id").select("id", "a", "own", "text").mapInArrow(second, "a long, b long")


def candidates(kept: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, trees) of sets that are neighbours in some tree, and in how many."""
    tasks = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["high", "deep", "doc_id"]
    ordered = _forest(kept).withColumn("part", F.lit(WHOLE)).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    found = _neighbours(ordered).withColumn("part", F.when(F.col("b").isNull(), F.spark_partition_id()))
    found = scratch.save(found, "neighbours")
    # at most 2 * NEIGHBOURS rows of each partition are looked at once more, in one order
    edges = found.where("b is null").select("high", "deep", F.col("a").alias("doc_id"), "sketch", "part").distinct().repartition(1).sortWithinPartitions(*order)
    across = _neighbours(edges).where("b is not null")
    pairs = found.where("b is not null").select("a", "b").unionByName(across.select("a", "b"))
    return scratch.save(pairs.groupBy("a", "b").agg(F.count("*").alias("trees")), "candidates")


def group(documents: DataFrame) -> DataFrame:
    """Per row doc_id, n_shingles and component_id, the smallest id reachable by links; links join documents whose sets
    have 100 * intersection >= 75 * union.

    Null and empty texts have no shingles and are alone; texts of under five words are one shingle. Equal sets are one
    candidate under their smallest id, so copies cost nothing more; rows that share an id are one document; a row
    without an id keeps a null component unless its set equals another's. Texts are read whole, however long. Ids are
    whole numbers; others are an error. Shingles are compared by 64-bit hashes: two different ones of a pair of documents
    meet once in some 10^13 pairs of a thousand words, and one such meeting moves a similarity by a thousandth.
    """
    scratch = Scratch(documents.sparkSession, "forest")
    every = scratch.save(sets(documents), "sets")
    classes = scratch.save(
        every.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "signature", "sketch")).alias("s")).select("digest", "s.*"), "classes"
    )
    pairs = candidates(classes, scratch).where("a < b")
    sides = pairs.select("a", "b", "trees", F.col("a").alias("x")).unionByName(pairs.select("a", "b", "trees", F.col("b").alias("x")))
    ranked = sides.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("trees", "a", "b")), asc=False), 1, BEST).alias("best"))
    best = ranked.select(F.explode("best").alias("p")).select("p.a", "p.b").distinct()
    links = scratch.save(confirmed(best, documents), "links")
    named = scratch.save(components(links, scratch), "named")
    left = scratch.save(_apart(pairs.join(best, ["a", "b"], "left_anti"), named), "left")
    more = _dense_links(classes, named, documents, scratch)
    more = scratch.save(more if left.isEmpty() else more.unionByName(confirmed(left, documents)), "more_links")
    if not more.isEmpty():
        named = scratch.save(_merged(named, more, scratch), "all_named")
    found = classes.select("digest", F.col("doc_id").alias("node")).join(named, "node", "left").select("digest", F.coalesce("component", "node").alias("of_set"))
    out = every.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("of_set", "doc_id").alias("component_id"))


def _apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs that aren't in one component yet."""
    name = lambda side: named.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    both = pairs.join(name("a"), "a", "left").join(name("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _merged(named: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components after further links; only the components that these join are gone through again."""
    ends = [links.select(F.col(c).alias("node"), F.col(c).alias("component")) for c in ("a", "b")]
    every = scratch.save(named.unionByName(ends[0]).unionByName(ends[1]).groupBy("node").agg(F.min("component").alias("component")), "every_named")
    name = lambda side: every.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    joins = links.join(name("a"), "a").join(name("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = components(joins, scratch, "more").select(F.col("node").alias("component"), F.col("component").alias("root"))
    return every.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
