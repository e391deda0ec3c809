"""Near-duplicate vectors by cosine, with product quantisation.

Equal vectors are one class, counted. Coarse centroids cut the classes into inverted lists; what a vector differs from
its centroid by is coded subspace by subspace. A partner lies no farther than the threshold allows, so it lies across the
plane between the two centroids only if the vector itself is near enough to that plane. How near, is measured: a bounded
number of query vectors is compared with all rows, and the largest distance to a plane that any of their links has, with
``SLACK``, says which lists a vector is looked up in. With fewer than ``LEAST_LINKS`` such links, or on small tables,
every list within the threshold's full reach is probed, which loses nothing. In a list, distances come from tables of
the query's products with the codebooks; what a code leaves out is bounded by the norm of its error, so that no pair over
the threshold is lost there, and pairs that remain are decided by exact double cosine.

Centroids and codebooks are fitted on a bounded sample (``SAMPLE`` vectors by hashed id, ``SAMPLE_BYTES``). Lists are cut
into tiles, and a list's visitors into lots where there are many, so that a dense list doesn't fill one task. A tile
returns how many partners each vector has there, and links enough to keep what is connected connected, not all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .scratch import Scratch

THRESHOLD, SAMPLE, MOST_LISTS, SAMPLE_BYTES = 0.95, 20_000, 4096, 32 << 20
SUBSPACES, CODES, ROUNDS = 8, 64, 8
#: Members of a tile; bytes of vectors in a lot of visitors; rows worked on at once.
TILE, LOT_BYTES, CHUNK = 1024, 16 << 20, 2048
#: Query vectors compared with all rows, by round, until they have so many links; how far beyond those links is probed.
QUERIES, QUERY_BYTES, LEAST_LINKS, SLACK = (2048, 8192, 32_768), 16 << 20, 1000, 1.25
#: Slack for rounding in the bounds; the exact comparison has none.
EPSILON = 1e-6


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    parts = [np.argmax(x[i : i + CHUNK] @ centres.T - half, 1) for i in range(0, len(x), CHUNK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


class Index:
    """Coarse centroids and the codebooks of their residuals."""

    def __init__(self, x: np.ndarray, lists: int):
        self.centres = _kmeans(x, min(lists, len(x)), 1)
        rest = x - self.centres[self.nearest(x)]
        self.cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        self.books = [_kmeans(rest[:, a:b], min(CODES, len(x)), 2) for a, b in zip(self.cuts, self.cuts[1:])]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centres)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the norm of what they leave out."""
        rest, codes, error = x - self.centres[own], [], np.zeros(len(x))
        for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books, strict=True):
            code = _nearest(rest[:, a:b], book)
            codes.append(code.astype(np.uint8))
            error += ((rest[:, a:b] - book[code]) ** 2).sum(1)
        return np.stack(codes, 1), np.sqrt(error)

    def reachable(self, x: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
        """Which lists can hold a vector within ``reach`` of each of these, measured along the line of the centroids."""
        centres, squares = self.centres, (self.centres**2).sum(1)
        square = np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ centres.T + squares)
        apart = np.sqrt(np.maximum(0, squares[own][:, None] - 2 * centres[own] @ centres.T + squares))
        return square - square[np.arange(len(x)), own][:, None] <= 2 * apart * reach + EPSILON

    def beyond(self, x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How far each vector is from the plane between its own centroid and that of another list."""
        a, b = self.centres[own], self.centres[other]
        return (((x - b) ** 2).sum(1) - ((x - a) ** 2).sum(1)) / np.maximum(2 * np.sqrt(((a - b) ** 2).sum(1)), 1e-12)

    def products(self, q: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Products of queries with coded vectors of one list, by table look-up."""
        out = np.repeat((q @ self.centres[centre])[:, None], len(codes), 1)
        for i, ((a, b), book) in enumerate(zip(zip(self.cuts, self.cuts[1:]), self.books, strict=True)):
            out += (q[:, a:b] @ book.T)[:, codes[:, i]]
        return out


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links suffice to connect what all of them connect."""
    root: dict[int, int] = {}
    keep = []

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            keep.append(i)
    return np.array(keep, np.int64)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300) if len(x) else x
    return x / np.sqrt((x**2).sum(1, keepdims=True)) if len(x) else x


def _matrix(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, d)


def probing(coded: DataFrame, index, d: int, n: int, threshold: float) -> float:
    """How far from a vector, along the line between two centroids, its partners are looked for.

    Query vectors by hashed id against all rows, in blocks: linear in the rows. What their links need, both ways, is
    what is found with such a reach; the expected share of links beyond the largest of so many is under one in
    ``LEAST_LINKS``, whatever directions the differences of near vectors take.
    """
    full = math.sqrt(max(0.0, 2 - 2 * threshold)) + EPSILON
    for queries in QUERIES:
        queries = min(queries, max(1, QUERY_BYTES // (8 * d)))
        if n <= queries:
            return full
        drawn = coded.orderBy(F.xxhash64("_row"), "_row").limit(queries).select("_row", "list", "vector").toArrow()
        asked = coded.sparkSession.sparkContext.broadcast((drawn.column("_row").to_numpy(), drawn.column("list").to_numpy(), _units(_matrix(drawn.column("vector"), d))))

        def compare(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            row, own, q = asked.value
            links, most = 0, 0.0
            for whole in batches:
                for at in range(0, whole.num_rows, CHUNK):
                    batch = whole.slice(at, CHUNK)
                    x, there, lists = _units(_matrix(batch.column("vector"), d)), batch.column("_row").to_numpy(), batch.column("list").to_numpy()
                    i, j = np.nonzero(x @ q.T >= threshold)
                    other = there[i] != row[j]
                    i, j = i[other], j[other]
                    links += len(i)
                    across = lists[i] != own[j]
                    i, j = i[across], j[across]
                    if len(i):
                        most = max(most, index.value.beyond(x[i], lists[i], own[j]).max(), index.value.beyond(q[j], own[j], lists[i]).max())
            yield pa.RecordBatch.from_arrays([pa.array([links]), pa.array([most])], names=["links", "most"])

        seen = coded.select("_row", "list", "vector").mapInArrow(compare, "links long, most double").agg(F.sum("links").alias("links"), F.max("most").alias("most")).first()
        if (seen.links or 0) >= LEAST_LINKS:
            return min(full, max(SLACK * seen.most, full / 10))
    return full


def link(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row vec_id, n_links and component_id (the smallest vec_id reachable, its own included).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do those of another
    dimension than the most common one. Each row is a vector of its own, equal ids or not; a null id can link, and is
    never the smallest. Equal vectors link with each other and are looked up once.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "pq")
    usable = "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    plain = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("_id", F.monotonically_increasing_id())
    same = F.when(F.expr(usable), F.struct(F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("g")))
    rows = scratch.save(plain.withColumn("same", same), "rows")
    sizes = rows.where("same is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    d = sizes[0].d
    good = rows.where((F.size("embedding") == d) & F.col("same").isNotNull())
    classes = scratch.save(good.groupBy("same").agg(F.min("_id").alias("_row"), F.count("*").alias("n"), F.min("vec_id").alias("least"), F.min_by("embedding", "_id").alias("embedding")), "classes")
    n = classes.count()
    drawn = classes.orderBy(F.xxhash64("_row"), "_row").limit(min(SAMPLE, max(256, SAMPLE_BYTES // (8 * d)))).select("embedding").toArrow()
    sample = drawn.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    index = spark.sparkContext.broadcast(Index(_units(sample), int(min(MOST_LISTS, max(4, math.sqrt(n))))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            own = index.value.nearest(_units(raw))
            codes, error = index.value.encode(_units(raw), own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("n"), pa.array(own.astype(np.int32)), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                names=["_row", "n", "list", "vector", "codes", "error"],
            )

    coded = scratch.save(classes.select("_row", "n", "embedding").mapInArrow(code, "_row long, n long, list int, vector binary, codes binary, error double"), "coded")
    reach = probing(coded, index, d, n, threshold)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members and visitors of each list."""
        both = np.zeros((2, len(index.value.centres)), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                own = batch.column("list").to_numpy()
                both[0] += np.bincount(own, minlength=both.shape[1])
                both[1] += index.value.reachable(_units(_matrix(batch.column("vector"), d)), own, reach).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(both.shape[1])), pa.array(both[0]), pa.array(both[1])], names=["list", "members", "visitors"])

    counts = coded.select("list", "vector").mapInArrow(visits, "list long, members long, visitors long").groupBy("list").agg(F.sum("members").alias("m"), F.sum("visitors").alias("v")).collect()  # a row for each of at most MOST_LISTS lists
    tiles, lots = np.zeros(len(index.value.centres), np.int64), np.ones(len(index.value.centres), np.int64)
    for c in counts:
        tiles[c["list"]] = -(-c["m"] // TILE)
        lots[c["list"]] = max(1, -(-c["v"] // max(TILE, LOT_BYTES // (8 * d))))
    begins = np.concatenate([[0], np.cumsum(tiles)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its own tile, for every lot of its list, and to the later tiles of lists that can hold a partner."""
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                row, own = batch.column("_row").to_numpy(), batch.column("list").to_numpy()
                x = _units(_matrix(batch.column("vector"), d))
                salt = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                tile = begins[own] + (salt % tiles[own].astype(np.uint64)).astype(np.int64)
                who, there = np.nonzero(index.value.reachable(x, own, reach))
                times = tiles[there]
                who, there = np.repeat(who, times), np.repeat(there, times)
                to = begins[there] + np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                later = to > tile[who]
                who, to, there = who[later], to[later], there[later]
                every = np.repeat(np.arange(len(row)), lots[own])
                ends = np.cumsum(lots[own])
                source, target = np.concatenate([every, who]), np.concatenate([tile[every], to])
                into = np.concatenate([np.arange(len(every)) - (ends - lots[own])[every], ((salt[who] >> np.uint64(7)) % lots[there].astype(np.uint64)).astype(np.int64)])
                home = np.arange(len(source)) < len(every)
                for lo in range(0, len(source), 8 * CHUNK):
                    part = slice(lo, lo + 8 * CHUNK)
                    taken = batch.take(pa.array(source[part]))
                    yield pa.RecordBatch.from_arrays([pa.array(target[part]), pa.array(into[part]), pa.array(home[part]), *taken.columns], names=["tile", "lot", "home", *taken.schema.names])

    def match(table):
        x = _matrix(table.column("vector"), d)
        home, row, weight = table.column("home").to_numpy(), table.column("_row").to_numpy(), table.column("n").to_numpy()
        order = np.lexsort((row, ~home))
        x, home, row, weight = x[order], home[order], row[order], weight[order]
        m = int(home.sum())
        if not m:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        unit, norm = _units(x), np.sqrt((x**2).sum(1))
        codes = np.stack([np.frombuffer(c, np.uint8) for c in table.column("codes").take(pa.array(order[:m])).to_pylist()])
        error = table.column("error").to_numpy()[order[:m]]
        centre = table.column("list")[int(order[0])].as_py()
        first = table.column("lot")[0].as_py() == 0
        left, right, n_links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(x), np.int64)
        for lo in range(0 if first else m, len(x), 512):  # the tile's own pairs belong to its first lot
            q = unit[lo : lo + 512]
            i, j = np.nonzero(index.value.products(q, centre, codes) + error >= threshold - EPSILON)
            i += lo
            once = (i >= m) | (j < i)
            i, j = i[once], j[once]
            exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[i[k : k + 8192]], x[j[k : k + 8192]]) for k in range(0, len(i), 8192))]) / (norm[i] * norm[j])
            i, j = i[exact >= threshold], j[exact >= threshold]
            np.add.at(n_links, i, weight[j])
            np.add.at(n_links, j, weight[i])
            kept = _forest(i, j)
            left.append(i[kept])
            right.append(j[kept])
        i, j = np.concatenate(left), np.concatenate(right)
        kept, some = _forest(i, j), np.flatnonzero(n_links)
        a = np.concatenate([row[some], row[i[kept]]])
        b = np.concatenate([np.full(len(some), -1), row[j[kept]]])
        return pa.table({"a": a, "b": b, "n": np.concatenate([n_links[some], np.zeros(len(kept), np.int64)])})

    sent = coded.mapInArrow(send, "tile long, lot long, home boolean, _row long, n long, list int, vector binary, codes binary, error double")
    found = scratch.save(sent.groupBy("tile", "lot").applyInArrow(match, "a long, b long, n long"), "found")
    links = found.where("b < 0").groupBy(F.col("a").alias("_row")).agg(F.sum("n").alias("links"))
    named = components(found.where("b >= 0").select("a", "b"), scratch)
    of = scratch.save(named.join(classes.select(F.col("_row").alias("node"), "least"), "node"), "named")
    least = of.groupBy("component").agg(F.min("least").alias("of_all"))
    whole = classes.select("same", "_row", "n", "least").join(links, "_row", "left").join(of.select(F.col("node").alias("_row"), "component"), "_row", "left").join(least, "component", "left")
    whole = whole.select("same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("of_all", "least").alias("component_id"))
    out = rows.select("vec_id", "same").join(whole, "same", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
