"""Perplexity from a hierarchical Pitman-Yor language model.

Two levels of Chinese restaurants: the words after a context sit in that context's restaurant, and every table there
sends one customer to the parent that all contexts share; the parent falls back to even chances over the training
words and one unknown. A context is the preceding token; its restaurant is named by ``2 ** context_bits`` hashed classes,
a number that grows with the text up to ``MOST_BITS`` bits, so that what has to be known everywhere (customers and tables
of each restaurant) is bounded by 2 ** 20 numbers; words aren't bounded and stay in the bucket of their hash.

A Gibbs step takes all customers of one (context, word) out and seats them anew given all other tables and the parent:
the number of their tables t has a chance in proportion to S(c, t) (b + d T) (b + d (T + 1)) ... P ** t, with the
generalised Stirling numbers S of c customers, T other tables and the parent's probability P. For up to ``EXACT``
customers it is drawn from these chances; for more, by Metropolis steps whose S comes from its saddle point. Within a
sweep, other buckets' tables are those of the sweep before. Every sweep is a saved table, and predictive probabilities
are averaged over the last ones.

Counts are combined in each block of texts before they are shuffled, so a frequent word costs a block one entry for
each context, not one for each occurrence; a bucket's blocks are merged in lots, and looked up in lots.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch
from .textops import blocks, mix
from .toxicity import held_out

LEAST_BITS, MOST_BITS, CLASS_BYTES = 16, 20, 256
SWEEPS, BURN_IN, STRENGTH = 4, 1, 1.0
#: Customers of a (context, word) up to which tables are drawn from exact chances; Metropolis steps beyond.
EXACT, STEPS = 256, 4
#: Bytes of text whose counts are merged together first, and tokens of a bucket that are looked up together.
LOT_BYTES, LOT_TOKENS, FAN_IN = 2 << 30, 8_000_000, 64
BLOCK_BYTES, SLICES = 3 << 20, 16
#: Buckets: one for about so many bytes of text, so many at least.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 64
_SHIFT, _LOW = np.uint64(MOST_BITS), np.uint64((1 << MOST_BITS) - 1)
_START, _END = np.uint64(0x1234567), np.uint64(0x89ABCDEF)
MODEL = "bucket int, words binary, pairs binary, ctx binary, n binary, tables binary, seated binary, roots binary, slices array<binary>, sums array<double>"
_FIELDS = [("bucket", pa.int32()), *((k, pa.binary()) for k in ("words", "pairs", "ctx", "n", "tables", "seated", "roots")), ("slices", pa.list_(pa.binary())), ("sums", pa.list_(pa.float64()))]


def _pack(x: np.ndarray) -> bytes:
    """Values byte plane by byte plane, compressed at once: most are small, and a bucket's row has megabytes of them."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="lz4_raw", asbytes=True)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(x[:8], "little")
    planes = pa.decompress(x[8:], size, codec="lz4_raw", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _chunks(batch: pa.RecordBatch, context_bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows lo to hi of about BLOCK_BYTES, with word hashes, context classes and rows of all their tokens, ends included."""
    lo, held, size = 0, [], 0

    def made():
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    for w in blocks(batch.column("text")):
        if held and size + len(w.data) > BLOCK_BYTES:
            yield lo, w.lo, *made()
            lo, held, size = w.lo, [], 0
        h = np.insert(w.hashes(), w.first[1:], _END)
        first = w.first[:-1] + np.arange(w.hi - w.lo)
        before = np.roll(h, 1)
        before[first] = _START
        rows = np.repeat(np.arange(w.lo, w.hi) - lo, np.diff(w.first) + 1)
        held.append((h, (mix(before) >> np.uint64(64 - context_bits)).astype(np.uint32), rows.astype(np.int64)))
        size += len(w.data)
    if held:
        yield lo, batch.num_rows, *made()


def _pairs(h: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words in order, and of each token the word's index with the context in the low MOST_BITS bits."""
    words, index = np.unique(h, return_inverse=True)
    return words, (index.astype(np.uint64) << _SHIFT) | ctx


def _counted(batch: pa.RecordBatch, bits: int, context_bits: int) -> Iterator[list[dict]]:
    """For each block of rows and each bucket, words in order, contexts of each, and how often each pair came."""
    learnt = batch.column("learnt").to_numpy(zero_copy_only=False)
    for lo, _, h, ctx, rows in _chunks(batch, context_bits):
        keep = learnt[lo + rows]
        words, code = _pairs(h[keep], ctx[keep])
        code, n = np.unique(code, return_counts=True)
        out = []
        for b, a, z, x, y in _ranges(words, code, bits):
            pairs = np.bincount((code[x:y] >> _SHIFT).astype(np.int64) - a, minlength=z - a)
            out.append({"bucket": b, "words": words[a:z].tobytes(), "pairs": _pack(pairs.astype(np.uint32)), "ctx": _pack((code[x:y] & _LOW).astype(np.uint32)), "n": _pack(n[x:y].astype(np.uint32))})
        yield out


def _ranges(words: np.ndarray, code: np.ndarray, bits: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Bucket, its range of words, its range of pairs; a word's bucket is its highest bits."""
    cut = np.searchsorted(words >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
    at = np.searchsorted(code, cut.astype(np.uint64) << _SHIFT)
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), int(cut[b]), int(cut[b + 1]), int(at[b]), int(at[b + 1])


def _sums_by_slice(ctx: np.ndarray, weight: np.ndarray, contexts: int) -> list[bytes]:
    return [_pack(x) for x in np.bincount(ctx, weight, contexts).astype(np.uint64).reshape(SLICES, -1)]


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, (word, context) codes and counts of a bucket, of all blocks together."""
    lists = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("words")]
    words = np.unique(np.concatenate(lists))
    codes = []
    for own, pairs, ctx in zip(lists, table.column("pairs"), table.column("ctx"), strict=True):
        index = np.repeat(np.searchsorted(words, own).astype(np.uint64), _unpack(pairs.as_py(), "u4"))
        codes.append((index << _SHIFT) | _unpack(ctx.as_py(), "u4"))
    return words, np.concatenate(codes), np.concatenate([_unpack(x.as_py(), "u4") for x in table.column("n")])


@functools.lru_cache(4)
def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: how c customers can sit at t tables, each table of n weighing
    (1 - d) (2 - d) ... (n - 1 - d)."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, most + 2)
    with np.errstate(divide="ignore"):
        for c in range(most):
            stay = np.log(np.maximum(c - d * t, 0))
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay + out[c, 1:])
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros(len(x))
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the Stirling number at its saddle point, and its slope in t; for many customers and tables.

    S(c, t) is c! / t! times the coefficient of x ** c in f(x) ** t, with f(x) = (1 - (1 - x) ** d) / d.
    """
    want = np.maximum(c / t, 1 + 1e-9)
    low, high = np.full(len(c), -690.0), np.zeros(len(c))  # the logarithm of 1 - x
    for _ in range(60):
        mid = (low + high) / 2
        steep = -np.expm1(mid) * d * np.exp((d - 1) * mid) / np.maximum(-np.expm1(d * mid), 1e-300) > want
        low, high = np.where(steep, mid, low), np.where(steep, high, mid)
    mid = (low + high) / 2
    y, x = np.exp(mid), -np.expm1(mid)
    f, g = -np.expm1(d * mid) / d, want
    spread = x * g * (1 / x + (1 - d) / y - np.exp((d - 1) * mid) / f)
    value = _log_gamma(c + 1) - _log_gamma(t + 1) + t * np.log(f) - c * np.log(x) - 0.5 * np.log(2 * math.pi * t * np.maximum(spread, 1e-12))
    return value, np.log(f) - np.log(t)


@functools.lru_cache(4)
def _missing(d: float) -> np.ndarray:
    """What the saddle point lacks, measured where the numbers are known; it follows t / c ** d."""
    t = np.arange(1.0, EXACT // 2 + 1)
    return stirling(d)[EXACT, 1 : len(t) + 1] - _saddle(np.full(len(t), float(EXACT)), t, d)[0]


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """For more than ``EXACT`` customers; for very few tables, the limit for many customers."""
    missing, like = _missing(d), t * (EXACT / c) ** d
    few = _log_gamma(c) - math.lgamma(1 - d) - d * np.log(c) - _log_gamma(t) - (t - 1) * math.log(d)
    return np.where(like < 1, few, _saddle(c, t, d)[0] + np.interp(like, np.arange(1, len(missing) + 1), missing))


def seat(customers: np.ndarray, tables: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after one Gibbs step of each dish: all its customers are taken out and seated anew.

    ``others`` are the restaurant's tables with other dishes, ``parent`` the dish's probability in the parent.
    """
    out = np.ones(len(customers))
    order = np.argsort(customers, kind="stable")
    sizes, begins = np.unique(customers[order], return_index=True)
    ends = np.append(begins[1:], len(order))
    for c, lo, hi in zip(sizes.tolist(), begins.tolist(), ends.tolist(), strict=True):
        if not 1 < c <= EXACT:
            continue
        ways, step = stirling(discount)[c, 1 : c + 1], max(1, (1 << 20) // c)
        for k in range(lo, hi, step):
            at = order[k : min(hi, k + step)]
            log = np.cumsum(np.log((strength + discount * (others[at][:, None] + np.arange(c))) * parent[at][:, None]), 1) + ways
            chance = np.cumsum(np.exp(log - log.max(1, keepdims=True)), 1)
            out[at] = 1 + (chance < (rng.random(len(at)) * chance[:, -1])[:, None]).sum(1)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        out[many] = _metropolis(customers[many].astype(float), tables[many].astype(float), others[many], parent[many], discount, strength, rng)
    return out


def _metropolis(c, t, others, parent, d: float, b: float, rng: np.random.Generator) -> np.ndarray:
    """Steps that leave the chances of t as they are; proposals are normal around the likeliest t, rounded."""

    def slope(t):
        return _saddle(c, t, d)[1] + np.log((b + d * (others + t)) * parent)

    def log_chance(t):
        return log_stirling(c, t, d) + t * math.log(d) + _log_gamma(b / d + others + t) + t * np.log(parent)

    low, high = np.ones(len(c)), c.copy()
    for _ in range(40):
        mid = (low + high) / 2
        up = slope(mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    best = (low + high) / 2
    near = np.maximum(1.0, 0.01 * best)
    bend = (slope(np.maximum(best - near, 1)) - slope(np.minimum(best + near, c))) / (2 * near)
    wide = 1.2 / np.sqrt(np.maximum(bend, 1e-12)) + 0.5
    drawn = lambda t: -0.5 * ((t - best) / wide) ** 2
    t = np.clip(np.where(t > 1, t, np.round(best)), 1, c)
    now = log_chance(t) - drawn(t)
    for _ in range(STEPS):
        new = np.round(best + wide * rng.standard_normal(len(c)))
        inside = (new >= 1) & (new <= c)
        new = np.clip(new, 1, c)
        then = log_chance(new) - drawn(new)
        take = inside & (np.log(rng.random(len(c))) < then - now)
        t, now = np.where(take, new, t), np.where(take, then, now)
    return t


def _row(bucket, words, pairs, ctx, n, tables, seated, roots, slices, sums) -> dict:
    return {"bucket": bucket, "words": words, "pairs": pairs, "ctx": ctx, "n": n, "tables": tables, "seated": seated, "roots": roots, "slices": slices, "sums": sums}


def _totals(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Over all buckets: the bounded table of the restaurants, and a few sums. Only these reach the driver."""

    def add(table):
        parts = [_unpack(x.as_py(), "u8").astype(float) for x in table.column("part")]
        return pa.table({"slice": table.column("slice").slice(0, 1), "part": pa.array([np.sum(parts, 0).tobytes()], pa.binary())})

    rows = model.select(F.posexplode("slices").alias("slice", "part")).groupBy("slice").applyInArrow(add, "slice int, part binary").collect()
    table = np.concatenate([np.zeros(0), *(np.frombuffer(r.part) for r in sorted(rows, key=lambda r: r.slice))])
    first = model.select(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(6))).first()
    return table, np.array([x or 0.0 for x in first])


def _parent(customers, tables, root: tuple[float, float], discount: float, even: float) -> np.ndarray:
    """The parent's probability of words with so many customers and tables there."""
    return (customers - discount * tables + (STRENGTH + discount * root[1]) * even) / (STRENGTH + root[0])


class Model:
    """The saved seating, by bucket of words, and the bounded tables that every task gets."""

    def __init__(self, documents: DataFrame, scratch: Scratch, sweeps: int = SWEEPS, burn_in: int = BURN_IN):
        spark, self.scratch = documents.sparkSession, scratch
        size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.bits = bits = max(int(math.log2(LEAST_BUCKETS)), math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
        self.context_bits = context_bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size / CLASS_BYTES)))))
        self.contexts = contexts = 1 << context_bits
        lots = max(1, math.ceil(size / LOT_BYTES))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = {"bucket": pa.int32(), "words": pa.binary(), "pairs": pa.binary(), "ctx": pa.binary(), "n": pa.binary()}
            for batch in batches:
                for rows in _counted(batch, bits, context_bits):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

        def merged(table):
            words, code, n = _gathered(table)
            code, index = np.unique(code, return_inverse=True)
            n = np.bincount(index, n).astype(np.uint32)
            return words, (code >> _SHIFT).astype(np.int64), (code & _LOW).astype(np.uint32), n

        def merge(table):
            words, index, ctx, n = merged(table)
            row = (table.column("bucket")[0].as_py(), table.column("lot")[0].as_py(), words.tobytes(), _pack(np.bincount(index, minlength=len(words)).astype(np.uint32)), _pack(ctx), _pack(n))
            return pa.table({k: pa.array([v], t) for k, v, t in zip(("bucket", "lot", "words", "pairs", "ctx", "n"), row, (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)})

        def open_tables(table):
            words, index, ctx, n = merged(table)
            kinds = np.bincount(index, minlength=len(words))
            one = np.ones(len(n))
            sums = [float(n.sum()), float(len(words)), float(np.sum(n == 1)), float(np.sum(n == 2)), float(np.sum(kinds == 1)), float(np.sum(kinds == 2))]
            row = _row(table.column("bucket")[0].as_py(), words.tobytes(), _pack(kinds.astype(np.uint32)), _pack(ctx), _pack(n), _pack(one.astype(np.uint32)), _pack(np.zeros(len(n), np.uint32)), b"", _sums_by_slice(ctx, n, contexts) + _sums_by_slice(ctx, one, contexts), sums)
            return pa.table({k: pa.array([row[k]], t) for k, t in _FIELDS})

        counts = documents.select("text", (~held_out("doc_id", 7, 2)).alias("learnt")).mapInArrow(count, "bucket int, words binary, pairs binary, ctx binary, n binary")
        counts = counts.withColumn("lot", F.spark_partition_id().cast("long")) if lots > 1 else counts
        while lots > 1:  # a bucket's blocks are merged lot by lot, so no task holds all blocks of a frequent word
            counts = counts.withColumn("lot", F.col("lot") % lots).groupBy("bucket", "lot").applyInArrow(merge, "bucket int, lot long, words binary, pairs binary, ctx binary, n binary")
            lots = max(1, lots // FAN_IN)
        model = scratch.save(counts.select("bucket", "words", "pairs", "ctx", "n").groupBy("bucket").applyInArrow(open_tables, MODEL), "seating0", large_cells=True)
        #: Buckets with more tokens than are looked up together: at most one for each LOT_TOKENS of text.
        hot = model.select("bucket", F.ceil(F.get("sums", F.lit(0)) / LOT_TOKENS).cast("int").alias("lots")).where("lots > 1")
        self.lots = {r.bucket: r.lots for r in hot.collect()}
        both, sums = _totals(model)
        both = both if len(both) == 2 * contexts else np.zeros(2 * contexts)
        self.customers, tables = both[:contexts], both[contexts:]
        self.n_tokens, self.n_words = int(sums[0]), int(sums[1])
        share = lambda one, two: float(np.clip(one / max(1.0, one + 2 * two), 0.05, 0.95))
        self.discount, self.root_discount = share(sums[2], sums[3]), share(sums[4], sums[5])
        self.samples: list[tuple[np.ndarray, float, float]] = []
        root = (float(tables.sum()), float(self.n_words))
        for sweep in range(sweeps):
            state = spark.sparkContext.broadcast((tables, root))
            model = scratch.save(model.mapInArrow(self._sweep(state, sweep, burn_in), MODEL), f"seating{sweep + 1}", large_cells=True)
            scratch.drop(f"seating{sweep}")
            tables, sums = _totals(model)
            tables = tables if len(tables) == contexts else np.zeros(contexts)
            root = (float(sums[0]), float(sums[1]))
            if sweep >= burn_in:
                self.samples.append((tables, *root))
        self.seating = model

    def _sweep(self, state, sweep: int, burn_in: int):
        d, root_d, even, contexts = self.discount, self.root_discount, 1 / (self.n_words + 1), self.contexts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, root = state.value
            for batch in batches:
                for i in range(batch.num_rows):  # a row is a bucket; one is worked on at a time
                    r = {k: batch.column(k)[i].as_py() for k in ("bucket", "words", "pairs", "ctx", "n", "tables", "seated", "roots")}
                    rng = np.random.default_rng([r["bucket"], sweep])
                    kinds, ctx = _unpack(r["pairs"], "u4").astype(np.int64), _unpack(r["ctx"], "u4").astype(np.int64)
                    n, t = _unpack(r["n"], "u4").astype(np.int64), _unpack(r["tables"], "u4").astype(float)
                    index = np.repeat(np.arange(len(kinds)), kinds)
                    sent = np.bincount(index, t, len(kinds))
                    root_tables = np.frombuffer(r["roots"], np.float32)[-len(kinds) :].astype(float) if r["roots"] else np.ones(len(kinds))
                    chance = _parent(sent, root_tables, root, root_d, even)
                    t = seat(n, t, tables[ctx] - t, chance[index], d, STRENGTH, rng)
                    sent = np.bincount(index, t, len(kinds))
                    root_tables = seat(sent.astype(np.int64), root_tables, root[1] - root_tables, np.full(len(kinds), even), root_d, STRENGTH, rng)
                    own = np.concatenate([sent, root_tables]).astype(np.float32).tobytes()
                    seated = _unpack(r["seated"], "u4") + (t.astype(np.uint32) if sweep >= burn_in else 0)
                    row = r | {"tables": _pack(t.astype(np.uint32)), "seated": _pack(seated.astype(np.uint32)), "roots": (r["roots"] if sweep > burn_in else b"") + own, "slices": _sums_by_slice(ctx, t, contexts), "sums": [float(sent.sum()), float(root_tables.sum()), 0.0, 0.0, 0.0, 0.0]}
                    yield pa.RecordBatch.from_arrays([pa.array([row[k]], kind) for k, kind in _FIELDS], names=[k for k, _ in _FIELDS])

        return run

    def score(self, documents: DataFrame) -> DataFrame:
        """Per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both sums of log10).

        A null text is empty, an empty one is its end alone. Without training rows every token is unknown. Repeated rows
        are scored, and learnt from, as often as they come; rows without an id are learnt from. A text is read whole,
        however long.
        """
        bits, context_bits, lots, d, n_samples = self.bits, self.context_bits, self.lots, self.discount, max(1, len(self.samples))
        spark, samples, root_d, even = documents.sparkSession, self.samples, self.root_discount, 1 / (self.n_words + 1)
        shared = spark.sparkContext.broadcast((self.customers, [s[0] for s in samples] or [np.zeros(self.contexts)]))
        roots = [(s[1], s[2]) for s in samples] or [(0.0, 0.0)]
        total = self.n_tokens + self.n_words + 1
        kinds = {"bucket": pa.int64(), "lot": pa.int32(), "chunk": pa.int64(), "words": pa.binary(), "pairs": pa.binary(), "ctx": pa.binary(), "n": pa.binary(), "rows": pa.binary(), "size": pa.int32()}
        names = ", ".join(f"{k} {'binary' if t == pa.binary() else 'long' if t == pa.int64() else 'int'}" for k, t in kinds.items())

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk = TaskContext.get().partitionId() << 32
            for batch in batches:
                for lo, hi, h, ctx, rows in _chunks(batch, context_bits):
                    words, code = _pairs(h, ctx)
                    order = np.argsort(code)
                    code, rows = code[order], rows[order].astype(np.uint32)
                    edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                    n, code = np.diff(np.append(edge, len(code))), code[edge]
                    ids = batch.column("doc_id").slice(lo, hi - lo)
                    head = pa.RecordBatch.from_arrays([ids, batch.column("held_out").slice(lo, hi - lo)], names=["doc_id", "held_out"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, head.schema) as out_stream:
                        out_stream.write_batch(head)
                    size = np.bincount(rows, minlength=hi - lo).astype(np.uint32)
                    out = [(-1 - chunk, 0, chunk, sink.getvalue().to_pybytes(), b"", b"", _pack(size), b"", hi - lo)]
                    ends = np.append(edge, len(rows))
                    for b, a, z, x, y in _ranges(words, code, bits):
                        pairs = np.bincount((code[x:y] >> _SHIFT).astype(np.int64) - a, minlength=z - a)
                        out.append((b, (chunk + (chunk >> 32)) % lots.get(b, 1), chunk, words[a:z].tobytes(), _pack(pairs.astype(np.uint32)), _pack((code[x:y] & _LOW).astype(np.uint32)), _pack(n[x:y].astype(np.uint32)), _pack(rows[ends[x] : ends[y]]), hi - lo))
                    chunk += 1
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

        def answer(asked, model):
            """Of each block its rows' sums over the words of this bucket."""
            customers, tables = shared.value
            if not asked.num_rows or asked.column("bucket")[0].as_py() < 0:  # a block's own line goes on as it is
                n = asked.column("n")
                return pa.table({"chunk": asked.column("chunk"), "head": asked.column("words"), "score": n, "base": n, "known": n})
            if model.num_rows:
                m = {k: model.column(k)[0].as_py() for k in ("words", "pairs", "ctx", "n", "seated", "roots")}
                words, per = np.frombuffer(m["words"], np.uint64), _unpack(m["pairs"], "u4").astype(np.int64)
                index = np.repeat(np.arange(len(words)), per)
                known = (index.astype(np.uint64) << _SHIFT) | _unpack(m["ctx"], "u4")
                n = _unpack(m["n"], "u4").astype(float)
                own = n - d * _unpack(m["seated"], "u4") / n_samples
                count = np.bincount(index, n, len(words))
                seats = np.frombuffer(m["roots"], np.float32).reshape(n_samples, 2, -1).astype(float)
            else:
                words, known, own, count = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
                seats = np.zeros((n_samples, 2, 0))
            # one more word, with no customers: the unknown
            chance = [_parent(np.append(s[0], 0.0), np.append(s[1], 0.0), root, root_d, even) for s, root in zip(seats, roots, strict=True)]
            count, own = np.append(count, 0.0), np.append(own, 0.0)
            out = {"chunk": [], "score": [], "base": [], "known": []}
            for i in range(asked.num_rows):
                r = {k: asked.column(k)[i].as_py() for k in ("chunk", "words", "pairs", "ctx", "n", "rows", "size")}
                mine = np.frombuffer(r["words"], np.uint64)
                at = np.minimum(np.searchsorted(words, mine), max(0, len(words) - 1))
                at = np.where(words[at] == mine, at, len(words)) if len(words) else np.zeros(len(mine), np.int64)
                at = np.repeat(at, _unpack(r["pairs"], "u4").astype(np.int64))
                ctx = _unpack(r["ctx"], "u4")
                code = (at.astype(np.uint64) << _SHIFT) | ctx
                pair = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
                has = own[np.where(known[pair] == code, pair, len(known))] if len(known) else np.zeros(len(code))
                back = sum((STRENGTH + d * t[ctx]) * c[at] for t, c in zip(tables, chance, strict=True)) / n_samples
                p = np.log10((has + back) / (STRENGTH + customers[ctx]))
                times, rows = _unpack(r["n"], "u4").astype(np.int64), _unpack(r["rows"], "u4").astype(np.int64)
                out["chunk"].append(r["chunk"])
                out["score"].append(np.bincount(rows, np.repeat(p, times), r["size"]).astype(np.float32).tobytes())
                out["base"].append(np.bincount(rows, np.repeat(np.log10((count[at] + 1) / total), times), r["size"]).tobytes())
                out["known"].append(_pack(np.bincount(rows, np.repeat((count[at] > 0).astype(float), times), r["size"]).astype(np.uint32)))
            none = pa.nulls(asked.num_rows, pa.binary())
            return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "head": none, **{k: pa.array(out[k], pa.binary()) for k in ("score", "base", "known")}})

        def add(parts):
            """A block's rows with their sums over all buckets."""
            at = next(i for i, x in enumerate(parts.column("head")) if x.is_valid)
            head = pa.ipc.open_stream(parts.column("head")[at].as_py()).read_all()
            size = _unpack(parts.column("known")[at].as_py(), "u4").astype(np.int64)
            score, base, known = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size), np.int64)
            for i in range(parts.num_rows):
                if i != at:
                    score += np.frombuffer(parts.column("score")[i].as_py(), np.float32)
                    base += np.frombuffer(parts.column("base")[i].as_py())
                    known += _unpack(parts.column("known")[i].as_py(), "u4")
            return pa.table({"doc_id": head.column("doc_id"), "held_out": head.column("held_out"), "n_tokens": size, "n_known": known, "base_score": base, "score": score})

        rows = documents.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "text").mapInArrow(ask, names)
        # a bucket with more tokens than one lot is copied to each of its lots
        copies = F.create_map(*(F.lit(x) for item in lots.items() for x in item))[F.col("bucket")] if lots else F.lit(None)
        lot = F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)).cast("int") - 1)).alias("lot")
        seating = self.seating.select(F.col("bucket").cast("long"), lot, "words", "pairs", "ctx", "n", "seated", "roots")
        parts = rows.groupBy("bucket", "lot").cogroup(seating.groupBy("bucket", "lot")).applyInArrow(answer, "chunk long, head binary, score binary, base binary, known binary")
        kind = documents.schema["doc_id"].dataType.simpleString()
        out = parts.groupBy("chunk").applyInArrow(add, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(self.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
