"""Toxic spans and document scores from a linear-chain conditional random field.

Training takes a bounded, balanced sample of labelled documents. A token counts as toxic there if it stands in a toxic
document and its form, or its first bytes, go with toxic documents far beyond chance; these labelled tokens train a
chain with two states, whose features are forms, first and last bytes of a word and of its neighbours. Scoring runs
forward-backward over each whole text; the marginals give offending spans, and their sum and maximum, calibrated on the
same sample, give the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .textops import Words, blocks

#: Training takes at most so many documents of each class, each of at most so many bytes, and of a class so many in all.
SAMPLE_PER_CLASS, SAMPLE_BYTES, SAMPLE_TOTAL = 1500, 20_000, 8 << 20
BITS = 18
#: Log likelihood ratio from which a form counts as going with toxic documents, the least share of these, and rounds of
#: taking such forms.
ASSOCIATION, PURITY, ROUNDS = 12.0, 0.93, 16
SPAN_AT, DAMPING = 0.5, 0.3
_MARKS = np.isin(np.arange(256), list(b".,!?;:|\"')]}"))
SCHEMA = "n_tokens long, score double, spans array<struct<start:int,end:int,prob:double>>"


def held_out(doc_id: str = "doc_id", modulus: int = 3, rest: int = 1):
    """Whether crc32 of the id as text leaves ``rest``; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == rest, F.lit(False))


def _features(words: Words) -> np.ndarray:
    """Feature slots, one row for each kind of feature."""
    n = len(words.starts)
    if not n:
        return np.zeros((9, 0), np.int32)
    ends = words.ends.copy()
    for _ in range(3):  # a form goes without the marks that close it
        ends -= _MARKS[words.data[ends - 1]] & (ends - words.starts > 1)
    size, slot = ends - words.starts, np.uint64(64 - BITS)
    rows = [words.span_hash(words.starts, ends)]
    for k in (3, 4, 5, 6):
        rows.append(words.span_hash(words.starts, np.minimum(words.starts + k, ends)) + np.uint64(k))
    for k in (3, 5):
        rows.append(words.span_hash(np.maximum(ends - k, words.starts), ends) + np.uint64(20 + k))
    prior, after = np.roll(rows[0], 1), np.roll(rows[0], -1)
    prior[words.first[:-1][words.first[:-1] < n]] = 0
    after[words.first[1:][words.first[1:] > 0] - 1] = 0
    rows += [prior + np.uint64(31), after + np.uint64(32)]
    out = np.stack([((r * np.uint64(0x9E3779B97F4A7C15 + 2 * i)) >> slot).astype(np.int32) for i, r in enumerate(rows)])
    for i, k in enumerate((3, 4, 5, 6, 3, 5)):  # of a word with no more bytes, the form says the same
        out[1 + i][size <= k] = out[0][size <= k]
    return out


@dataclass
class Chain:
    """Weights of the features, and of staying in or moving between the states clean and toxic."""

    weight: np.ndarray
    bias: float
    move: np.ndarray
    calibration: np.ndarray

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of the toxic state for each token, given all tokens of its row."""
        return _forward_backward(np.clip(emission + self.bias, -30, 30), first, np.exp(self.move))[0]

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_totals(p, first) @ self.calibration, -30, 30)))


def _totals(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row: 1, log of 1 + expected toxic tokens, and the largest marginal."""
    total = np.diff(np.concatenate([[0.0], np.cumsum(p)])[first])
    top = np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        top[full] = np.maximum.reduceat(p, first[:-1][full])
    return np.stack([np.ones(len(top)), np.log1p(np.maximum(total, 0)), top], 1)


def _forward_backward(emission: np.ndarray, first: np.ndarray, a: np.ndarray, pairs: bool = False):
    """Marginals, and if asked the expected moves. All rows go step by step together; a row drops out at its end."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begins, size = first[:-1][order], size[order]
    e = np.exp(emission)
    ahead, behind = np.empty_like(e), np.ones_like(e)
    longest = int(size[0]) if len(size) else 0
    active = len(size) - np.searchsorted(size[::-1], np.arange(longest), "right")
    odds = np.full(len(size), 1.0)
    for t in range(longest):
        at = begins[: active[t]] + t
        if t:
            o = odds[: active[t]]
            odds = (a[0, 1] + o * a[1, 1]) / (a[0, 0] + o * a[1, 0]) * e[at]
        else:
            odds = e[at]
        ahead[at] = odds
    for t in range(longest - 2, -1, -1):
        at = begins[: active[t + 1]] + t
        x = e[at + 1] * behind[at + 1]
        behind[at] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
    odds = ahead * behind
    p = odds / (1 + odds)
    if not pairs:
        return p, None
    inner = np.ones(len(e), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    right = np.flatnonzero(inner)
    x, y = ahead[right - 1], e[right] * behind[right]
    w = np.stack([np.full(len(x), a[0, 0]), a[0, 1] * y, a[1, 0] * x, a[1, 1] * x * y])
    return p, (w / w.sum(0)).sum(1).reshape(2, 2)


def _toxic_tokens(slots: np.ndarray, row_of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tokens of toxic rows whose form or first bytes go with such rows far beyond chance.

    Evidence is taken greedily: the strongest forms first, then what the toxic rows without these forms have, and so on.
    So a harmless word isn't blamed for standing, with its copies, beside an offensive one.
    """
    found, kinds = np.zeros(slots.shape[1], bool), (0, 2, 3, 4)
    seen = []  # each form once a row, as two short columns
    for k in kinds if slots.shape[1] else ():
        both = np.unique((slots[k].astype(np.int64) << 32) | row_of)
        seen.append(((both >> 32).astype(np.int32), (both & 0xFFFFFFFF).astype(np.int32)))
    left = toxic.copy()
    for _ in range(ROUNDS if seen else 0):
        rows = np.array([max(1, np.sum(~toxic)), max(1, np.sum(left))], float)
        base, gains = rows[1] / rows.sum(), []
        for slot, row in seen:
            n = np.stack([np.bincount(slot, ~toxic[row], minlength=1 << BITS), np.bincount(slot, left[row], minlength=1 << BITS)])
            total, share = n.sum(0), n / rows[:, None]
            gain = 2 * sum(n[c] * np.log(np.maximum(n[c], 1e-9) / np.maximum(total * q, 1e-9)) for c, q in ((0, 1 - base), (1, base)))
            gains.append(np.where(share[1] >= PURITY * np.maximum(share.sum(0), 1e-12), gain, 0))
        bar = max(ASSOCIATION, 0.5 * max(g.max() for g in gains))
        if not any((g >= bar).any() for g in gains):
            break
        new = np.zeros(slots.shape[1], bool)
        for k, g in zip(kinds, gains, strict=True):
            new |= (g >= bar)[slots[k]]
        found |= new
        left[row_of[new]] = False
    return found & toxic[row_of]


def train(texts: list[str], toxic: list[bool], epochs: int = 5, rate: float = 0.25) -> Chain:
    """Fits the chain to a bounded sample; without both classes the score is the share of toxic rows."""
    chain = Chain(np.zeros(1 << BITS), -4.0, np.array([[0.0, -3.0], [-1.0, 0.0]]), np.array([-3.0, 0.0, 0.0]))
    parts = [(_features(w), w.first) for w in blocks(pa.array(texts, pa.string()))]
    labels = np.array(toxic, bool)
    if not len(labels) or labels.all() or not labels.any():
        share = labels.mean() if len(labels) else 0.5
        chain.calibration[0] = np.log((share + 0.01) / (1.01 - share))
        return chain
    size = np.concatenate([np.diff(f) for _, f in parts])
    slots, at = np.empty((9, int(size.sum())), np.int32), 0
    while parts:  # a block's own features are let go as they are taken over
        s, _ = parts.pop(0)
        slots[:, at : at + s.shape[1]] = s
        at += s.shape[1]
    first = np.concatenate([[0], np.cumsum(size)])
    y = _toxic_tokens(slots, np.repeat(np.arange(len(size)), size), labels)
    squares, extra = np.full(1 << BITS, 1e-6), np.full(5, 1e-6)
    for epoch in range(epochs):
        mixed = np.random.default_rng(epoch).permutation(len(size))
        for lot in np.array_split(mixed, max(min(10, len(mixed)), len(mixed) // 300)):
            tokens = np.concatenate([np.arange(first[r], first[r + 1]) for r in lot])
            if not len(tokens):
                continue
            at, s, gold = np.concatenate([[0], np.cumsum(size[lot])]), slots[:, tokens], y[tokens]
            p, moves = _forward_backward(np.clip(sum(chain.weight[k] for k in s) + chain.bias, -30, 30), at, np.exp(chain.move), True)
            error, scale = (gold - p), 1 / len(lot)
            gradient = sum(np.bincount(k, error, 1 << BITS) for k in s) * scale - 1e-4 * chain.weight
            squares += gradient**2
            chain.weight += rate * gradient / np.sqrt(squares)
            right = np.setdiff1d(np.arange(len(tokens)), at[:-1])
            seen = np.bincount(2 * gold[right - 1] + gold[right], minlength=4).reshape(2, 2)
            step = np.append((seen - moves).ravel(), error.sum()) * scale
            extra += step**2
            step = rate * step / np.sqrt(extra)
            chain.move += step[:4].reshape(2, 2)
            chain.bias += step[4]
    p = chain.marginals(sum(chain.weight[k] for k in slots), first)
    x, t = _totals(p, first), labels.astype(float)
    beta = np.zeros(3)
    for _ in range(30):  # Newton steps of a slightly damped logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + DAMPING * np.eye(3), x.T @ (t - q) - DAMPING * beta)
    chain.calibration = beta
    chain.weight = chain.weight.astype(np.float32)
    return chain


def sample(documents: DataFrame, labels: DataFrame, allowed, per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``per_class`` documents of each class (by hashed id) that may be learnt from; only their ids are broadcast."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & allowed).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sized = documents.where((F.octet_length("text") <= most_bytes) & F.col("doc_id").isNotNull()).select("doc_id", F.octet_length("text").alias("_bytes"))
    both = named.join(sized, "doc_id").withColumn("_at", F.xxhash64("doc_id"))
    chosen = [both.where(F.col("toxic") == c).orderBy("_at", "doc_id").limit(per_class) for c in (0, 1)]
    so_far = F.sum("_bytes").over(Window.partitionBy("toxic").orderBy("_at", "doc_id"))  # over two bounded lists
    ids = chosen[0].unionByName(chosen[1]).withColumn("_sum", so_far).where(F.col("_sum") <= SAMPLE_TOTAL).select("doc_id", "toxic").distinct()
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def fit(documents: DataFrame, labels: DataFrame, allowed=None, **bounds) -> Chain:
    """The chain of a bounded sample, trained in one task; the driver gets its weights alone. Equal texts count once."""
    rows = sample(documents, labels, held_out() == False if allowed is None else allowed, **bounds)  # noqa: E712

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((i, t or "", v) for b in batches for i, t, v in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True)), key=lambda r: r[:2])
        once = {t: v for _, t, v in found}
        chain = train(list(once), [bool(v) for v in once.values()])
        yield pa.RecordBatch.from_arrays(
            [pa.array([chain.weight.astype(np.float32).tobytes()], pa.binary()), pa.array([float(chain.bias)]), pa.array([chain.move.ravel().tolist()]), pa.array([chain.calibration.tolist()])],
            names=["weight", "bias", "move", "calibration"],
        )

    made = rows.select("doc_id", "text", "toxic").repartition(1).mapInArrow(learn, "weight binary, bias double, move array<double>, calibration array<double>").first()
    if made is None:  # no row at all
        return train([], [])
    return Chain(np.frombuffer(made.weight, np.float32), made.bias, np.array(made.move).reshape(2, 2), np.array(made.calibration))


def score(documents: DataFrame, chain: Chain, spans: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, score and (with ``spans``) offending spans in code points to every row, beside the columns ``keep``.

    All columns are kept by default; columns that bear an added name are replaced.

    A null or empty text has no tokens and gets the score of a text without evidence. Rows stay where they are read:
    nothing is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(chain)
    names = [c for c in (documents.columns if keep is None else keep) if c not in ("n_tokens", "score", "spans")]
    source = documents.select(*dict.fromkeys([*names, "text"]))
    schema = f"{source.select(*names).schema.toDDL()}, {SCHEMA}"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("prob", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            counts, scores, found = [], [], []
            for w in blocks(batch.column("text")):
                slots = _features(w)
                p = model.marginals(sum(model.weight[s] for s in slots) if slots.shape[1] else np.zeros(0), w.first)
                counts.append(np.diff(w.first))
                scores.append(model.score(p, w.first))
                found += _spans(w, p) if spans else [[]] * (w.hi - w.lo)
            extra = [pa.array(np.concatenate(counts or [[]]).astype(np.int64)), pa.array(np.concatenate(scores or [[]]).astype(float)), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *extra], names=[*names, "n_tokens", "score", "spans"])

    return source.mapInArrow(run, schema)


def _spans(w: Words, p: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(w.hi - w.lo)]
    hits = np.flatnonzero(p >= SPAN_AT)
    rows = np.searchsorted(w.first, hits, "right") - 1
    for i, row in zip(hits, rows, strict=True):
        at = w.row_at[row]
        start = len(bytes(w.data[at : w.starts[i]]).decode("utf-8", "ignore"))
        out[row].append({"start": start, "end": start + len(bytes(w.data[w.starts[i] : w.ends[i]]).decode("utf-8", "ignore")), "prob": float(p[i])})
    return out
