import math
import zlib
from collections import Counter

import numpy as np

from gaugemill.llm import hpylm
from gaugemill.llm.scratch import Scratch

from . import brute


def test_counts_base_and_chances(spark):
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 60)) + " The the CAFÉ") for i in range(60)] + [(100, None), (101, ""), (102, "unseen words here"), (None, "w1 w2"), (7, "w1 w1")]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    model = hpylm.Model(docs, Scratch(spark, "t"))
    found = sorted(((r.doc_id, r.n_tokens), r) for r in model.score(docs).collect() if r.doc_id is not None)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*brute.WORD.findall(brute.fold(t)), None]
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total = sum(count.values())
    assert len(found) == len(rows) - 1 and model.n_tokens == total and model.n_words == len(count)
    wanted = sorted((i, len(tokens(t)), held(i), sum(w in count for w in tokens(t)), sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in tokens(t))) for i, t in rows if i is not None)
    for (key, r), (i, n, h, known, base) in zip(found, wanted, strict=True):
        assert key == (i, n) and (r.held_out, r.n_known, r.train_tokens) == (h, known, total) and abs(r.base_score - base) < 1e-9 and r.score < 0
    assert sum(r.score for _, r in found) > sum(r.base_score for _, r in found)


def test_chances_of_all_words_and_the_unknown_add_up(spark):
    """After one same context everything that can follow has chance one: ends are read off by making texts of words alone."""
    words = [f"w{i}" for i in range(6)]
    docs = spark.createDataFrame([(i, f"{words[i % 6]} {words[(i * i) % 6]} {words[i % 4]}") for i in range(60)], "doc_id long, text string")
    model = hpylm.Model(docs, Scratch(spark, "t"))
    one = lambda texts: [10 ** r.score for r in sorted(model.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)]
    every = [*words, "unknown"]
    # p(x y end) / p(x end) * p(end | x) / p(end | y), with ends from p(x x end) / p(x end) * 1 = p(x | x): so the sum over
    # sequences of a fixed length, each closed by its own end, can't pass one, and grows to one with all lengths.
    total, mass = one([""])[0], []
    for texts in (every, [f"{a} {b}" for a in every for b in every], [f"{a} {b} {c}" for a in every for b in every for c in every]):
        mass.append(sum(one(texts)))
    assert total + sum(mass) < 1 + 1e-6 and total + sum(mass) > 0.5


def partitions(n):
    """All ways to split n customers into tables, as lists of sizes."""
    if n == 0:
        yield []
        return
    for rest in partitions(n - 1):
        yield [*rest, 1]
        for i in range(len(rest)):
            yield rest[:i] + [rest[i] + 1] + rest[i + 1 :]


def test_one_step_follows_the_law_over_all_seatings():
    """The chances of t tables, summed over all splits of the customers, are those that a Gibbs step draws from, wherever
    it starts: so the law stays as it is under the step."""
    rng, (c, d, b, others, parent) = np.random.default_rng(0), (6, 0.6, 1.0, 2.0, 0.2)
    weight = Counter()
    for sizes in partitions(c):
        tables = math.prod((b + d * (others + j)) * parent for j in range(len(sizes)))
        weight[len(sizes)] += tables * math.prod(k - d for n in sizes for k in range(1, n))
    total, n = sum(weight.values()), 40_000
    for start in (1, 4):
        drawn = Counter(hpylm.seat(np.full(n, c), np.full(n, start), np.full(n, others), np.full(n, parent), d, b, rng).tolist())
        assert all(abs(drawn[t] / n - w / total) < 4 * math.sqrt(w / total / n) + 1e-4 for t, w in weight.items())


def test_metropolis_steps_of_many_customers_follow_the_exact_chances():
    d, c, b, others, parent = 0.7, 400, 1.0, 30.0, 0.05
    ways = hpylm.stirling(d, c)[c, 1 : c + 1]
    log = ways + np.cumsum(np.log((b + d * (others + np.arange(c))) * parent))
    chance = np.exp(log - log.max())
    chance /= chance.sum()
    mean = (chance * np.arange(1, c + 1)).sum()
    wide = math.sqrt((chance * (np.arange(1, c + 1) - mean) ** 2).sum())
    rng, n, t = np.random.default_rng(1), 4000, np.ones(4000)
    for _ in range(5):
        t = hpylm.seat(np.full(n, c), t, np.full(n, others), np.full(n, parent), d, b, rng)
    assert abs(t.mean() - mean) < 0.1 * wide and 0.9 < t.std() / wide < 1.1
    for c in (400, 3000):
        t = np.concatenate([np.arange(1.0, 10), np.arange(10.0, 200, 13)])
        assert np.abs(hpylm.log_stirling(np.full(len(t), float(c)), t, d) - hpylm.stirling(d, c)[c, t.astype(int)]).max() < 0.05
    assert (hpylm.seat(np.array([1, 500_000]), np.ones(2), np.zeros(2), np.array([0.1, 0.1]), 0.5, 1.0, rng) >= 1).all()


def test_lots_and_levels_give_the_same_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"v{(i * k) % 23}" for k in range(40))) for i in range(80)] + [(500, "w " * 30_000)], "doc_id long, text string").repartition(6)
    plain = {r.doc_id: r for r in hpylm.Model(docs, Scratch(spark, "t")).score(docs).collect()}
    for name, value in (("LOT_BYTES", 3000), ("FAN_IN", 2), ("LOT_TOKENS", 200), ("BLOCK_BYTES", 2000)):
        monkeypatch.setattr(hpylm, name, value)
    model = hpylm.Model(docs, Scratch(spark, "t"))
    found = {r.doc_id: r for r in model.score(docs).collect()}
    assert model.lots and found.keys() == plain.keys()
    for i, r in found.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (plain[i].n_tokens, plain[i].n_known, plain[i].train_tokens)
        assert abs(r.base_score - plain[i].base_score) < 1e-6 * abs(plain[i].base_score) and abs(r.score - plain[i].score) < 0.1 * abs(plain[i].score)


def test_no_training_rows_and_no_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    docs = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in hpylm.Model(docs, Scratch(spark, "t")).score(docs).collect())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hpylm.Model(empty, Scratch(spark, "t")).score(empty).count() == 0
