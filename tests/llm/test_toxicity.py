import itertools
import random

import numpy as np
import pyarrow as pa

from gaugemill.llm import toxicity
from gaugemill.llm.textops import blocks


def test_marginals_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(2)
    sizes = [3, 0, 1, 6]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e, a = rng.normal(size=first[-1]), np.exp(rng.normal(size=(2, 2)))
    p, moves = toxicity._forward_backward(e, first, a, True)
    want, pairs = np.zeros(len(e)), np.zeros((2, 2))
    for lo, hi in zip(first, first[1:]):
        total, at, both = 0.0, np.zeros(hi - lo), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=hi - lo):
            w = np.exp(np.dot(path, e[lo:hi])) * np.prod([a[x, y] for x, y in zip(path, path[1:])])
            total += w
            at += w * np.array(path)
            for x, y in zip(path, path[1:]):
                both[x, y] += w
        want[lo:hi] = at / total
        pairs += both / total
    assert np.allclose(p, want) and np.allclose(moves, pairs)


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    clean, bad = [f"w{i}" for i in range(500)], ["zork", "zorkish", "blarg"]
    rows = []
    for _ in range(n):
        words = [rnd.choice(clean) for _ in range(rnd.randint(3, 60))]
        toxic = rnd.random() < 0.3
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randint(0, len(words)), rnd.choice(bad))
        rows.append((" ".join(words), toxic))
    return rows


def test_learns_words_scores_documents_and_gives_their_place(spark):
    train = corpus()
    chain = toxicity.train([t for t, _ in train], [v for _, v in train])
    rows = [(i, t, "x") for i, (t, _) in enumerate(corpus(200, 2))] + [(900, None, "x"), (901, "", "x"), (902, "é " * 50 + "Zork!", "x"), (902, "é " * 50 + "Zork!", "x"), (903, "w1 " * 60_000 + "zork", "x")]
    found = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), chain).collect()
    by = {r.doc_id: r for r in found}
    truth = {i: v for i, (_, v) in enumerate(corpus(200, 2))}
    assert len(found) == len(rows) and sum((by[i].score >= 0.7) == v for i, v in truth.items()) >= 198
    assert by[900].score == by[901].score < 0.7 and by[900].n_tokens == 0
    assert by[902].score > 0.7 and by[903].score > 0.7 and [rows[202][1][s.start : s.end] for s in by[902].spans] == ["Zork!"]
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), chain).count() == 0


def test_fit_keeps_to_training_rows_and_bounds(spark):
    import zlib

    train = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(train)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, (_, v) in enumerate(train)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    sample = toxicity.sample(docs, labels, ~toxicity.held_out(), 30).collect()
    assert len(sample) == 60 and not any(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in sample)
    assert toxicity.fit(docs, labels.where("false")).calibration.shape == (3,)


def test_blocks_split_words_of_odd_texts():
    texts = ["a b", None, "", "  x\téy\n", "", "z" * 10, "\x0b\x0c", "q"]
    got = [bytes(w.data[a:b]).decode() for w in blocks(pa.array(texts)) for a, b in zip(w.starts, w.ends)]
    assert got == ["a", "b", "x", "éy", "z" * 10, "q"]
    (w,) = blocks(pa.array(texts))
    assert np.diff(w.first).tolist() == [2, 0, 0, 2, 0, 1, 0, 1]
    (u,) = blocks(pa.array(["A b B a"]))
    h = u.hashes()
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]
