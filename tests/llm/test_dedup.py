import random

import pytest

from gaugemill.llm import lshforest, substring

from . import brute

SCHEMA = "doc_id long, text string, component_id string, digest string"


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    passage, texts = words(25), []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.4 or not texts:
            texts.append(words(rnd.randint(1, 120)))
        elif kind < 0.6:
            texts.append(list(rnd.choice(texts)))
        elif kind < 0.85:
            copy = list(rnd.choice(texts))
            for _ in range(rnd.randint(1, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(copy)
        else:
            texts.append(words(30) + passage + words(10))
    rows = [(i, rnd.choice([" ", "\n", "\t "]).join(t)) for i, t in enumerate(texts)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "One TWO three"), (n + 4, "one two THREE"), (n + 5, "aß É x " * 40), (n + 6, "same " * 500)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_finds_what_brute_force_finds(spark, seed):
    rows = corpus(seed)
    found = lshforest.group(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.near(rows)


def test_forest_repeated_rows_nulls_and_empty_tables(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(3, text), (3, text), (5, text), (None, text), (None, None), (9, None)]
    found = sorted((tuple(r) for r in lshforest.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert found == sorted([(3, 26, 3), (3, 26, 3), (5, 26, 3), (None, 26, 3), (None, 0, None), (9, 0, 9)], key=str)
    assert lshforest.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_anchors_remove_what_brute_force_removes(spark, seed):
    rows = corpus(seed)
    found = substring.removals(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute.repeats(rows)


def test_anchors_repeated_rows_nulls_and_empty_tables(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(3, text), (3, text), (5, text), (None, text), (None, None), (9, "")]
    found = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert found == sorted([(3, 30, 0), (3, 30, 0), (5, 30, 30), (None, 30, 30), (None, 0, 0), (9, 0, 0)], key=str)
    assert substring.removals(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sets_outside_a_large_component_are_looked_up_again(spark, monkeypatch):
    monkeypatch.setattr(lshforest, "LARGE", 4)
    rnd = random.Random(9)
    base = [f"v{i}" for i in range(80)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(80)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    found = lshforest.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.near(rows)


def test_pairs_in_a_dense_region_without_a_large_component_are_found(spark):
    """Pages of one template, alike by 0.70; a few pairs far apart in any order of ids reach 0.76."""
    template, n = [f"t{i}" for i in range(173)], 2000
    ends = [[f"u{i}x{k}" for k in range(35)] for i in range(n)]
    for i in range(8):
        ends[n // 2 + 101 * i + 7] = ends[101 * i][:8] + ends[n // 2 + 101 * i + 7][8:]
    rows = [(i, " ".join(template + e)) for i, e in enumerate(ends)]
    found = {r.doc_id: r.component_id for r in lshforest.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = {n // 2 + 101 * i + 7: 101 * i for i in range(8)}
    sets = {i: brute.shingles(t) for i, t in rows if i in pairs or i in pairs.values() or i < 5}
    assert {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])} == {(b, a) for a, b in pairs.items()}
    assert found == {i: pairs.get(i, i) for i in range(n)}
