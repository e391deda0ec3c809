import random
from collections import Counter

from gaugemill.llm import decontaminate

from . import brute


def multiset(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def wanted(docs, items):
    out = {}
    for i, text in docs:
        doc = brute.WORD.findall((text or "").lower())
        for j, item in items:
            words = brute.WORD.findall((item or "").lower())
            k, best = min(5, len(words)), (0, 0)
            m, own = len(words) - k + 1, multiset(words, k) if words else {}
            if not words or not own.keys() & multiset(doc, k).keys():
                continue
            for s in range(max(1, len(doc) - len(words) + 1)):
                window = multiset(doc[s : s + len(words)], k)
                n = sum(window.values())
                shared = sum((window & own).values())
                if shared and shared / (n + m - shared) > best[0]:
                    best = (shared / (n + m - shared), s)
            if best[0] >= 0.75:
                out[i, j] = round(best[0], 9)
    return out


def test_leaks_are_those_of_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(j, words(rnd.choice([3, 5, 9, 24, 25, 40]))) for j in range(25)] + [(90, ["same"] * 30)]
    docs = []
    for i in range(120):
        _, item = rnd.choice(items)
        copy = list(item)
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randrange(len(copy))
            kind = rnd.random()
            copy[at : at + 1] = words(1) if kind < 0.4 else words(2) if kind < 0.7 else []
        docs.append((i, words(rnd.randint(0, 40)) + copy + words(rnd.randint(0, 40))))
    docs += [(500, ["same"] * 400), (501, items[3][1][: len(items[3][1]) - 1])]
    docs = [(i, rnd.choice([" ", "\n", "\t  "]).join(t).upper()) for i, t in docs] + [(600, None), (601, ""), (602, "   ")]
    items = [(j, " ".join(t)) for j, t in items] + [(91, None), (92, ""), (93, " \n")]
    d = spark.createDataFrame([(i, t, 1, "x", 2, "y", "z", 3) for i, t in docs], "doc_id long, text string, item_id int, key string, _key int, row string, words string, id int")
    b = spark.createDataFrame([(*i, "w", 1) for i in items], "item_id long, text string, words string, m int")
    found = decontaminate.leaks(d.select("doc_id", "text"), b).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == wanted(docs, items)
    left = decontaminate.clean(d, b)
    assert left.columns == d.columns and left.exceptAll(d).isEmpty() and {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in wanted(docs, items)}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    item = " ".join(f"t{i}" for i in range(30))
    d = spark.createDataFrame([(1, item), (1, item), (1, "other text"), (None, f"x {item} y"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (7, item), (8, "short")], "item_id long, text string")
    assert sorted(((r.doc_id, r.item_id, r.start) for r in decontaminate.leaks(d, b).collect()), key=str) == [(1, 7, 0), (None, 7, 1)]
    assert sorted((tuple(r) for r in decontaminate.clean(d, b).collect()), key=str) == [(1, "other text"), (2, None)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.leaks(none, b).count() == 0 and decontaminate.leaks(d, spark.createDataFrame([], b.schema)).count() == 0


def test_items_of_one_size_are_told_apart_and_very_long_texts_read_whole(spark):
    """Many items of one size share half their shingles; the look-up decides which are near, the check confirms."""
    rnd = random.Random(9)
    head = [f"h{i}" for i in range(18)]
    items = [(j, " ".join(head + [f"x{j}y{i}" for i in range(18)])) for j in range(60)]
    docs = [(i, " ".join([f"p{rnd.randrange(999)}" for _ in range(30_000 if i == 3 else 20)] + items[3 * i][1].split()[:34] + ["end"] * 40)) for i in range(12)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.leaks(d, b).collect()}
    assert found == wanted(docs, items) and set(found) == {(i, 3 * i) for i in range(12)}
