"""The most and the least alike rows against a comparison of all with all."""

import random

import pytest
from pyspark.sql import functions as F

from gaugemill.operators import alike, pools


def plain(rows, cap, equal, differ, end, targets=None):
    out = {}
    for a in targets or rows:
        scored = []
        for b in rows:
            if b["id"] != a["id"] and all(a[c] == b[c] for c in equal) and all(a[c] != b[c] for c in differ):
                scored.append((20 * len(set(a["traits"]) & set(b["traits"])) + len(set(a["words"]) & set(b["words"])), b["id"]))
        if end == "most":
            scored.sort(key=lambda s: (-s[0], s[1]))
        else:
            scored.sort(reverse=end == "most_last")
        for i, (score, id_) in enumerate(scored[:cap]):
            out[a["id"], i + 1] = (id_, score)
    return out


def made(n, seed, words=40, hot=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        own = [f"h{j}" for j in range(hot) if rnd.random() < 0.8] + [f"w{int(words * rnd.random() ** 2)}" for _ in range(rnd.randint(0, 6))]
        rows.append({"id": f"c{i:04d}", "traits": [f"a{rnd.randint(0, 2)}", f"b{rnd.randint(0, 1)}"], "words": own, "g": "xy"[rnd.random() < 0.2], "v": rnd.choice([None, "p", "q"])})
    return rows


SCHEMA = "id string, traits array<string>, words array<string>, g string, v string"


@pytest.mark.parametrize("end", ["least", "most", "most_last"])
@pytest.mark.parametrize("equal,differ", [([], []), (["g"], ["v"])])
def test_equals_comparing_all(spark, monkeypatch, end, equal, differ):
    monkeypatch.setattr(alike, "LISTED", 4)
    monkeypatch.setattr(alike, "WHOLE", 40)
    monkeypatch.setattr(alike, "INDEXED", 2)
    monkeypatch.setattr(alike, "SIGNATURES", 12)
    rows = made(160, len(equal))
    table = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3)
    got = {(r.id, r["rank"]): (r.candidate, r.score) for r in alike.ranked(table, table, "id", 3, {20: "traits", 1: "words"}, equal, differ, end).collect()}
    assert got == plain(rows, 3, equal, differ, end)


def test_lists_longer_than_the_pool_nulls_repeats_and_empty_tables(spark):
    rows = [("a", ["x", "x"], ["w", None, "w"], "g", "v"), ("b", None, None, "g", "v"), ("c", ["x"], ["w"], None, None), ("a", ["x"], ["w"], "g", "v")]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id, r["rank"]): (r.candidate, r.score) for r in alike.ranked(table.where("id <> 'a'"), table, "id", 5, {20: "traits", 1: "words"}, end="most").collect()}
    assert got == {("b", 1): ("a", 0), ("b", 2): ("c", 0), ("c", 1): ("a", 21), ("c", 2): ("b", 0)}
    assert alike.ranked(table.limit(0), table, "id", 5, {1: "words"}).count() == 0
    assert alike.ranked(table, table.limit(0), "id", 5, {1: "words"}).count() == 0


def test_more_kinds_than_rows_of_a_list(spark):
    """Speakers is a number, so kinds grow with the clips: 5,000 here."""
    clips = spark.range(5000).select(F.format_string("c%05d", "id").alias("id"), F.col("id").alias("speakers"), (F.col("id") % 2 == 0).alias("is_talking"), F.lit("soft").alias("delivery"), F.lit("the same words").alias("caption"))
    got = pools.clips_by_score(clips, clips, 8)
    assert got.count() == 40_000 and got.where("score > 1.16").count() == 0
    first = [r.candidate for r in got.where("id = 'c00000'").orderBy("rank").collect()]
    assert first == [f"c{i:05d}" for i in range(1, 17, 2)]


def test_lists_are_bounded_where_a_token_is_everywhere(spark):
    """No join grows beyond lists of every signature: a word that all rows have pairs none of them."""
    rows = spark.range(3000).select(F.format_string("c%05d", "id").alias("id"), F.array(F.lit("the"), F.concat(F.lit("w"), (F.col("id") % 700).cast("string"))).alias("words"))
    shaped = alike._shaped(rows, "id", [], [], {1: "words"})
    assert alike._commonest(shaped) == ["1:the"]
    got = alike.ranked(rows, rows, "id", 8, {1: "words"}, end="most")
    assert got.where("score = 2").count() == sum(m * min(8, m - 1) for m in (5 if i < 200 else 4 for i in range(700)))


@pytest.mark.parametrize("end", ["least", "most", "most_last"])
def test_pieces_of_targets_and_pools_meet_in_blocks(spark, monkeypatch, end):
    """Pools of one block, of several and of a shared one; targets and rows under one id, and targets that repeat."""
    monkeypatch.setattr(alike, "BLOCK", 32)
    monkeypatch.setattr(alike, "TARGETS", 16)
    monkeypatch.setattr(alike, "SIGNATURES", 3)
    monkeypatch.setattr(alike, "INDEXED", 3)
    rows = made(150, 9)
    for i, r in enumerate(rows):
        r["g"] = "x" if i < 100 else f"g{i // 10}" if i < 140 else str(i)
    table = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3)
    twice = table.unionByName(table.where("id = 'c0001'"))
    found = alike.ranked(twice, twice, "id", 4, {20: "traits", 1: "words"}, ["g"], ["v"], end).collect()
    assert {(r.id, r["rank"]): (r.candidate, r.score) for r in found} == plain(rows, 4, ["g"], ["v"], end)
    assert len(found) == len(plain(rows, 4, ["g"], ["v"], end)) + 4


def test_scores_of_heavy_features_and_whole_number_ids(spark):
    rows = spark.range(60).select("id", F.array((F.col("id") % 2).cast("string"), F.lit("all")).alias("a"), F.array((F.col("id") % 30).cast("string")).alias("b"))
    got = {r.id: (r.candidate, r.score) for r in alike.ranked(rows, rows, "id", 1, {1000: "a", 1: "b"}, end="most").collect()}
    assert got == {i: ((i + 30) % 60, 2001) for i in range(60)}
