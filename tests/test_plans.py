import io
import json
import math
import random
import sys
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugemill.functions import arrays as A, text as T
from gaugemill.operators import media, metrics as M, models, pools, sampling as S, scoring as P
from gaugemill.plans import bindings, packets, pipelines, suite_queries, suites, tasks
from gaugemill.plans.registry import Tables
from gaugemill.sources import readers, schema, writers
from gaugemill.streaming import scoring as streaming

SF = "/root/testdata/sf0.001"


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_arrays(spark):
    s = F.array(*map(F.lit, (0.5, 0.9, -0.0, 0.9)))
    none = F.array().cast("array<double>")
    r = one(spark, a=A.argmax(s), b=A.ranking(s), c=A.argmax(none), d=A.average_precision(F.array(*map(F.lit, (0, 1, 1)))), e=A.average_precision(F.array(F.lit(0))), f=A.with_rest(F.lit(2), F.lit(4)))
    assert (r.a, r.b, r.c, round(r.d, 6), r.e, r.f) == (1, [1, 3, 0, 2], 0, round((1 / 2 + 2 / 3) / 2, 6), 0.0, [2, 0, 1, 3])


def test_texts(spark):
    r = one(
        spark, a=T.slug(F.lit("  Ab--C d! ")), b=T.slug(F.lit("--")), c=T.video_id(F.lit("abc_640x480_full_video_3")), d=T.letters(F.lit("maybe B, then a"), ["A", "B", "C"]), e=T.four_decimals(F.lit(0.03125)),
        f=T.reply(F.lit('```json\n{"decision": "yes", "reason": "r"}\n```')), g=T.reply(F.lit("no json")), h=T.safe_event(F.lit(" "), F.lit("Dog  Bark")), i=T.speaker_mode(F.lit("a Dialogue and speech")),
        j=T.four_decimals(F.lit("n/a")), p=T.video_id(F.lit("abc_clip_3"), short=True), k=T.narration(F.lit(" ")), l=T.last_integer(F.lit("a12b7c")), m=T.first_integer(F.lit("x-5y6")),
        n=T.bullets([("Place", F.lit("N/A")), ("Noise", F.lit(None).cast("string"))]), o=T.row_context(F.lit(""), F.lit(" q ")),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == ("ab_c_d", "item", "abc", ["A", "B"], "0.0312")
    assert (r.f.decision, r.g.decision, r.g.reason, r.h, r.i) == ("yes", "unknown", "no json", "dog_bark", "multi_speaker")
    assert (r.j, r.p, r.k, r.l, r.m, r.n, r.o) == ("n/a", "abc", "None.", 7, -5, "- Noise: unknown", "q")


def leaves(spark, text, **how):
    return [r.leaf for r in T.string_leaves(spark.createDataFrame([(text,)], "json string"), "json", **how).orderBy("path").collect()]


def test_string_leaves_of_any_json(spark):
    assert leaves(spark, '{"a": ["x", {"b": "y"}], "c": 1, "d": "z"}') == ["x", "y", "z"]
    assert leaves(spark, '{"a:": "x", "b": "y"}') == ["x", "y"] and leaves(spark, '"top"') == ["top"] and leaves(spark, "not json") == []
    assert leaves(spark, '["q\\"uote", "\\u00e9", "back\\\\", ":"]') == ['q"uote', "é", "back\\", ":"]
    assert leaves(spark, '{"z": {"y" : ["1"]}, "a": "2"}') == ["1", "2"] and leaves(spark, "[" * 60 + '"deep"' + "]" * 60) == ["deep"]
    long = "x" * 300_000 + '\\"' * 50_000
    assert leaves(spark, f'{{"k": "{long}"}}') == ["x" * 300_000 + '"' * 50_000]


def test_bad_bytes_are_replaced(spark, tmp_path):
    (tmp_path / "one.json").write_bytes(b'{"a": "x\xffy", "b": 1}')
    (tmp_path / "two.json").write_bytes('{"a": "é", "b": 2}'.encode())
    got = {r.b: r.a for r in readers.lossy_json(spark, str(tmp_path), "a string, b long").collect()}
    assert got == {1: "x\ufffdy", 2: "é"}


def test_rows_keep_the_order_of_their_file(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"id": "{name}{i}"}}\n' for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.jsonl(spark, str(tmp_path), "id string")
        assert rows.rdd.getNumPartitions() > 4
        assert [r.id for r in rows.orderBy("file", "row_ord").collect()] == [f"{n}{i}" for n in "ab" for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_nested_documents_of_odd_shapes(spark):
    docs = [("1", '{"videos": [{"clip_uid": "c", "clips": [{"x": 1, "split": "s"}, 5]}, 7]}'), ("2", "[1]"), ("3", "no json"), ("4", '{"a": [{"y": 2}], "b": 3}'), ("5", '{"videos": []}'), ("6", None)]
    rows = readers.flattened(spark.createDataFrame([(k, d, "stem") for k, d in docs], "k string, d string, stem string"), "d", "stem")
    got = sorted((r.k, r.r, r.video_uid, r.split, r.scenario) for r in rows.select("k", F.to_json("record").alias("r"), "video_uid", "split", "scenario").collect())
    assert got == [("1", '{"split":"s","x":1}', "c", "s", "stem"), ("4", '{"y":2}', None, None, None)]


def test_files_are_found_by_name_head_and_part(spark):
    listing = spark.createDataFrame([(f"/m/{s}.wav", s) for s in ("abc9", "a-abc-1", "xclip7y", "exact", "exact2", "b_abc")], "path string, stem string")
    keys = spark.createDataFrame([("abc",), ("clip7",), ("exact",), ("none",), ("",), (None,)], "k string")
    assert {r.k: r.path for r in readers.resolved(keys, listing, "k", ".wav").collect()} == {"abc": "/m/abc9.wav", "clip7": "/m/xclip7y.wav", "exact": "/m/exact.wav"}


def test_pools_are_whole(spark):
    items = spark.createDataFrame([(1, "a_b", "a"), (2, "c_d", "c"), (3, "a_d", "a"), (4, "e", "e")], "id long, name string, grp string")
    near = {(r.id, r["rank"]): (r.candidate, r.score) for r in pools.top_similar(items, 9, 9, 1).collect()}
    assert [near[4, k] for k in (1, 2, 3)] == [(1, 0.0), (2, 0.0), (3, 0.0)] and [near[3, k] for k in (1, 2, 3)] == [(1, 3.0), (2, 1.0), (4, 0.0)] and len(near) == 12
    far = {(r.id, r["rank"]): r.candidate for r in pools.top_dissimilar(items, 9, 9, 1).collect()}
    assert [far[3, k] for k in (1, 2, 3)] == [4, 2, 1]
    many = spark.range(400).select(F.col("id"), F.format_string("n%d_x", F.col("id") % 200).alias("name"), F.lit("g").alias("grp")).unionByName(spark.createDataFrame([(900, "alone", "h")], "id long, name string, grp string"))
    assert pools.top_dissimilar(many, 3, 3, 1).groupBy("id").count().where("count = 3").count() == 401
    assert pools.cyclic_pairs(spark.range(5), "id", 1, 5).groupBy("id").agg(F.count_distinct("candidate").alias("n")).where("n = 4").count() == 5


def test_scoring_of_all_shapes(spark):
    rows = [
        ("r", P.RANKING_TASK, None, None, [1, 0, 2], None, None, ["x", "y", "z"], None, [1, 2, 0], None),
        ("e", "t", None, 0, None, None, ["p", "q"], None, [], None, 1),
        ("l", "t", "b", None, None, ["a", "b"], None, None, None, None, 1),
        ("o", "t", "b", None, None, ["a", "b"], None, None, None, None, 9),
        ("i", "t", None, 1, None, None, None, ["x", "y"], [0.1, 0.2], None, None),
    ]
    kinds = "id string, task_name string, gold_label string, gold_index bigint, gold_ranking array<bigint>, label_space array<string>, text_options array<string>, candidate_audio_paths array<string>, scores array<double>, predicted_ranking array<bigint>, predicted_index bigint"
    df = spark.createDataFrame(rows, kinds)
    got = {r.id: (r.gold_kind, r.primary_metric) for r in P.score(df).collect()}
    assert got == {"r": ("rank", 1.0), "e": ("index", 1.0), "l": ("label", 1.0), "o": ("label", 0.0), "i": ("index", 1.0)}
    assert {r.id: r.primary_metric for r in P.score(df, "use_index").collect()}["e"] == 0.0
    m = df.where("id = 'r'").select(*(v.alias(k) for k, v in P.ranking_metrics(F.col("gold_ranking"), F.col("predicted_ranking")).items())).first()
    want = (3 + 1 / math.log2(3) + 2 / 2) / (3 + 2 / math.log2(3) + 1 / 2)
    assert (m.primary_metric, m.exact_ranking_accuracy, m.mrr) == (1.0, 0.0, 1.0) and abs(m.ndcg - want) < 1e-12
    c = one(spark, c=P.choice(F.lit("B or C"), 2), d=P.choice(F.lit("?"), 3)).asDict(True)
    assert c["c"]["predicted_index"] == 1 and c["d"] == {"predicted_index": 0, "predicted_ranking": None}


def test_round_robin_equals_a_loop(spark):
    rnd = random.Random(1)
    rows = [(i, "t", rnd.choice("aaabbc")) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, task string, g string")
    for n in (1, 7, 30, 200):
        got = [r.g for r in S.round_robin(df, ["task"], "g", ["id"], 5, n).orderBy("pick").collect()]
        left = {g: sum(r[2] == g for r in rows) for g in "abc"}
        order, want = sorted(left, key=lambda g: (left[g], g)), []
        while len(want) < n and any(left.values()):
            for g in order:
                if left[g] and len(want) < n:
                    left[g] -= 1
                    want.append(g)
        assert got == want


def test_a_task_with_one_answer_fails_the_gate_and_mixed_arity_is_not_flipped(spark):
    rows = spark.range(40).select("id", F.lit("t").alias("task"), F.lit(0).cast("long").alias("gold"), F.lit(2).alias("n"))
    assert not M.gates(M.baselines(rows, ["task"], "id", "gold", "n", 4, 1)).first().passed
    mixed = spark.createDataFrame([("a", ["x", "y"], 0), ("a", ["x", "y", "z"], 1), ("b", ["x", "y"], 1)], "task string, options array<string>, gold bigint")
    assert [tuple(r) for r in S.binary_flip(mixed, ["task"], "options", "gold").collect()] == [("b", ["x", "y"], 0)]


def test_macro_f1_by_hand(spark):
    df = spark.createDataFrame([("k", g, p) for g, p in (("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"))], "k string, g string, p string")
    r = M.macro_f1(df, ["k"], "g", "p").first()
    assert abs(r.macro_f1 - (2 / 3 + 2 * (1 / 3) / (4 / 3) + 0) / 3) < 1e-12 and r.n_labels == 3


def test_builders_have_one_gold_and_distinct_options(spark):
    t = Tables(spark, SF)
    items, clips = bindings.src_items(t), bindings.clips(t)
    long = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("event"), (F.col("user_id") % 5).alias("scenario"), F.lit("unknown").alias("mode"), F.col("props").alias("text"), F.lit("x_y").alias("secondary"))
    made = [
        tasks.target_sound(items, 1), tasks.acoustic_contrast(items, 1), tasks.hard_negatives(items, 1), tasks.dyadic(clips, 1),
        tasks.continuation(clips, "speakers", "speaker_count_aware_continuation", 1), tasks.event_window(long, 1), tasks.event_retrieval(long, 1), tasks.narrative(long, 1), tasks.sequential(long, 1),
    ]
    for df in made:
        rows = df.collect()
        assert rows and len({r.id for r in rows}) == len(rows)
        for r in rows:
            assert 0 <= r.gold_index < len(r.options) and len(set(r.options)) == len(r.options) >= 2
    assert all(r.options[r.gold_index] == r.id for r in made[0].collect())
    held = tasks.turn_holding(clips, 1).collect()  # by the rule its wrong clip may be of the same video, even the right one
    assert held and all(len(r.options) == 2 and r.id not in r.options for r in held) and tasks.continuation(clips, "delivery", "d", 1).count() == 0
    ranked = tasks.plausibility_ranking(items, 1).collect()
    assert ranked and all(sorted(r.gold_ranking) == [0, 1, 2] and r.candidates[r.gold_ranking[0]] == r.id for r in ranked)
    assert tasks.foreground(items).count() == 3 * items.count()
    assert tasks.periodicity(items).count() == tasks.onset_sharpness(items).count() == items.count() and tasks.causal_order(items, 1).count() == items.count()
    assert tasks.coarse_order(long, 10, 1).where("gold_index = 0").count() == 10 and tasks.overlap(long).count() == 0


def test_suite_round_trip_evaluation_and_reports(spark, tmp_path):
    rows = [(f"i{k}", "cue", "b" if k % 3 else "a", ["a", "b"]) for k in range(30)]
    for tier in ("tier1", "tier2"):
        for task in ("task_1", "task_2"):
            d = tmp_path / tier / task
            d.mkdir(parents=True)
            lines = [json.dumps({"id": i, "task_name": n, "gold_label": g, "label_space": s}) for i, n, g, s in rows]
            (d / "all.jsonl").write_text("\n\n".join(lines) + "\n")
    suite = readers.suite(spark, str(tmp_path))
    assert suite.count() == 120 and {(r.tier, r.task_dir) for r in suite.select("tier", "task_dir").distinct().collect()} == {(a, b) for a in ("tier1", "tier2") for b in ("task_1", "task_2")}
    assert {tuple(r) for r in readers.task_names(suite.where("tier = 'tier1'")).collect()} == {("task_1", "cue", 30), ("task_2", "cue", 30)}
    scored = pipelines.evaluate(suite, lambda: lambda row: {"predicted_index": 1}).withColumn("row_ord", F.lit(0))
    assert all(abs(r.mean - 2 / 3) < 1e-9 and r.ci_low <= r.mean <= r.ci_high for r in pipelines.summary(scored, 50).collect())
    assert {r.level: round(r.mean, 6) for r in pipelines.tiers(scored).collect()} == {0: 0.666667, 1: 0.666667, 3: 0.666667, 9: 0.666667}
    same = pipelines.compare(scored, scored, 20).first()
    assert (same.observed_difference, same.p_value, same.hedges_g) == (0.0, 1.0, 0.0)
    table = pipelines.results_table(scored.select("tier", "task_dir").distinct(), spark.createDataFrame([("tier1", "task_1", "m2", 0.5), ("tier1", "task_1", "m1", 0.5)], "tier string, task_dir string, model string, score double"), ["m1", "m2"])
    text = writers.markdown(table, "Results")
    assert "| tier1 | task_1 | 0.5000 | 0.5000 | m1 | 0.5000 |" in text and "| tier2 | task_2 |  |  |  |  |" in text
    writers.jsonl(suite.select("id", "gold_label"), f"{tmp_path}/out")
    assert spark.read.schema("id string, gold_label string").json(f"{tmp_path}/out").count() == 120
    with pytest.raises(Exception):
        readers.jsonl(spark, _write(tmp_path / "bad.jsonl", '{"id": "a"}\nnot json\n'), schema.TASK_ROWS).collect()
    assert readers.or_empty(spark, f"{tmp_path}/none", schema.PREDICTIONS).count() == 0
    assert [tuple(r) for r in readers.label_csv(spark, _write(tmp_path / "l.csv", "id1, 5 ,dog bark,train,extra\nshort,row\n")).collect()] == [("id1", "5", "dog bark", "train")]
    writers.csv(table, f"{tmp_path}/csv", ["tier", "task_dir", "best_model"], quote_all=True)
    assert readers.csv(spark, f"{tmp_path}/csv", ["tier", "task_dir", "best_model"]).count() == 4


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_validated_subset_drops_what_never_passes(spark):
    rows = spark.range(600).select(F.col("id"), F.when(F.col("id") % 2 == 0, "good").otherwise("bad").alias("task_dir"), F.lit(2).alias("n_options"), F.when(F.col("id") % 2 == 0, (F.col("id") / 2).cast("long") % 2).otherwise(F.lit(0)).cast("long").alias("gold_index"))
    rows = rows.withColumn("gold_key", F.concat(F.lit("index:"), F.col("gold_index").cast("string")))
    kept, best = pipelines.validated_subset(rows, 100, 64, 2, 3, 4)
    assert {r.task_dir: r.passed for r in best.collect()} == {"good": True, "bad": False}
    assert {r.task_dir: r["count"] for r in kept.groupBy("task_dir").count().collect()} == {"good": [r["size"] for r in best.where("passed").collect()][0]}


def test_wav_features_and_edits(spark, tmp_path):
    rate, t = 16000, np.arange(16000) / 16000
    pulses = np.where((t * 4) % 1 < 0.05, 0.5, 0.0) * np.sign(np.sin(2 * np.pi * 440 * t))
    for name, x in (("silence", np.zeros(1600)), ("pulses", pulses)):
        (tmp_path / f"{name}.wav").write_bytes(media.encode(x, rate))
    with wave.open(str(tmp_path / "eight.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(b"\x80" * 80)
    files = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("name", F.regexp_extract("path", r"([^/]+)\.wav$", 1))
    got = {r.name: r.f for r in files.select("name", media.audio_features("content").alias("f")).collect()}
    assert got["eight"].error == "ValueError" and got["silence"].rms == 0 and got["pulses"].periodicity_score > 0.5 and abs(got["pulses"].duration_sec - 1) < 1e-9
    edits = files.where("name = 'pulses'").select(media.wav_seconds(media.joined(F.col("content"), F.col("content"), 0.5)).alias("j"), media.wav_seconds(media.trimmed(F.col("content"), 0.3)).alias("t"), media.wav_seconds(media.mixed(F.col("content"), F.col("content"), 1.0, 0.3)).alias("m")).first()
    assert (round(edits.j, 6), round(edits.t, 6), round(edits.m, 6)) == (1.25, 0.3, 1.0)
    stereo = io.BytesIO()
    with wave.open(stereo, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000), w.writeframes(np.array([[100, 300]] * 4, "<i2").tobytes())
    assert np.allclose(media.decode(stereo.getvalue())[0], 200 / 32768)


def test_native_backends(spark):
    schema = "id string, task_name string, prompt string, text_options array<string>, label_space array<string>, candidate_audio_paths array<string>, candidate_labels array<string>, query_features struct<rms:double,onset:double,periodicity:double>, candidate_features array<struct<rms:double,onset:double>>"
    rows = [
        ("a", "periodicity_aware_grounding", "hear", ["A repetitive one.", "A single one."], None, None, None, (0.1, 0.1, 0.9), None),
        ("b", "onset_sharpness_grounding", "hear", ["A diffuse one.", "A sharp one."], None, None, None, (0.1, 0.2, 0.0), None),
        ("c", "target", "dog bark", None, None, ["1", "2", "3"], ["cat", "dog bark", "rain"], None, [(0.1, 0.1)] * 3),
    ]
    table = spark.createDataFrame(rows, schema)
    got = {r.id: r for r in models.predict(table, models.backend("hybrid"), ["id"]).collect()}
    assert [got[k].predicted_index for k in "abc"] == [0, 1, 1] and abs(got["c"].scores[1] - 2.03) < 1e-9
    even = {r.id: r for r in models.predict(table, models.backend("random", seed=3), ["id"]).collect()}
    assert [len(even[k].scores) for k in "abc"] == [2, 2, 3] and all(0 <= x < 1 for r in even.values() for x in r.scores)
    assert all(r.predicted_index == r.scores.index(max(r.scores)) for r in even.values())


def test_models(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, prompt string")
    echo = [sys.executable, "-uc", "import sys,json\nfor l in sys.stdin: print(json.dumps({'predicted_index': len(json.loads(l)['id'])}))"]
    assert [r.predicted_index for r in models.predict(rows, models.backend("command", argv=echo), ["id"]).collect()] == [1, 1]
    with pytest.raises(ValueError):
        models.backend("none")
    r = one(spark, a=models.random_scores(F.lit(3), 1, F.lit("k")), b=models.cosine_scores(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))), c=models.heuristic_candidate_score(F.lit("dog bark"), F.lit("bark"), F.lit(0.5), F.lit(1.0)))
    assert len(set(r.a)) == 3 and r.b == [1.0, 0.0] and abs(r.c - (2 * 0.5 + 0.1 + 0.1)) < 1e-12


def test_stream_counts_a_prediction_once_and_adds_only_what_is_new(spark, tmp_path):
    line = lambda i, g, ts: json.dumps({"task_dir": "t", "id": i, "label_space": ["a", "b"], "gold_label": g, "predicted_index": 1, "ts": ts})
    (tmp_path / "in").mkdir()
    run = lambda: streaming.run_available(streaming.hourly(streaming.scored(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    (tmp_path / "in/1.json").write_text("\n".join([line("x", "b", "2026-01-01T00:10:00Z"), line("x", "b", "2026-01-01T00:10:00Z"), line("y", "a", "2026-01-01T00:20:00Z"), line("z", "b", "2026-01-01T05:00:00Z")]))
    run()
    (tmp_path / "in/2.json").write_text(line("w", "b", "2026-01-01T09:00:00Z"))
    run()
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("hour").collect()
    assert [(r.n, r["mean"]) for r in rows][:2] == [(2, 0.5), (1, 1.0)]


def test_suites_and_packets_are_written_whole(spark, tmp_path):
    t = Tables(spark, SF)
    clips = suite_queries.tier_2(t)
    kinds = ["speech_activity_grounding", "dyadic_matching"]
    rows = suites.second_tier(clips, 1, kinds)
    document = suites.write(rows, str(tmp_path / "suite"))
    index = document["task_index"]
    assert index["tier2/task_2_speech_activity_grounding"]["count"] == clips.count() and index["tier2/task_1_phonic_target_grounding"]["count"] == 0
    assert json.loads((tmp_path / "suite" / "metadata.json").read_text())["count"] == document["count"] == rows.count()
    sound = tmp_path / "a.wav"
    sound.write_bytes(b"sound")
    heard = rows.withColumn("query_audio_path", F.lit(str(sound))).withColumn("prompt_audio_path", F.lit(str(tmp_path / "none.wav")))
    picked = packets.chosen(heard, 2)
    packets.copy_assets(packets.assets(picked), str(tmp_path / "packet"))
    items = packets.items(picked).collect()
    assert len(items) == 4 and all((tmp_path / "packet" / r.item_dir / "query.wav").read_bytes() == b"sound" and not (tmp_path / "packet" / r.item_dir / "prompt.wav").exists() for r in items)
    packets.write(heard, str(tmp_path / "out"))
    shared = spark.read.json(str(tmp_path / "out" / "items"))
    assert shared.count() == 4 and not {"gold_index", "gold_label", "gold_ranking"} & set(shared.columns)
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "answer_key_private")).where("answer_key in ('1', '2')").count() == 4


def test_long_items_are_sampled_event_by_event(spark):
    rows = suite_queries.tier_3(Tables(spark, SF))
    made = suites.third_tier(rows, 1, 20, only=["event_window_grounding"])
    events = made.join(rows.select(F.concat(F.lit("t3-1-"), F.col("id").cast("string")).alias("id"), "event"), "id").groupBy("event").count().collect()
    assert sum(r["count"] for r in events) == 20 and max(r["count"] for r in events) - min(r["count"] for r in events) <= 1
