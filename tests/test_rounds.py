"""What is made in rounds or as it arrives, against plain loops, and its odd cases."""

import json

import pytest
from pyspark.sql import functions as F

from gaugemill.operators import media, sampling as S
from gaugemill.functions import prompts
from gaugemill.plans import packets, suites
from gaugemill.sources import loaders, readers, writers
from gaugemill.streaming import scoring


def test_failures_use_up_no_quota(spark):
    bad = {"a": lambda i: i % 4, "b": lambda i: True, "c": lambda i: False, "d": lambda i: i < 37, "e": lambda i: i > 1}
    rows = [(g, i, (i * 7) % 50) for g, n in (("a", 50), ("b", 23), ("c", 50), ("d", 40), ("e", 2)) for i in range(n)]
    fails = [(g, i) for g, i, _ in rows if bad[g](i)]
    asked = []

    def attempt(df):
        asked.append(df.count())
        return df.join(spark.createDataFrame(fails, "g string, i int").withColumn("error", F.lit("x")), ["g", "i"], "left")

    done, failed = S.filled(spark.createDataFrame(rows, "g string, i int, p int"), ["g"], [-F.col("p"), F.col("i")], 5, attempt)
    good, lost = set(), set()
    for g in "abcde":
        n = 0
        for _, i, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            if n < 5 and bad[g](i):
                lost.add((g, i))
            elif n < 5:
                n += 1
                good.add((g, i, n))
    assert {(r.g, r.i, r.ordinal) for r in done.collect()} == good
    assert {(r.g, r.i) for r in failed.collect()} == lost and {r.error for r in failed.collect()} == {"x"}
    assert sum(asked) <= 2 * (len(good) + len(lost)) + 5 * 5
    none, of = S.filled(spark.createDataFrame([], "g string, i int, p int"), ["g"], [F.col("i")], 5, attempt)
    assert none.count() == of.count() == 0


def test_entries_of_any_shape(spark):
    lists = ['["a", 3, null, true, [1], {"yt_id": 2.5, "clip": true}]', '[{"video_id": false, "video_name": "v", "name": ""}, {"youtube_id": "y", "clip_name": 0}]', "no json", "[]", None, '"text"', '[{"youtube_id": ["y"], "clip": "c"}]']
    rows = spark.createDataFrame(list(enumerate(lists)), "n int, j string")
    assert sorted(map(tuple, readers.list_entries(rows, "j").collect())) == [(0, 0, "a", "a"), (0, 5, "2.5", "True"), (1, 0, "v", "v")]
    named = spark.createDataFrame([("all", '["x", {"video_name": "y"}]'), ("sft", '["y", 7]'), ("benchmark", "{}")], "name string, j string")
    members = readers.membership_lists(named, "name", "j")
    items = spark.createDataFrame([("x",), ("y",), ("7",), ("z",)], "clip_name string")
    assert {r.clip_name: r.split for r in readers.split_membership(items, "clip_name", members).collect()} == {"x": "all", "y": "sft", "7": "sft", "z": "unassigned"}


def test_streamed_means_follow_the_last_line_in_any_order(spark, tmp_path):
    line = lambda i, guess, hour: json.dumps({"task_dir": "t", "id": i, "label_space": ["a", "b"], "gold_label": "b", "predicted_index": guess, "ts": f"2026-01-01T{hour:02d}:00:00Z"})
    lots = [[line("x", 1, 5), line("y", 0, 1), line("y", 1, 2), line("n", None, 1)], [line("x", 0, 4), line("y", 0, 2), line(None, 1, 3)], [line("y", 0, 3), line("z", 1, 1), line("x", 1, 5)]]
    for order in ((0, 1, 2), (2, 0, 1)):
        root = tmp_path / "".join(map(str, order))
        (root / "in").mkdir(parents=True)
        for k in order:
            (root / f"in/{k}.json").write_text("\n".join(lots[k]))
            scoring.run_available(scoring.revisions(scoring.scored(spark, f"{root}/in")), f"{root}/out", f"{root}/state").awaitTermination(120)
        r = scoring.means(spark, f"{root}/out").collect()
        assert [(x.task_dir, x.n, x["mean"]) for x in r] == [("t", 4, 0.5)]


def test_lines_of_one_time_and_guess_make_no_difference_by_their_order(spark, tmp_path):
    """Nor do they need Python or state: one key's lines were a call each before."""
    line = lambda gold: json.dumps({"task_dir": "t", "id": "x", "label_space": ["a", "b"], "gold_label": gold, "predicted_index": 1, "ts": "2026-01-01T00:00:00Z"})
    for order in ("ab", "ba"):
        root = tmp_path / order
        (root / "in").mkdir(parents=True)
        for gold in order:
            (root / f"in/{gold}.json").write_text(line(gold))
            scoring.run_available(scoring.revisions(scoring.scored(spark, f"{root}/in")), f"{root}/out", f"{root}/state").awaitTermination(120)
        assert [(r.n, r["mean"]) for r in scoring.means(spark, f"{root}/out").collect()] == [(1, 1.0)]
        assert not (root / "state/state").exists()


def test_a_log_holds_a_repeated_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = json.dumps({"task_dir": "t", "id": "x", "label_space": ["a"], "gold_label": "a", "predicted_index": 0, "ts": "2026-01-01T00:00:00Z"})
    (tmp_path / "in/1.json").write_text(line)
    run = lambda: scoring.append_once(scoring.scored(spark, f"{tmp_path}/in"), f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination(120)
    run()
    commits = tmp_path / "state/commits"
    for f in commits.iterdir():  # as if the run had been lost between its output and its commit
        f.unlink()
    run()
    run()
    assert spark.read.json(f"{tmp_path}/log").count() == 1


def test_renderings_are_made_once_and_errors_are_told(spark, tmp_path):
    array = lambda *v: F.array(*map(F.lit, v))
    one = spark.range(1)
    sound = lambda path, rate, *v: one.select(F.lit(path).alias("path"), media.wav(array(*v), F.lit(rate)).alias("content"))
    sounds = sound("p", 10, 1000, -1000, 500).unionByName(sound("q", 10, 2000, 30000)).unionByName(sound("r", 20, 1)).unionByName(one.select(F.lit("bad").alias("path"), F.lit(b"x").alias("content"))).unionByName(sound("q", 10, 2000, 30000))
    schema = "path string, how string, first string, second string, volume_first double, volume_second double, seconds double, gap double"
    jobs = [("mix", "mix", "p", "q", None, 2.0, None, None), ("join", "join", "p", "q", None, None, 0.1, 0.2), ("join", "join", "p", "q", None, None, 0.1, 0.2), ("trim", "trim", "q", None, None, None, 0.1, None), ("none", "mix", "p", "away", None, None, None, None), ("rates", "mix", "p", "r", None, None, None, None), ("broken", "trim", "bad", None, None, None, None, None), ("kind", "loop", "p", "q", None, None, None, None)]
    asked = spark.createDataFrame(jobs, schema)
    made = {r.path: r for r in media.rendered(asked, sounds).collect()}
    samples = lambda name: [round(x * 32768) for x in media.decode(bytes(made[name].content))[0]]
    assert (samples("mix"), samples("join"), samples("trim")) == ([5000, 32767, 500], [1000, 0, 0, 2000], [2000])
    assert {k: r.error for k, r in made.items() if r.content is None} == {"none": "FileNotFoundError", "rates": "ValueError", "broken": made["broken"].error, "kind": "ValueError"} and made["broken"].error
    out = f"{tmp_path}/out"
    media.render(asked.where("how = 'trim'"), sounds, out)
    media.render(asked, sounds, out)
    media.render(asked, sounds, out)
    assert sorted(r.path for r in spark.read.parquet(out).select("path").collect()) == ["join", "mix", "trim"]


@pytest.mark.parametrize("hot", [False, True])
def test_cue_packets_keep_answers_apart(spark, tmp_path, hot):
    said = [("acknowledgment_cue_detection", "short_acknowledgment", "ok yes", 15.0, 1.0, None, i) for i in range(9)]
    said += [("explicit_repair_cue_detection", "explicit_repair_cue", "pardon me, say that once more", 15.0, None, 1.0, i) for i in range(20, 400 if hot else 23)]
    said += [("explicit_repair_cue_detection", "other", "x", 15.0, 1.0, 1.0, 30), ("unknown", "x", "x", 15.0, 1.0, 1.0, 31), ("acknowledgment_cue_detection", "short_acknowledgment", " ", 15.0, 9.0, 9.0, 32), ("acknowledgment_cue_detection", None, "yes", 15.0, 9.0, 9.0, 33), ("acknowledgment_cue_detection", "short_acknowledgment", None, 15.0, 9.0, 9.0, 34)]
    rows = spark.createDataFrame(said, "task_name string, label string, text string, seconds double, dover_score double, clear_score double, source_item_id long")
    packet = packets.cue_packet(rows, lambda df: df.withColumn("error", F.when((F.col("source_item_id") == 2) | F.col("source_item_id").between(21, 300), "gone")))
    answers = {r.item_id: r.source_item_id for r in packet["answers"].collect()}
    assert [answers[f"acknowledgment_cue_detection_short_acknowledgment_{i:02d}"] for i in range(1, 7)] == [0, 1, 3, 4, 5, 6]
    assert len(answers) == (12 if hot else 7) and packet["failures"].count() == (281 if hot else 3)
    packets.write_cue_packet(packet, str(tmp_path))
    shared = "".join(f.read_text() for f in (tmp_path / "share").rglob("*") if f.is_file() and f.suffix in (".json", ".csv"))
    assert "pardon me" not in shared and "gold_label" not in shared and "acknowledgment_01" in shared
    assert set(readers.csv(spark, f"{tmp_path}/answer_key_private", ["gold_label"]).toPandas()["gold_label"]) == {"short_acknowledgment", "explicit_repair_cue"}


def test_copies_of_tasks_keep_their_metadata(spark, tmp_path):
    for tier, task, n, meta in (("tier1", "task_1_a", 3, '{"seed": 7, "count": 99}'), ("tier1", "task_2_b", 2, None), ("tier2", "task_1_a", 1, "{}")):
        folder = tmp_path / "suite" / tier / task
        folder.mkdir(parents=True)
        (folder / "all.jsonl").write_text("\n".join(json.dumps({"id": f"{task}-{i}", "task_name": task}) for i in range(n)))
        if meta:
            (folder / "metadata.json").write_text(meta)
    root, out = f"{tmp_path}/suite", tmp_path / "out"
    wanted = spark.createDataFrame([("tier1", "task_1_a"), ("tier1", "task_2_b"), ("tier9", "task_1_a")], "tier string, task_dir string")
    assert suites.copy_tasks(spark, root, wanted, str(out)) == {"tier1/task_1_a": 3, "tier1/task_2_b": 2}
    told = lambda task: json.loads((out / f"metadata/{task}.json").read_text())
    assert told("tier1/task_1_a") == {"seed": 7, "count": 3, "selected_from": f"{root}/tier1/task_1_a"} and told("tier1/task_2_b")["count"] == 2
    assert {(r.tier, r.task_dir, r.id) for r in readers.suite(spark, f"{out}/rows", "*.json").collect()} == {("tier1", t, f"{t}-{i}") for t, n in (("task_1_a", 3), ("task_2_b", 2)) for i in range(n)}


def test_manifests_count_what_they_hold(spark, tmp_path):
    rows = spark.createDataFrame([("a", "sft", 1), ("b", "sft", 2), ("c", "all", 3)], "clip_name string, split string, speakers int")
    counts = loaders.manifest_counts(rows, ["split"], {"multi_speaker_count": F.col("speakers") > 1})
    lost = spark.createDataFrame([("d", "gone")], "clip_name string, error string")
    document = writers.manifest(rows, f"{tmp_path}/m", "clips", counts, lost)
    assert (document["count"], document["split"], document["multi_speaker_count"], document["audio_extraction_failures"]) == (3, {"sft": 2, "all": 1}, 2, 1)
    assert json.loads((tmp_path / "m/metadata.json").read_text()) == document and spark.read.json(f"{tmp_path}/m/manifest").count() == 3
    empty = writers.manifest(rows.limit(0), f"{tmp_path}/e", "clips", loaders.manifest_counts(rows.limit(0), ["split"], {}))
    assert (empty["count"], empty["audio_extraction_failures"]) == (0, 0)


def test_sheets_of_instructions_and_prompts(spark):
    rows = spark.createDataFrame([("t2", "dyadic_matching"), ("t1", "dyadic_matching"), ("t1", "own")], "tier string, task_name string")
    sheets = {r.task_name: r.text for r in packets.instructions(rows).collect()}
    assert sheets["dyadic_matching"].startswith(f"# dyadic_matching\n\nTier: `t1`\n\n{packets.GUIDANCE['dyadic_matching']}\n") and packets.OTHER_GUIDANCE in sheets["own"]
    r = spark.range(1).select(prompts.prompt(F.lit(None).cast("string"), "speak").alias("a"), prompts.prompt(F.lit("tool_call"), "decide", F.lit("- 100 %s")).alias("b"), prompts.diagnosis(F.lit(None).cast("string"), F.lit("t")).alias("c")).first()
    assert prompts.QUESTIONS["speak"][2] in r.a and "metadata:\n" not in r.a
    assert "\nPhysical grounding metadata:\n- 100 %s\n" in r.b and prompts.QUESTIONS["decide"][1] in r.b
    assert "task context:\n\n\nKnown transcript from the dataset, for reference only:\nt\n" in r.c
    bare = spark.createDataFrame([(None, None, None)], "task string, id string, meta map<string,string>").select(prompts.categories(prompts.contrast_rules()).alias("x"), prompts.categories(prompts.demo_rules()).alias("y")).first()
    assert (bare.x, bare.y) == ([], [])
