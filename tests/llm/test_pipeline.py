import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugemill.llm import toxicity

from . import brute
from .test_decontaminate import wanted

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('p')}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_do_their_work_on_what_came_before(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_dedup", "decontamination", "pii", "packing"]
    assert all(after.columns == columns for _, after in stages[:4])
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    before, after = map(rows, stages[0])
    chain = toxicity.fit(stages[0][0], spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(stages[0][0], chain).where("score >= 0.7").collect()}
    assert toxic and {i for i, _ in before} - {i for i, _ in after} == toxic
    before, after = map(rows, stages[1])
    assert {i for i, _ in after} == {i for i, (_, c) in brute.near(before).items() if i == c}
    before, after = map(rows, stages[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {i for i, _ in before} - {i for i, _ in after} == {i for i, _ in wanted(before, items)}
    before, after = map(rows, stages[3])
    after = dict(after)
    assert len(after) == len(before) and not any(brute.private(t) for t in after.values())
    assert all(after[i] == t for i, t in before if not brute.private(t) and not re.search(r"[0-9]{3}", t))
    assert stages[4][1].count() == stages[4][0].count()


def test_run_gives_the_rows_of_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).exceptAll(stages[4][1]).isEmpty()


def test_odd_rows_and_extra_columns_pass_through(spark, tmp_path):
    rows = [(1, None, "en", "s", 0, 5.0), (2, "", "en", "s", 0, 5.0), (None, "some text of five words here", None, None, None, None), (4, "w " * 100_000, "en", "s", 1, 5.0), (4, "w " * 100_000, "en", "s", 1, 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.where(F.lit(False))):
        got = start
        for _, stage in corpus_pipeline.STAGES[:4]:
            got = stage(spark, got, str(tmp_path))
            assert got.columns == docs.columns
        assert got.exceptAll(start).isEmpty() and start.exceptAll(got).isEmpty()
        assert corpus_pipeline.pack(spark, got, str(tmp_path)).count() == start.count()


def test_score_takes_no_part_of_held_out_labels():
    assert toxicity.train(["bad word"], [True]).score.__self__.calibration[0] > 0
