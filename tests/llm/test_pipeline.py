"""Each stage against what its operator says of the stage's input."""

import corpus_pipeline as pipeline
from tests.conftest import MEDIUM
from tests.llm.test_neardup import brute as components
from tests.llm.test_tokens import check_pieces
from tidemark.llm import decontaminate, pii, quality_cnn
from tidemark.llm.tables import documents, table
from tidemark.session import materialize


def texts(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near duplicates", "benchmark leaks", "personal data", "packing"]
    seen = [documents(spark, MEDIUM)]
    for name, stage in pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], MEDIUM), name.replace(" ", "-")))
    docs, good, single, clean, safe, pieces = seen
    for kept in (good, single, clean, safe):
        assert kept.columns == docs.columns
    net = quality_cnn.train(docs, table(spark, MEDIUM, "labels"))
    told = {r.doc_id for r in quality_cnn.quality_scores(docs, net).where("predicted = 1").collect()}
    assert {i for i, _ in texts(good)} == told and 0 < len(told) < docs.count()
    short = [(i, t) for i, t in texts(good) if len(t) < 4000]
    alone = {i for i, _, top, _ in components(short, 5) if i == top}
    left = {i for i, _ in texts(single)}
    # among the short texts alone, a component can only be smaller than among all
    assert {i for i, _ in short} - left >= {i for i, _ in short} - alone
    leaks = {r.doc_id for r in decontaminate.find_leaks(single, table(spark, MEDIUM, "benchmark")).collect()}
    assert {i for i, _ in texts(clean)} == left - leaks
    assert {i for i, _ in texts(safe)} == {i for i, _ in texts(clean)}
    for _, text in texts(safe):
        assert not [s for s in pii.base_spans(text) if s[0] in ("email", "ip", "phone")]
    assert all(r.n_chars == len(r.text) for r in safe.collect())
    check_pieces(pieces.collect(), texts(safe), 16)


def test_awkward(spark, docs, no_docs, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "none of these words is there to be found at all in any text")], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for table_ in (docs, no_docs):
        now = table_
        for name, stage in pipeline.STAGES[:-1]:
            now = materialize(stage(spark, now, str(tmp_path)), name.replace(" ", "-"))
            assert now.columns == docs.columns
        assert (pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() > 0) == (now.count() > 0)
