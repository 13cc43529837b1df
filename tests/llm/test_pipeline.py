"""The pipeline's stages, each judged on its own input."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from lorefold.llm import decontamination, mixing, toxicity
from lorefold.llm.common import materialise

from .test_operators import SMALL, brute_components, check_shards


def test_stages_equal_brute_force(spark, duck):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "decontamination", "mixing", "sharding"]
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(materialise(stage(spark, inputs[-1], SMALL), f"test-{name}"))
        if name != "sharding":
            assert inputs[-1].columns == docs.columns
    ids = [Counter(r.doc_id for r in x.select("doc_id").collect()) for x in inputs]

    net = toxicity.fit(toxicity.labelled(docs, spark.read.parquet(f"{SMALL}/labels.parquet")))
    assert set(ids[1]) == {r.doc_id for r in toxicity.score(docs, net).where("score < 0.3").collect()}

    rows = [(r.doc_id, r.text) for r in inputs[1].collect()]
    assert set(ids[2]) == {i for i, low in brute_components(rows, 5, 80, 100).items() if i == low}

    duck.register("stage_docs", inputs[2].select("doc_id", "text").toPandas())
    clean = duck.execute(f"with {decontamination.contamination_sql('stage_docs')} select doc_id from judged where not contaminated").fetchall()
    assert set(ids[3]) == {r[0] for r in clean}

    duck.register("mix_docs", inputs[3].select("doc_id", "text", "source").toPandas())
    copies = duck.execute(f"with docs as (select * from mix_docs), {mixing.SIZED_SQL} select doc_id, copies from mixed where copies > 0").fetchall()
    assert ids[4] == Counter(dict(copies))

    assert ids[5] == ids[4]
    check_shards(inputs[5].collect(), 8)
    assert corpus_pipeline.run(spark, SMALL).count() == sum(ids[5].values())


def test_stages_take_empty_and_odd_documents(spark, tmp_path):
    long = "a very long text of plain words " * 30_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some words", None, None, 10), (3, "some words", None, None, 10), (5, long, "en", "a", len(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("shard", F.lit("clash"))
    for few in (docs, docs.limit(0)):
        at = few
        for name, stage in corpus_pipeline.STAGES:
            at = materialise(stage(spark, at, SMALL), f"odd-{name}")
        assert at.columns == [*(c for c in few.columns if c != "shard"), "shard", "slot"]
        ids = Counter(r.doc_id for r in at.collect())
        assert set(ids) <= {1, 2, 3, 5} and ids[3] <= 3 and all(n <= 3 for n in ids.values())
        assert (5 in ids) == (few.count() > 0)
