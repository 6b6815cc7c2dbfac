import random

import corpus_pipeline

from .helpers import docs, odd_rows, words

BENCH = " ".join(words(random.Random(77), 30, 9999))


def write(spark, folder, rows, labels):
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(200):
        own = words(rng, rng.randrange(20, 60), 3000)
        if i % 4 == 0:
            own[3] = "vilest"
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(i % 4 == 0)))
    near = rows[1][1].split()
    rows += [(300, rows[1][1] + "\n"), (301, " ".join([*near, "more"])), (302, "a b c " + BENCH), *[(400 + (i or 0), t) for i, t in odd_rows()]]
    folder = str(tmp_path / "in")
    write(spark, folder, rows, labels)
    at, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, folder).write.parquet(str(tmp_path / str(n)))
        at = spark.read.parquet(str(tmp_path / str(n)))
        kept[name] = {r.doc_id for r in at.select("doc_id").collect()}
        if n < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == corpus_pipeline.COLUMNS
    civil = kept["toxicity"]
    assert sum(i % 4 == 0 and i < 200 for i in civil) < 8 and sum(i % 4 != 0 and i < 200 for i in civil) > 140
    assert not {1, 300} <= kept["exact dedup"] and (1 in civil) <= bool({1, 300} & kept["exact dedup"])
    assert len({1, 300, 301} & kept["n-gram Jaccard join"]) <= 1
    assert 302 not in kept["benchmark decontamination"]
    assert kept["mixing sources to target weights"] <= kept["benchmark decontamination"]


def test_run_on_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
