"""The pipeline's stages, each on what the one before it kept."""

import corpus_pipeline
from test_decontam import brute as contaminated
from test_simhash import expected

from sparkweave.llm import mixing, toxicity


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.dtypes, docs
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
    after = []
    for _, step in corpus_pipeline.STAGES:
        kept = step(spark, kept, folder)
        path = f"{corpus_pipeline.stage(kept, 'test').inputFiles()[0].rsplit('/', 1)[0]}"
        kept = spark.read.parquet(path)
        after.append(kept)
    assert all(df.dtypes == columns for df in after[:-1])
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    pairs = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]

    graded = toxicity.grade(docs, toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    assert ids(after[0]) == ids(graded.where("not rejected"))
    assert ids(after[1]) == sorted({c for *_, c in expected(pairs(after[0]))})
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {i for i, *_ in contaminated(pairs(after[1]), items)}
    assert ids(after[2]) == sorted(set(ids(after[1])) - hit)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(after[2]).collect()}
    assert ids(after[3]) == sorted(i for i, n in copies.items() for _ in range(n))
    assert ids(after[4]) == ids(after[3])
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(whole.drop("slot").collect()) == sorted(after[4].drop("slot").collect())


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
    assert docs.collect() == []


def test_nulls_and_more_columns(spark, folder):
    docs = spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS STRING) AS text, CAST(NULL AS STRING) AS lang, CAST(NULL AS STRING) AS source, CAST(NULL AS BIGINT) AS n_chars, 1 AS size, 'x' AS row FROM range(3) UNION ALL SELECT 5, 'some words of a text', 'en', 's', 20, 2, 'y'")
    for _, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, folder)
        assert after.dtypes == docs.dtypes
        docs = after
    assert {r["doc_id"] for r in docs.collect()} <= {5, None}
