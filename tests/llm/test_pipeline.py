from pyspark.sql import functions as F

import corpus_pipeline
from axisloom.llm import quality, secrets
from tests.llm.helpers import SF, awkward, documents, empty
from tests.llm.test_simhash import exact_classes


def test_stages_do_what_their_operators_decide(spark, tmp_path):
    docs, kept = documents(spark), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        kept.append(docs)
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "sentencepiece":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    start, good, single, clean, mix = kept
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    model = quality.train(start, labels, learn_from=~quality.held_out())
    assert ids(good) == {r["doc_id"] for r in quality.scores(start, model).collect() if r["score"] >= 0.3}
    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    root, _ = exact_classes(rows)
    assert ids(single) == {rows[i][0] for i, r in enumerate(root) if i == r}
    assert ids(clean) == ids(single)
    assert all(not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in clean.collect())
    assert ids(mix) == ids(clean)
    assert mix.count() >= clean.count()
    assert docs.count() == mix.count()
    assert {n for n, _ in corpus_pipeline.STAGES} == {"quality", "near_duplicates", "secrets", "mixing", "sentencepiece"}


def test_stages_take_awkward_rows_and_empty_tables(spark):
    extra = awkward(spark).select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"), "score", "text_hash", "fp")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, extra, SF)
        assert stage(spark, empty(spark), SF).count() == 0
        if name == "sentencepiece":
            assert got.count() == 11
            continue
        assert got.columns == list(corpus_pipeline.COLUMNS)
        ids = sorted((r["doc_id"] or 0 for r in got.select("doc_id").collect()))
        if name == "near_duplicates":
            assert ids == [0, 1, 3, 7, 8, 9, 10]
        if name == "secrets":
            assert ids == [0, 1, 2, 2, 3, 4, 5, 7, 8, 9, 10]
        if name == "mixing":
            assert set(ids) == {0, 1, 2, 3, 4, 5, 7, 8, 9, 10}


def test_run_applies_the_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
