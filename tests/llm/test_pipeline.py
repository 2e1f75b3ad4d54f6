"""The pipeline's stages, each against a direct computation on what it was given, and the queries that SQL expresses."""

import itertools
import os

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from logspark.llm import decontaminate, jaccard, langid, queries, toxicity
from logspark.llm.common import materialize, ngram_set

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), name)
        assert out.columns == columns
        kept.append((name, docs, out))
        docs = out
    (_, a, b), (_, c, d), (_, e, f), (_, g, h) = kept
    model = toxicity.fit(a, queries.toxicity_labels(spark, SF))
    assert ids(b) == ids(toxicity.score(a, model).where("predicted = 0"))
    told = langid.predict(c, langid.fit(queries.language_rows(c)))
    assert ids(d) == ids(told.where(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_LANGUAGE}"))
    assert ids(f) == {r["class_id"] for r in jaccard.near_duplicates(e).collect()}
    assert ids(h) == ids(g) - ids(decontaminate.leaks(g, spark.read.parquet(f"{SF}/benchmark.parquet")))
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert ids(packed) == ids(docs)


def test_rows_with_null_and_repeated_ids(spark):
    text = "the small brown bird sings every morning on the fence beside the long green garden"
    other = "nobody in the old harbour town remembers when the last of the grey ferries left for the islands"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first()["text"]
    rows = [(5, text, "a"), (5, text, "b"), (None, text, "c"), (4, text, "d"), (None, other, "e"), (None, other, "f"), (7, item, "g"), (7, other + " so they say", "h"), (None, item, "i"), (8, None, "j"), (None, None, "k"), (5, "one more text that is quite unlike the others here", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources = lambda df: {r["source"] for r in df.collect()}
    once = corpus_pipeline.keep_one_of_each_class(spark, docs, SF)
    got = sources(once)
    assert once.columns == docs.columns and got == {"d", "g", "h", "j", "k", "l"}
    assert sources(corpus_pipeline.drop_leaks(spark, docs, SF)) == set("abcdefhjkl")


def folder(spark, tmp_path, docs):
    """Tables as the queries read them, with other documents."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_run_on_awkward_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "empty", docs.where("false"))).count() == 0
    some = docs.where("doc_id < 60")
    awkward = some.unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(some).unionByName(some.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(some.limit(3).withColumn("text", F.lit("")))
    awkward = awkward.withColumn("row_key", F.lit("clash")).withColumn("class_id", F.lit(1))
    got = corpus_pipeline.run(spark, folder(spark, tmp_path / "awkward", awkward)).collect()
    # Of each text one row stays, that with an id; and none is empty.
    ids = [r["doc_id"] for r in got if r["piece"] == 0]
    assert ids and None not in ids and len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in some.collect()}


def test_near_duplicates_stage_equals_brute_force(spark):
    """Components of all pairs of texts whose n-gram sets are similar; of each the smallest id stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], frozenset(ngram_set(r["text"]).tolist())) for r in docs.collect()]
    root = {i: i for i, _ in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a and len(a & b) >= 0.8 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_each_class(spark, docs, SF).collect()} == {find(i) for i, _ in rows}


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) == []
