"""A corpus from raw documents to packed training sequences, as stages that are each written before the next reads.

Every stage works on all that the one before it kept, and all but the last return the columns of documents. Rows are told
apart by a key of their own, so null and repeated ids are judged row by row; null texts go at language ID, as they have no language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import decontaminate, jaccard, langid, packing, toxicity
from logspark.llm.common import keep_rows, keyed, materialize, table, without
from logspark.llm.queries import language_rows, tokenizer_path, toxicity_labels

#: A document goes if its most likely language is less likely than this.
LEAST_LANGUAGE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    model = toxicity.fit(docs, toxicity_labels(spark, sf_dir))

    def clean(texts: list) -> list[bool]:
        return [v < 0.5 for v, _, _ in toxicity.score_texts(texts, model)]

    return keep_rows(docs, clean, toxicity.__name__)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is told with some confidence."""
    model = langid.fit(language_rows(docs))

    def known(texts: list) -> list[bool]:
        return [lang != langid.UNDETERMINED and score >= LEAST_LANGUAGE for lang, score in map(model.predict, texts)]

    return keep_rows(docs, known, langid.__name__)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, one row: the one of the smallest doc_id, a null id last."""
    rows, key = keyed(docs)
    found = materialize(jaccard.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).where("links > 0").select(F.col("doc_id").alias(key), "class_id"), "copies")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key)
    # Copies are joined to their ids first, so a class's rows are only ids and are counted down before they meet.
    first = found.join(rows.select(key, "doc_id"), key).groupBy("class_id").agg(F.min(order)[key].alias("kept"))
    return without(rows, found.join(first.select(F.col("kept").alias(key)), key, "left_anti"), key).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows, key = keyed(docs)
    leaking = decontaminate.leaks(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, leaking.withColumnRenamed("doc_id", key), key).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_each_class),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
#: SQL can express none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
