"""A corpus pipeline of five of the training-data operators.

Stages take (spark, docs, sf_dir) and return a DataFrame; each one's rows are written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import common, decontaminate, kd_shards, mixing, near_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    Null and empty texts are scored like others; rows that repeat are judged each on its own;
    columns of any name pass through; an empty table stays empty.
    """
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model, row=True).filter("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id.

    Rows that repeat a doc_id are one document, of which the row of the smallest text stays
    (null first); what has no doc_id, and null and empty texts, stay; columns of any name pass
    through; an empty table stays empty.
    """
    found = near_dedup.near_duplicates(docs).filter("doc_id IS NOT NULL")
    fate = found.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).filter("NOT kept OR n > 1")
    fate = common.cut(fate)
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rest = rows.join(fate.select(F.col("doc_id").alias("__id")), "__id", "left_anti")
    twice = fate.filter("kept").select(F.col("doc_id").alias("__id"))
    if not twice.isEmpty():
        first = rows.join(twice, "__id").groupBy("__id").agg(F.min_by("__row", F.struct("__row.text", F.to_json("__row"))).alias("__row"))
        rest = rest.unionByName(first)
    return rest.select("__row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows that repeat a doc_id are one text and go together; what has no doc_id, and null and
    empty texts, stay; columns of any name pass through; an empty table stays empty.
    """
    gone = decontaminate.contaminated(docs, common.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__id"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Texts without words come with whole rounds of their source alone; repeated rows are taken
    each on its own; null sources are one source; columns of any name pass through; an empty table stays empty.
    """
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document; nulls, ties and repeated rows as the operator has them."""
    return kd_shards.shard_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_copies), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("sharding", shard)]

#: A trained classifier is not SQL; the tests check each stage on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is in the shared checkpoint folder.

    Once a stage's rows are written, those it read are removed; the last ones stay, as the
    result is read from them.
    """
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out.write.parquet(f"{folder}/{k}")
            out = spark.read.parquet(f"{folder}/{k}")
            if k:
                common.remove(spark, f"{folder}/{k - 1}")
        docs = out
    return docs
