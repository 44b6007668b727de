"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as a table read back from Parquet,
and returns the documents it keeps with their columns; the last returns packed
pieces. ``run`` writes the stages' tables to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from millrace.llm.common import packed, rows_with, small_batches, stored, text_of
from millrace.plans.registry import table
from millrace.scratch import new_dir, remove_scratch, scratch_scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 stay. The model learns from this stage's
    own documents and the table ``labels``; of repeated rows all stay or go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    # A row is known by its id and its text: ids may repeat.
    key = F.xxhash64("doc_id", text_of())
    with small_batches(spark):
        scored = model.score(docs.select(key.alias("key"), text_of().alias("text")))
        toxic = stored(scored.where("score >= 0.7").select("key").distinct(), "toxic")
    return rows_with(packed(docs, key=key), toxic, ["key"], "left_anti").select("own.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents joined by links the one with the smallest id
    stays. No id is larger than any other; of equal ids one row stays."""
    if not docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count():
        found = ngram_join.similar_documents(docs)
        gone = stored(found.where("component_id < doc_id").select("doc_id").distinct(), "near-copies")
        return rows_with(docs, gone, ["doc_id"], "left_anti").select(docs.columns)
    # Ids do not tell rows apart: each row gets a number, written with it once.
    rows = stored(packed(docs, row=F.monotonically_increasing_id()), "numbered-rows")
    groups = ngram_join.similar_documents(rows.select("row", "own.text"), id_column="row").select("row", "component_id")
    doc, sha = F.col("own.doc_id"), F.sha2(text_of("own.text"), 256)
    order = F.struct(doc.isNull().alias("no_id"), doc.alias("id"), sha.alias("sha"), F.col("row"))
    tied = stored(groups.join(rows.select("row", order.alias("at")), "row"), "near-groups")
    stays = tied.groupBy("component_id").agg(F.min("at")["row"].alias("row"))
    return rows_with(rows, stored(stays.select("row"), "near-stay"), ["row"]).select("own.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of a mixture of 80 % of all tokens. One epoch only: copies
    were just removed, so sources that are short give way to their siblings."""
    return mixing.mixed_documents(docs, share=0.8, max_epochs=1)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Boosted trees and best-fit packing can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep. A stage's scratch
    tables go when its result is written, its input when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_scope(spark) as keep:
            path = new_dir(spark, "pipeline-" + name.replace(" ", "-"))
            stage(spark, docs, sf_dir).write.parquet(path)
            keep.append(path)
        if before:
            remove_scratch(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
