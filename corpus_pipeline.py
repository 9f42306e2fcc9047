"""The corpus pipeline: language ID, n-gram Jaccard join, mixing to target weights, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents (extra columns, whatever their names, travel along).
Null and empty texts have no language and go in the first stage, as do texts without a letter. Repeated rows with an id are one group of the second
stage: one of them stays, ties being equal rows; rows without an id stay all. A null source is a source of its own in the third and fourth stage.
Very long texts are judged whole and packed in pieces. Empty tables give empty results. ``run`` writes each stage's rows as Parquet into the shared folder and reads them again as the next stage's input; what a stage has read goes once it is written.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cohortlens.llm import common as C
from cohortlens.llm.language_id import fit, identify_languages
from cohortlens.llm.mixing import mix_sources
from cohortlens.llm.ngram_join import ngram_jaccard_join
from cohortlens.llm.packing import pack_documents

#: The least probability of the best language; documents below it are rejected, as are those without a letter.
LEAST_SCORE = 0.35
#: Ids of documents to drop are sent to every task up to this number; more are joined by shuffle.
MAX_BROADCAST = 500_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows: undetermined ones go."""
    net = fit(docs.select("doc_id", "lang", "text"))
    judged = identify_languages(docs, net, docs.columns)
    kept = judged if net is None else judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates; of repeated rows one. Rows without an id stay."""
    found = C.cut(ngram_jaccard_join(docs).where("doc_id IS NOT NULL AND n_shingles > 0"))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    small = gone.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    kept = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(docs.columns)
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files and rows within them follow it."""
    order = mix_sources(docs)
    return order.repartitionByRange(C.partitions(spark), "position").sortWithinPartitions("position").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents and pieces of documents, in the order of the files and of the rows within them: that of the mix. Rows that come from no file have no order: their ids' hashes give one."""
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    except AnalysisException:
        # rows that come from no file have no order
        return pack_documents(docs)
    files = C.cut(rows.groupBy("_file").count())
    before = files.select("_file", F.coalesce(F.sum("count").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(before) if files.count() <= MAX_BROADCAST else before, "_file")
    return pack_documents(placed, place=F.col("_before") + F.col("_index"))


STAGES = [("language_id", known_language), ("ngram_jaccard_join", one_of_each_group), ("mix_sources", mixed), ("pack", packed)]
#: SQL can express neither the network nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{C.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
        if k:
            C.remove(spark, f"{at}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
