"""From raw documents to packed sequences: quality, line dedup, near-duplicate documents, packing.

Each stage takes and returns rows with the columns of ``documents``, of whatever other names; only
packing returns pieces. Rows, not ids, are judged: repeated and null ids are no special case. An
empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm import linededup, packing, quality, setjoin
from docloom.llm.common import fresh_path, release, remove, stored


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that are not held out, does not reject.

    Null and empty texts are scored as texts without words, whole texts of any length are read,
    repeated rows score alike, and without a usable label every row scores 0.5 and stays.
    """
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(docs, model, threshold=0.3, keep_columns=True, score_name="docloom_score", predicted_name="docloom_predicted")
    return scored.where("docloom_predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an equal or near line precedes; texts without any other line go.

    Null and empty texts stay, rows that repeat id and text count as one document, ties go to the
    smaller id, then the earlier line, and a null id comes first.
    """
    return linededup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component at a Jaccard similarity of 0.8 over five-word shingles, that of the smallest id.

    Rows are told apart by a hash of id and text, so rows that share an id are judged each by its
    text. A null id comes last; of rows with equal id and text the smallest stays. Rows without a
    word, null texts among them, all stay.
    """
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("doc"), F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    found = setjoin.jaccard_components(rows.select(F.col("key").alias("doc_id"), "text"), n=5, least=80, of=100)
    found = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component"), F.count(F.lit(1)).alias("copies"))
    found = stored(found, "row-components")
    grouped = found.where("component <> key").select("component").distinct()
    shared = found.join(grouped, "component", "left_semi")
    ids = rows.select("key", "doc_id").join(shared, "key").dropDuplicates(["key"])
    first = F.row_number().over(Window.partitionBy("component").orderBy(F.col("doc_id").asc_nulls_last(), "key")) == 1
    gone = ids.select("key", F.when(first, F.col("copies")).otherwise(0).alias("copies")).where("copies <> 1")
    alone = found.where("copies > 1").join(grouped, "component", "left_anti").select("key", "copies")
    judged = stored(gone.unionByName(alone), "near-duplicates")
    release(found)
    left = rows.join(judged, "key", "left_anti").select("doc.*")
    repeated = judged.where("copies > 1")
    if repeated.isEmpty():
        return left
    once = rows.join(repeated, "key", "left_semi").groupBy("key").agg(F.min("doc").alias("doc"))
    return left.unionByName(once.select("doc.*"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a null or empty text is the end id alone, repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("best-fit packing", pack_sequences),
]

#: Neither the classifier nor the tokenizer can be put in SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's result is written as Parquet and read again, then its input goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
