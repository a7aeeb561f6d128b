"""From raw documents to encoded training text, stage by stage.

Each stage is a function of (spark, docs, sf_dir). All but the last return the
columns of ``documents``; a stage's decisions are the rows that it keeps and, for
the mixture, their order. A reader may take files in any order, so the last stage
also gives each row's position, from its file's and its own place: sorting by it
gives the mixture. ``run`` writes each stage as Parquet and reads it back
for the next, in the folder that the cluster shares.

Every stage takes nulls in any column, empty and very long texts, repeated rows,
tables without rows, and input with further columns (they go). Stages read columns by
their names only; what the scores say of null and empty texts is in quality.py and
toxicity.py.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm import checkpoints, dedup, mixing, queries

#: Target weights of the sources; one without a weight here gets their mean.
WEIGHTS: dict[str | None, float] = {"src0": 4.0} | {f"src{i}": 1.0 for i in range(1, 20)}

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A document goes if its score is under this (quality) or at least this (toxicity).
QUALITY, TOXIC = 0.7, 0.5
#: Near duplicates share so many percent of their shingles.
SIMILAR = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Null and empty texts get the score of no words, so all of them go or all stay;
    without labels of both kinds every score is the share of label 1 (0.5 without any).
    """
    scored = queries.quality_scores(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))
    return scored.filter(F.col("score") >= QUALITY).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity scores reject; labelled texts teach whether or not they came so far.

    Null and empty texts score 0 and stay.
    """
    labelled = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = queries.toxicity_scores(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"), labelled)
    return scored.filter(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates; rows without an id all stay.

    Linked are shingle sets (five words) of a similarity of 0.8 or more. A document
    is an id with a text: rows with one id and unlike texts are documents each on
    their own, rows with one id and one text are one (of differing other columns
    the smallest stay). Documents without shingles are like none but their own copies.
    """
    docs = docs.select(*COLUMNS)
    rows = docs.filter(F.col("doc_id").isNotNull()).withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("text")))
    found = dedup.near_duplicates(rows.select("key", "text"), id_col="key", percent=SIMILAR)
    kept = found.filter("kept").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    met = rows.join(dedup.few(kept, 32), "key")
    left = met.filter("rows = 1").select(*COLUMNS)
    if kept.filter("rows > 1").limit(1).count():
        rest = met.filter("rows > 1").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("least"))
        left = left.unionByName(rest.select("doc_id", "text", "least.*"))
    return left.unionByName(docs.filter(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: file after file, row after row.

    Null sources are a source of their own; an empty table stays one.
    """
    return mixing.in_order(mixing.mix(docs.select(*COLUMNS), WEIGHTS)).select(*COLUMNS)


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text and position: the rows of the files before and those before it in its file."""
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:  # not from files: the mixture anew
        return mixing.mix(docs.select("doc_id", "text", "source"), WEIGHTS).select("doc_id", "text", "position")
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    begins = files.select("file", (F.sum("n").over(Window.orderBy(F.length("file"), "file")) - F.col("n")).alias("begin"))
    return rows.join(F.broadcast(begins), "file").select("doc_id", "text", (F.col("begin") + F.col("at")).alias("position"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the ids of its pieces, and its position in the mixture.

    Null texts have null ids, empty ones none; repeated rows are rows each on their own.
    """
    return queries.encoded(_placed(docs), "position")


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: Trained scores cannot be written as SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; rows of the last one."""
    folder = f"{checkpoints.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
