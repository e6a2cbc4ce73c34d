"""Corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing, SentencePiece encoding.

Each stage takes the documents that its predecessor kept (COLUMNS; others are left out, as names of their own would clash
with what operators add) and, but for the last, returns the same columns. Nulls: a null text is an empty text to the
classifier, the mix and the encoder, stays null in the line stage, and is a document without words to the join, where it
stays; rows of null doc_id, source or lang are rows like others. Empty texts are scored, kept by the join, and have no
tokens. Equal rows count once after the join. An empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the stage's own labelled input, doesn't reject: a score of 0.5 stays.

    Without labels, or with labels of one kind, the score is a constant (0.5 without any), which rejects nothing or all.
    """
    from papyra.llm.quality import score, train

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels), keep=COLUMNS[1:]).where("score >= 0.5").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of two lines or more that stand elsewhere already; n_chars is the new length.

    A text that is all repeats becomes empty and stays; of ties, rows of one doc_id, each keeps its own first place.
    """
    from papyra.llm.line_dedup import dedup_passages

    return dedup_passages(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def shingle_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies; equal rows count once, documents without words stay."""
    from papyra.llm.shingle_join import shingle_classes

    stay = shingle_classes(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    hashed = docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"))
    kept = hashed.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_hash"]).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times."""
    from papyra.llm.mixing import mix, word_count

    key = [F.col(c) for c in ("doc_id", "source", "size")]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("copies"))
    # Rows of equal id, source and size are told apart by number; which is which doesn't matter.
    taken = mix(docs).select("doc_id", "source", "size", "copies").withColumn("_n", nth).where("copies > 0")
    numbered = docs.select(*COLUMNS, word_count(F.col("text")).alias("size"), F.lit(0).alias("copies")).withColumn("_n", nth).drop("copies")
    mine, other = numbered.alias("d"), taken.alias("t")
    same = F.lit(True)
    for c in ("doc_id", "source", "size", "_n"):
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}"))
    joined = mine.join(other, same)
    return joined.select(*(F.col(f"d.{c}").alias(c) for c in COLUMNS), F.explode(F.sequence(F.lit(1), F.col("t.copies"))).alias("_copy")).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each document, and digests of ids and decoded text: a row for each row of docs."""
    import public_tokenizers

    from papyra.llm.pieces import encode_documents

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("decoded")


STAGES = [("quality_classifier", quality_stage), ("line_dedup", line_stage), ("shingle_join", shingle_stage), ("mixing", mixing_stage), ("sentencepiece", pieces_stage)]

#: Line hashes, trees and SentencePiece have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
