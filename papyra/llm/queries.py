"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shingle_join import shingle_classes

    return shingle_classes(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edit_pairs

    return edit_pairs(_read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    out = suffix_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_join import range_join

    return range_join(_read(spark, sf_dir, "embeddings"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import read_tokens, write_tokens

    return read_tokens(spark, write_tokens(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")), ids=False)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), ids=False)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_read(spark, sf_dir, "documents")).drop("blocks")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out, score, train

    docs = _read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_passages

    out = dedup_passages(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("removed_lines").cast("long").alias("removed_lines"), F.col("removed_chunks").cast("long").alias("removed_chunks"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest, verified

    chars = F.col("n_chars").cast("long")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, chars + 1).otherwise(chars)
    return verified(manifest(_read(spark, sf_dir, "documents"), changed={"n_chars": tampered}))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie, rebuilt, turns_of

    conv = F.col("conv")
    turns = turns_of(_read(spark, sf_dir, "conversations"))
    return prefix_trie(rebuilt(turns, base=conv - conv % 100, head=F.crc32(conv.cast("string")) % 6, most=5))


def op13_top_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_search import search

    return search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


_ALL = (
    op1_shingle_join, op2_fingerprints, op3_suffix_dedup, op4_embedding_dedup, op5_token_output, op6_sentencepiece, op7_license_scan,
    op8_quality_classifier, op9_mixing, op10_line_dedup, op11_merkle_manifest, op12_prefix_trie, op13_top_search,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: DuckDB SQL where it can express a query.
ORACLE_SQL: dict[str, str] = {
    "op1_shingle_join": oracles.SHINGLES,
    "op4_embedding_dedup": oracles.EMBEDDINGS,
    "op7_license_scan": oracles.licenses(),
    "op11_merkle_manifest": oracles.MERKLE,
    "op12_prefix_trie": oracles.TRIE,
    "op13_top_search": oracles.TOP,
}
