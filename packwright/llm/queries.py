"""Registered queries of the operators, with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.llm import ctw, decontam, embed, fim, langid, lines, piece, repeats, shards, simhash, tokens, toxicity, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with equivalent SQL if there is one."""
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards by jump consistent hashing of doc_id."""
    return shards.assign_shards(table(spark, sf_dir, "documents"), 40)


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with SimHash fingerprint and near-duplicate component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("kept")


@query("op3_lines", lines.DIGEST_SQL)
def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that five sources or more share."""
    out = lines.drop_spread_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("line_dedup.n_lines").cast("long").alias("n_lines"),
                      F.col("line_dedup.n_removed").cast("long").alias("n_removed"),
                      F.sha2("text", 256).alias("kept_sha256"))


@query("op5_embeddings")
def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links at cosine 0.98 or more within their label."""
    return embed.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(~out).select("text", "lang"))
    return langid.identify(docs, model, "doc_id").select(
        "doc_id", out.alias("held_out"), "lang_pred", "score", "proportions")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 3, 1)
    labels = table(spark, sf_dir, "labels").where(~out).select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text").join(labels, "doc_id"))
    return toxicity.score(docs, model, "doc_id").select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold an item of the benchmark, with their items."""
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("item").alias("item_id"), "edits", "begin", "end")


@query("op2_pieces")
def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as SentencePiece ids and back again."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece.encode(table(spark, sf_dir, "documents"), path, "doc_id", decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in binary files, read back from them."""
    return tokens.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_repeats")
def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 100-byte strings that start earlier as well."""
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), "doc_id")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the leading components of their covariance, with unit variance."""
    return whiten.whiten(table(spark, sf_dir, "embeddings"), "vec_id")


@query("op13_fill_middle")
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in fill-in-middle form and put together again."""
    return fim.digests(table(spark, sf_dir, "documents"))


@query("op11_context_trees")
def op11_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-probability of all documents by context trees and by words, learned from six sevenths of them."""
    return ctw.score(table(spark, sf_dir, "documents"), langid.held_out(F.col("doc_id"), 7, 2), "doc_id")
