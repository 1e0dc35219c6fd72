"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tivlens.llm import (
    ann, chat, decontamination, language_id, line_dedup, lm_scoring, minhash, piece_codec, pivot_clusters, token_alignment,
    token_counts, warc, weighted_fingerprints)
from tivlens.llm.common import crc_mod, new_folder, table

PIECES = "piece_bpe_32k.model"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = piece_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), folder, every_row=True)
    return warc.read_records(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 7) == 2
    scored = lm_scoring.score_texts(table(spark, sf_dir, "documents"), ~held_out, public_tokenizers.path(PIECES), "lang")
    return scored.withColumn("held_out", ~F.col("training")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    done = chat.format_trees(chat.chains(turns.unionByName(added)))
    read = done.select("tree", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("turns"),
                       chat.learned_text().alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 public_tokenizers.path(PIECES))


def op12_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op13_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_clusters.cluster_vectors(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ann": op2_ann,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_piece_codec": op6_piece_codec,
    "op7_warc": op7_warc,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_minhash": op9_minhash,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_token_alignment": op11_token_alignment,
    "op12_weighted_fingerprints": op12_weighted_fingerprints,
    "op13_pivot_clusters": op13_pivot_clusters,
}
