"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers

from . import op1_suffix, op2_substring, op3_decontamination, op4_embeddings, op5_jaccard, op6_chat, op7_language, op8_sharding, op9_licences, op10_packing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_query(spark, sf_dir):
    return op1_suffix.remove_repeated(_read(spark, sf_dir, "documents")).drop("spans")


def op2_substring_query(spark, sf_dir):
    return op2_substring.removal_report(_read(spark, sf_dir, "documents"))


def op3_decontamination_query(spark, sf_dir):
    return op3_decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("hit_words")


def op4_embedding_query(spark, sf_dir):
    return op4_embeddings.near_vectors(_read(spark, sf_dir, "embeddings"))


def op5_jaccard_query(spark, sf_dir):
    return op5_jaccard.jaccard_components(_read(spark, sf_dir, "documents"))


def op6_chat_query(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(op6_chat.stray_conversation(spark))
    return op6_chat.digests(op6_chat.format_chats(rows))


def op7_language_query(spark, sf_dir):
    return op7_language.predict_languages(_read(spark, sf_dir, "documents"))


def op8_sharding_query(spark, sf_dir):
    return op8_sharding.assign_shards(_read(spark, sf_dir, "documents"))


def op9_licence_query(spark, sf_dir):
    return op9_licences.scan_licences(_read(spark, sf_dir, "documents"))


def op10_packing_query(spark, sf_dir):
    return op10_packing.pack(_read(spark, sf_dir, "documents"), TOKENIZER)


def queries():
    return {
        "op1_suffix_array_dedup": op1_suffix_query,
        "op2_substring_dedup": op2_substring_query,
        "op3_benchmark_decontamination": op3_decontamination_query,
        "op4_embedding_near_dedup": op4_embedding_query,
        "op5_ngram_jaccard_join": op5_jaccard_query,
        "op6_chat_formatting": op6_chat_query,
        "op7_language_id": op7_language_query,
        "op8_sharding": op8_sharding_query,
        "op9_licence_scans": op9_licence_query,
        "op10_best_fit_packing": op10_packing_query,
    }


def oracle_sql():
    return {"op2_substring_dedup": op2_substring.SQL, "op3_benchmark_decontamination": op3_decontamination.SQL, "op6_chat_formatting": op6_chat.SQL, "op9_licence_scans": op9_licences.SQL}
