"""The opN_ queries: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "embeddings"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan

    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.model_of(docs))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    archives = materialize(warc.write(table(spark, sf_dir, "pages")), "archives")
    return warc.read(archives).drop("payload")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    probe = "</s>[INST] ok [/INST]"
    probes = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probes)
    return chat.read_back(chat.render(chat.fold(chat.turn_events(turns))))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine, shift_labels

    return mine(shift_labels(table(spark, sf_dir, "embeddings")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def all_queries() -> dict[str, tuple[Query, str | None]]:
    from . import chat, embedding_dedup, exact_dedup, hard_negatives, ngram_join, vector_codes, warc

    return {
        "op1_ngram_jaccard_join": (op1_ngram_jaccard_join, ngram_join.ORACLE_SQL),
        "op2_exact_dedup": (op2_exact_dedup, exact_dedup.ORACLE_SQL),
        "op3_packing": (op3_packing, None),
        "op4_embedding_near_dedup": (op4_embedding_near_dedup, embedding_dedup.ORACLE_SQL),
        "op5_bpe_encoding": (op5_bpe_encoding, None),
        "op6_secret_scans": (op6_secret_scans, None),
        "op7_warc": (op7_warc, warc.ORACLE_SQL),
        "op8_chat_formatting": (op8_chat_formatting, chat.ORACLE_SQL),
        "op9_token_counts": (op9_token_counts, None),
        "op10_quality_classifier": (op10_quality_classifier, None),
        "op11_mixing": (op11_mixing, None),
        "op12_hard_negatives": (op12_hard_negatives, hard_negatives.ORACLE_SQL),
        "op13_vector_codes": (op13_vector_codes, vector_codes.ORACLE_SQL),
    }
