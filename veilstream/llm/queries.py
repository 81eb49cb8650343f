"""Queries of the training-data operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilstream.llm.common import spread, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.simhash import near_duplicates

    return near_duplicates(spread(table(spark, sf_dir, "documents")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.html_text import main_text

    return main_text(spread(table(spark, sf_dir, "pages")))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.media import store_and_read

    return store_and_read(spread(table(spark, sf_dir, "documents")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.decontaminate import find

    return find(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.toxicity import score, train

    docs = spread(table(spark, sf_dir, "documents"))
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.secret_scan import digest

    return digest(spread(table(spark, sf_dir, "documents")))


def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.token_store import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.suffix_dedup import remove_repeats

    return remove_repeats(spread(table(spark, sf_dir, "documents")))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.fill_middle import digest, transform

    return digest(transform(spread(table(spark, sf_dir, "documents"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.source_divergence import audit

    return audit(spread(table(spark, sf_dir, "documents")))


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.piece_codec import digest, round_trip

    return digest(round_trip(spread(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from veilstream.llm import fill_middle, mixing, source_divergence

    return {"op10_source_mixing": mixing.oracle(), "op11_fill_in_middle": fill_middle.oracle(), "op12_source_divergence": source_divergence.oracle()}
