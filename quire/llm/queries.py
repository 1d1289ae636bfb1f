"""The ten operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, decontaminate, kneser_ney, license_scan, line_rules, phrase_automata, sharding, simhash, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(function, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: function(*[_table(spark, sf_dir, t) for t in tables])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": _over(license_scan.scan, "documents"),
    "op2_toxicity": _over(toxicity.report, "documents", "labels"),
    "op3_decontamination": _over(decontaminate.report, "documents", "benchmark"),
    "op4_byte_bpe": _over(bpe.encode, "documents"),
    "op5_sharding": _over(sharding.shard, "documents"),
    "op6_line_rules": _over(line_rules.clean, "documents"),
    "op7_suffix_dedup": _over(suffix_dedup.later_copies, "documents"),
    "op8_kneser_ney": _over(kneser_ney.keep, "documents", "labels"),
    "op9_simhash": _over(simhash.copies, "documents"),
    "op10_phrase_automata": _over(phrase_automata.occurrences, "documents"),
}

ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.scan_sql(),
    "op3_decontamination": decontaminate.report_sql(),
    "op5_sharding": sharding.shard_sql(),
    "op6_line_rules": line_rules.clean_sql(),
}
