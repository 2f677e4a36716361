"""The corpus queries of ``__spark_entry__``: each applies one operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, mixing, near_dedup, oracles, quality_model, quality_rules, sharding, substring_dedup, surrogates, token_tables
from .common import workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), texts=False).drop("kept", "spans")


def op3_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4).drop("tk")


def op4_levelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).drop("kept")


def op5_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_subword_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), workspace(spark, "op7"))


def op8_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("tk")


def op9_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables.tokenize_documents(table(spark, sf_dir, "documents"), tokenizer_path()).drop("shard")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(table(spark, sf_dir, "documents"))


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 measures by rule, beside its learned verdict: SQL can say this part."""
    return op1_risk_controlled_rules(spark, sf_dir).drop("kept")


def shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over op7: rows, bytes, shards, whether slots have no gaps, and whether shards differ by a row's size at most."""
    rows = op7_virtual_slots(spark, sf_dir)
    shards = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.max("size").alias("most"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots"))
    return shards.agg(
        F.sum("n").alias("n_rows"), F.sum("b").alias("n_bytes"), F.count(F.lit(1)).alias("n_shards"),
        F.bool_and((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless"),
        (F.max("b") - F.min("b") <= F.max("most")).alias("even"),
    )


QUERIES = {
    "op1_risk_controlled_rules": op1_risk_controlled_rules,
    "op2_seed_and_extend": op2_seed_and_extend,
    "op3_tensored_minhash": op3_tensored_minhash,
    "op4_levelled_runs": op4_levelled_runs,
    "op5_template_windows": op5_template_windows,
    "op6_subword_embeddings": op6_subword_embeddings,
    "op7_virtual_slots": op7_virtual_slots,
    "op8_raked_mixture": op8_raked_mixture,
    "op9_token_tables": op9_token_tables,
    "op10_surrogates": op10_surrogates,
    "quality_base_columns": quality_base_columns,
    "shard_totals": shard_totals,
}

ORACLES: dict[str, str] = {
    "op3_tensored_minhash": oracles.OP3,
    "op2_seed_and_extend": oracles.OP2,
    "op4_levelled_runs": oracles.OP4,
    "quality_base_columns": oracles.BASE_COLUMNS,
    "shard_totals": oracles.SHARD_TOTALS,
}
