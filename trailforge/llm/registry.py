"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailforge.llm import bitplanes, ctw, langid, lzprint, mixing, packing, privacy, quality, simhash, templates
from trailforge.llm.common import documents


def tokenizer(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(documents(spark, sf_dir))


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digest(documents(spark, sf_dir))


def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(documents(spark, sf_dir))


def op5_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.compare(documents(spark, sf_dir))


def op6_conditional_random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(documents(spark, sf_dir))


def op7_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op8_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = templates.drop_lines(documents(spark, sf_dir))
    return done.select("doc_id", done["__lines"].alias("n_lines"), done["__dropped"].alias("n_dropped"), "text")


def op9_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op10_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_weak_supervision, op3_pareto_mixing, op4_context_tree, op5_lempel_ziv, op6_conditional_random_field, op7_bit_planes, op8_template_tree, op9_ball_hashing, op10_sum_of_squares)}
ORACLES: dict[str, str] = {"op1_quality_rules": quality.ORACLE, "op3_pareto_mixing": mixing.ORACLE}
