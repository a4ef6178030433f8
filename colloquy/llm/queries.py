"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, lines, mixing, multiset, neighbours, packing, quality, simhash, token_files, toxicity
from .common import read_table, scratch


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.label_lines(read_table(spark, sf_dir, "documents")).drop("mark")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_tokens(read_table(spark, sf_dir, "documents"), path, _vocabulary("word_bpe_49k.json"), 2)
    return token_files.id_digests(token_files.read_tokens(spark, path))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op9_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edited_likeness(read_table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(20)) == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mix": op2_mix,
    "op3_pack": op3_pack,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_token_files": op6_token_files,
    "op7_main_text": op7_main_text,
    "op8_simhash": op8_simhash,
    "op9_multiset": op9_multiset,
    "op10_neighbours": op10_neighbours,
}
ORACLES: dict[str, str] = {}
