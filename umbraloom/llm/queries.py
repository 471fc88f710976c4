"""The corpus queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraloom.llm import alignment, decontamination, fill_in_middle, ngram_join, repeats
from umbraloom.llm.common import Scratch, table
from umbraloom.llm.decontamination import decontaminate
from umbraloom.llm.exact_dedup import exact_dedup
from umbraloom.llm.hmm import hmm_scores
from umbraloom.llm.html_text import extract
from umbraloom.llm.licences import licence_scan, licence_sql
from umbraloom.llm.ngram_join import ngram_components
from umbraloom.llm.packing import pack
from umbraloom.llm.pii import pseudonymise
from umbraloom.llm.quality import quality_scores
from umbraloom.llm.repeats import remove_repeats
from umbraloom.llm.tokens import ByteBpe, Pieces
from umbraloom.llm.url_filter import url_filter, url_filter_sql


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")
    return got.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ","))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "quality"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents")).withColumn("found", F.to_json("found"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents")).drop("matches")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(text, 256)}).drop("output")


def op12_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), lambda: (ByteBpe(a, pattern), Pieces(b)), Pieces(b).size)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_licences": op6_licences,
    "op7_html_text": op7_html_text,
    "op8_packing": op8_packing,
    "op9_ngram_join": op9_ngram_join,
    "op10_repeats": op10_repeats,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_hmm": op12_hmm,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM n WINDOW same AS (PARTITION BY t)""",
    "op2_url_filter": url_filter_sql(),
    "op3_decontamination": decontamination.SQL,
    "op6_licences": licence_sql(),
    "op9_ngram_join": ngram_join.SQL,
    "op10_repeats": repeats.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
}
