"""Queries of the training-data operators and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from territory_engine.llm import alignment, decontamination, embeddings, extraction, langid, licenses, packing, quality, resampling, simhash, tokenfile, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_html_extraction": extraction.op2_html_extraction,
    "op3_language_id": langid.op3_language_id,
    "op4_url_filters": urls.op4_url_filters,
    "op5_embedding_dedup": embeddings.op5_embedding_dedup,
    "op6_token_files": tokenfile.op6_token_files,
    "op7_simhash": simhash.op7_simhash,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_quality": quality.op12_quality,
    "op13_cross_tokenizer": alignment.op13_cross_tokenizer,
}

ORACLES: dict[str, str] = {
    "op4_url_filters": urls.ORACLE_SQL,
    "op10_license_scan": licenses.ORACLE_SQL,
    "op11_importance_resampling": resampling.ORACLE_SQL,
}
