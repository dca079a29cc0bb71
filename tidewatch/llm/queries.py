"""One query per operator, over whole tables, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, filteraudit, htmlextract, importance, langid, linededup, milquality, mixing, multiset, pieces, simhash, substring


def _on(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": _on(mixing.op1, "documents"),
    "op2_line_dedup": _on(linededup.op2, "documents"),
    "op3_language_id": _on(langid.op3, "documents"),
    "op4_media_columns": _on(audio.op4, "documents"),
    "op5_simhash_near_dedup": _on(simhash.op5, "documents"),
    "op6_html_extraction": _on(htmlextract.op6, "pages"),
    "op7_quality_classifier": _on(milquality.op7, "documents", "labels"),
    "op8_document_fingerprints": _on(multiset.op8, "documents"),
    "op9_byte_bpe": _on(bpe.op9, "documents"),
    "op10_substring_dedup": _on(substring.op10, "documents"),
    "op11_sentencepiece": _on(pieces.op11, "documents"),
    "op12_filter_audit": _on(filteraudit.op12, "documents", "labels"),
    "op13_importance_resampling": _on(importance.op13, "documents", "benchmark"),
}

ORACLES: dict[str, str] = {"op1_mix_sources": mixing.ORACLE, "op2_line_dedup": linededup.ORACLE, "op12_filter_audit": filteraudit.ORACLE, "op13_importance_resampling": importance.ORACLE}
