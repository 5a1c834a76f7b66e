"""The queries of this folder and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import consensus, forms, kinds, languages, mixing, packing, repair, spans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name; pN_ belongs to problem N."""
    return {
        "p1_found": languages.find_languages,
        "p1_languages": lambda s, d: languages.identify_languages(s, d).select("tab", "rec_id", "seg", "code", "confidence"),
        "p2_found": consensus.find_labels,
        "p2_labels": lambda s, d: consensus.Consensus(s, d).labels(),
        "p2_reliability": lambda s, d: consensus.Consensus(s, d).reliability(),
        "p3_found": repair.find_repairs,
        "p3_texts": repair.mended_texts,
        "p4_found": forms.unify_forms,
        "p4_spellings": forms.spellings,
        "p5_found": kinds.find_kinds,
        "p5_statistics": kinds.text_kinds,
        "p6_pack": packing.pack_documents,
        "p6_report": packing.packing_report,
        "p7_mix": mixing.mix_documents,
        "p7_shares": mixing.mix_report,
        "p8_found": spans.find_shared,
        "p8_spans": lambda s, d: spans.shared_spans(s, d).distinct(),
    }


def oracle_sql() -> dict[str, str]:
    """None of these is expressible in SQL on whole tables; tests/llm holds brute-force checks."""
    return {}
