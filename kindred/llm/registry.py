"""The queries of this subpackage and what SQL can say of them."""

from __future__ import annotations

from . import decontaminate, editprint, html, langid, licences, pieces, quality, repeats, secrets, simhash

QUERIES = {
    "op1_secret_scans": secrets.op1,
    "op2_suffix_dedup": repeats.op2,
    "op3_benchmark_decontamination": decontaminate.op3,
    "op4_language_id": langid.op4,
    "op5_quality_classifier": quality.op5,
    "op6_html_extraction": html.op6,
    "op7_simhash_near_dedup": simhash.op7,
    "op8_license_scans": licences.op8,
    "op9_document_fingerprints": editprint.op9,
    "op10_sentencepiece": pieces.op10,
}
ORACLE_SQL = {"op1_secret_scans": secrets.ORACLE_SQL, "op2_suffix_dedup": repeats.ORACLE_SQL, "op3_benchmark_decontamination": decontaminate.ORACLE_SQL}
