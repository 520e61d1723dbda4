"""The queries of this subpackage and their SQL, for the entry module."""

from tarn.llm import chat, decontaminate, digest, lm, pieces, pii, quality, secrets, simhash, urls

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_url_filters": urls.op4_url_filters,
    "op5_lm_scoring": lm.op5_lm_scoring,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_document_fingerprints": digest.op7_document_fingerprints,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
}

ORACLES = {
    "op6_secret_scans": secrets.ORACLE_SQL,
    "op9_chat_formatting": chat.ORACLE_SQL,
    "op4_url_filters": urls.ORACLE_SQL,
    "op10_benchmark_decontamination": decontaminate.ORACLE_SQL,
}
