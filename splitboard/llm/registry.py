"""The queries of this package, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from splitboard.llm import chat_format, collocations, decontaminate, embedding_dedup, exact_dedup, filter_audit, language_id, license_scan, line_dedup, packing, secret_scan, simhash_dedup, url_filter

QUERIES = {
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op5_simhash_dedup": simhash_dedup.op5_simhash_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op7_chat_format": chat_format.op7_chat_format,
    "op1_url_filter": url_filter.op1_url_filter,
    "op10_license_scan": license_scan.op10_license_scan,
    "op6_packing": packing.op6_packing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_collocations": collocations.op12_collocations,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op7_chat_format": chat_format.op7_sql(),
    "op10_license_scan": license_scan.op10_sql(),
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
