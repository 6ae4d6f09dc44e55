"""The registered queries of the corpus operators, and their SQL oracles."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_text, language_id, licenses, minhash, packing, phrases, quality, simhash, spelling, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality": quality.op4_quality,
    "op5_packing": packing.op5_packing,
    "op6_simhash": simhash.op6_simhash,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_language_id": language_id.op8_language_id,
    "op9_html_text": html_text.op9_html_text,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_spelling": spelling.op11_spelling,
    "op12_phrases": phrases.op12_phrases,
    "op13_minhash": minhash.op13_minhash,
}

ORACLES = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op7_license_scan": licenses.OP7_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_phrases": phrases.OP12_SQL,
    "op13_minhash": minhash.OP13_SQL,
}
