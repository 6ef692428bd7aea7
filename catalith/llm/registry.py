"""The queries of the corpus operators and the SQL that says the same."""

from __future__ import annotations

from catalith.llm import decontaminate, exact_dedup, filter_audit, fingerprints, jaccard_join, language, licenses, lm_score, packing, pii, toxicity, url_filter, variants

QUERIES = {
    "op1_pii": pii.query,
    "op2_decontaminate": decontaminate.query,
    "op3_language": language.query,
    "op4_toxicity": toxicity.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_packing": packing.query,
    "op7_url_filter": url_filter.query,
    "op8_licenses": licenses.query,
    "op9_jaccard_join": jaccard_join.query,
    "op10_lm_score": lm_score.query,
    "op11_fingerprints": fingerprints.query,
    "op12_variants": variants.query,
    "op13_filter_audit": filter_audit.query,
}
SQL = {
    "op5_exact_dedup": exact_dedup.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op12_variants": variants.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
