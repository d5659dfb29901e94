"""All ``opN_`` queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from . import langid, licenses, lines, neardup, packing, periods, phrases, pii, quality, resample, sharding, tokencount, warc

QUERIES = {
    "op1_line_chunks": lines.op1_line_chunks,
    "op2_llr_quality": quality.op2_llr_quality,
    "op3_sharding": sharding.op3_sharding,
    "op4_semicrf_pii": pii.op4_semicrf_pii,
    "op5_patience_licenses": licenses.op5_patience_licenses,
    "op6_warc_chunks": warc.op6_warc_chunks,
    "op7_packing": packing.op7_packing,
    "op8_ppm_langid": langid.op8_ppm_langid,
    "op9_token_groups": neardup.op9_token_groups,
    "op10_phrase_index": phrases.op10_phrase_index,
    "op11_periodic_runs": periods.op11_periodic_runs,
    "op12_token_counts": tokencount.op12_token_counts,
    "op13_importance_resampling": resample.op13_importance_resampling,
    "op1_shared_runs": lines.op1_shared_runs,
}
SQL = lines.SQL | sharding.SQL | warc.SQL | neardup.SQL | phrases.SQL | resample.SQL
