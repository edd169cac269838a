"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, licenses, media, near_dup, packing, pii, quality_classifier, quality_rules, url_filter, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_bpe": bpe.op2_bpe,
    "op3_ngram_join": near_dup.op3_ngram_join,
    "op4_warc": warc.op4_warc,
    "op5_packing": packing.op5_packing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_media": media.op7_media,
    "op8_licenses": licenses.op8_licenses,
    "op9_pii": pii.op9_pii,
    "op10_quality": quality_classifier.op10_quality,
}
ORACLES = {"op1_quality_rules": quality_rules.ORACLE_SQL, "op4_warc": warc.ORACLE_SQL}
