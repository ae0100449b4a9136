"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import classlm, fingerprint, jaccard, language, linededup, mixing, packing, quality, suffixes, urlfilter

QUERIES = {
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_language": language.op2_language,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_class_lm": classlm.op5_class_lm,
    "op6_quality": quality.op6_quality,
    "op7_packing": packing.op7_packing,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
}

ORACLES = {"op3_line_dedup": linededup.OP3_SQL, "op6_quality": quality.OP6_SQL, "op9_url_filter": urlfilter.OP9_SQL}
