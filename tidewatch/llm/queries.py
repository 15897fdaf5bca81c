"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

import corpus_pipeline

from .decontaminate import OP13_SQL, op13_decontamination
from .fingerprint import op3_fingerprint
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .html_text import op8_html
from .importance import op12_resampling
from .language_model import op6_lm_scoring
from .media import op10_media
from .mixing import op7_mixing
from .near_dup import op1_jaccard_join
from .packing import op5_packing
from .quality import op2_quality
from .substring_dedup import op9_suffix_dedup
from .url_filter import OP4_SQL, op4_url_filter

QUERIES = {
    "op1_ngram_jaccard_join": op1_jaccard_join,
    "op2_quality_classifier": op2_quality,
    "op3_document_fingerprints": op3_fingerprint,
    "op4_url_filter": op4_url_filter,
    "op5_best_fit_packing": op5_packing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_source_mixing": op7_mixing,
    "op8_html_extraction": op8_html,
    "op9_suffix_array_dedup": op9_suffix_dedup,
    "op10_media_columns": op10_media,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_importance_resampling": op12_resampling,
    "op13_decontamination": op13_decontamination,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op4_url_filter": OP4_SQL, "op11_hard_negatives": OP11_SQL, "op13_decontamination": OP13_SQL}
