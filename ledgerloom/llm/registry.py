"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .context_mixing import op3_lm_scoring
from .decontamination import SQL as op8_sql
from .decontamination import op8_decontamination
from .jaccard import SQL as op4_sql
from .jaccard import op4_ngram_jaccard
from .language import op9_language
from .media import op2_media_columns
from .packing import op10_best_fit_packing
from .quality import op5_quality_classifier
from .repeats import SQL as op7_sql
from .repeats import op7_suffix_dedup
from .token_counts import op6_token_counts
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_media_columns": op2_media_columns,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_counts": op6_token_counts,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_language": op9_language,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard": op4_sql,
    "op7_suffix_dedup": op7_sql,
    "op8_decontamination": op8_sql,
}
