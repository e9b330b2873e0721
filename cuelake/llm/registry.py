"""Queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from .ann import op10_hilbert_ann
from .byte_bpe import op7_byte_bpe
from .decontamination import ORACLE as DECONTAMINATION_SQL
from .decontamination import op11_benchmark_decontamination
from .hard_negatives import ORACLE as NEGATIVES_SQL
from .hard_negatives import op13_hard_negatives
from .language_id import op6_language_id
from .license_scan import ORACLE as LICENSE_SQL
from .license_scan import op2_license_scan
from .minhash import ORACLE as MINHASH_SQL
from .minhash import op5_minhash
from .packing import op3_best_fit_packing
from .progressive_jpeg import op9_progressive_jpeg
from .quality import op4_quality
from .spelling import op12_spelling_variants
from .suffix_dedup import op8_suffix_dedup
from .toxicity import op1_toxicity

QUERIES = {
    "op9_progressive_jpeg": op9_progressive_jpeg,
    "op10_hilbert_ann": op10_hilbert_ann,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op2_license_scan": op2_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op5_minhash": op5_minhash,
    "op7_byte_bpe": op7_byte_bpe,
    "op4_quality": op4_quality,
    "op1_toxicity": op1_toxicity,
    "op6_language_id": op6_language_id,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op2_license_scan": LICENSE_SQL,
    "op5_minhash": MINHASH_SQL,
    "op11_benchmark_decontamination": DECONTAMINATION_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
