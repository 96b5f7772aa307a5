"""Queries of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from . import license_scan, quality_rules, resampling, url_filter, whitening
from .decontamination import op10_decontamination
from .minhash import op4_minhash_dedup
from .packing import op2_packing
from .pii import op5_pii
from .quality_model import op7_quality_model
from .repeats import op6_repeated_bytes
from .token_counts import op8_token_counts
from .token_files import op9_token_files

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_pii": op5_pii,
    "op6_repeated_bytes": op6_repeated_bytes,
    "op7_quality_model": op7_quality_model,
    "op8_token_counts": op8_token_counts,
    "op9_token_files": op9_token_files,
    "op10_decontamination": op10_decontamination,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_url_filter": url_filter.op13_url_filter,
}
#: DuckDB SQL where it can express the operator.
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op3_license_scan": license_scan.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
}
