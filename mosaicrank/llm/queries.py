"""Queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op4_ann_additive
from .bpe import op6_bpe_encode_decode
from .exact_topk import OP5_SQL, op5_exact_topk
from .license_scan import op3_license_scan
from .line_dedup import OP1_SQL, op1_line_dedup
from .mixing import op2_mix_sources
from .quality import op8_quality_gbdt
from .secret_scan import op7_secret_scan
from .simhash import op9_simhash_neardup
from .toxicity import op10_toxicity_nnpu

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_license_scan": op3_license_scan,
    "op4_ann_additive": op4_ann_additive,
    "op5_exact_topk": op5_exact_topk,
    "op6_bpe_encode_decode": op6_bpe_encode_decode,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_gbdt": op8_quality_gbdt,
    "op9_simhash_neardup": op9_simhash_neardup,
    "op10_toxicity_nnpu": op10_toxicity_nnpu,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op5_exact_topk": OP5_SQL,
}
