"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import sql
from .pii import op1_pii_bilstm_crf
from .secrets import op2_secrets_randomness
from .packing import op3_packing_dp
from .url_filter import op4_url_segmentation_bayes
from .avi import op5_avi_mjpeg
from .bpe import op6_bpe_backtracking
from .byte_cnn import op7_quality_byte_cnn
from .quality_rules import op8_quality_rules_hosts
from .simhash import op9_simhash_pigeonhole
from .substrings import op10_sentence_spans
from .mtree import op11_mtree_topk
from .lloyd import op12_filtering_lloyd
from .infill import op13_infill_rank_select

QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_bilstm_crf,
        op2_secrets_randomness,
        op3_packing_dp,
        op4_url_segmentation_bayes,
        op5_avi_mjpeg,
        op6_bpe_backtracking,
        op7_quality_byte_cnn,
        op8_quality_rules_hosts,
        op9_simhash_pigeonhole,
        op10_sentence_spans,
        op11_mtree_topk,
        op12_filtering_lloyd,
        op13_infill_rank_select,
    )
}
ORACLE_SQL: dict[str, str] = {"op8_quality_rules_hosts": sql.OP8, "op11_mtree_topk": sql.OP11, "op12_filtering_lloyd": sql.OP12, "op13_infill_rank_select": sql.OP13}
