"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from .centroids import OP12_SQL, op12_centroids_screened
from .codes import OP13_SQL, op13_codes_heap
from .embedding_dedup import OP7_SQL, op7_embedding_passes
from .lm import op10_lm_maxent
from .mixing import OP3_SQL, op3_mix_golden
from .packing import op5_pack_ffd
from .pii import op8_pii_bootstrap
from .quality import op9_quality_boosted
from .repeats import OP11_SQL, op11_repeats_cover
from .secret_scan import op4_secrets_forest
from .sharding import op2_shard_feistel
from .simhash import op6_simhash_covering
from .topk import OP1_SQL, op1_topk_kdtree

QUERIES = {
    f.__name__: f
    for f in (
        op1_topk_kdtree,
        op2_shard_feistel,
        op3_mix_golden,
        op4_secrets_forest,
        op5_pack_ffd,
        op6_simhash_covering,
        op7_embedding_passes,
        op8_pii_bootstrap,
        op9_quality_boosted,
        op10_lm_maxent,
        op11_repeats_cover,
        op12_centroids_screened,
        op13_codes_heap,
    )
}
ORACLE_SQL = {
    "op1_topk_kdtree": OP1_SQL,
    "op3_mix_golden": OP3_SQL,
    "op7_embedding_passes": OP7_SQL,
    "op11_repeats_cover": OP11_SQL,
    "op12_centroids_screened": OP12_SQL,
    "op13_codes_heap": OP13_SQL,
}
