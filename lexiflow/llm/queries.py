"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import knn, mixing, quality, url_filter, warc_index
from .bpe import op3_bpe
from .chat import op2_chat_formatting
from .language import op1_language_id
from .near_dup import op10_minhash_near_dedup
from .toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_chat_formatting,
        op3_bpe,
        knn.op4_exact_top_k,
        url_filter.op5_url_filters,
        quality.op6_quality_rules,
        mixing.op7_mixing_sources,
        op8_toxicity,
        warc_index.op9_warc_index,
        op10_minhash_near_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op4_exact_top_k": knn.SQL,
    "op5_url_filters": url_filter.SQL,
    "op6_quality_rules": quality.SQL,
    "op7_mixing_sources": mixing.SQL,
    "op9_warc_index": warc_index.SQL,
}
