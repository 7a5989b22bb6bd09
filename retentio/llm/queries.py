"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from functools import wraps

from .chat_format import OP12_SQL, op12_chat_format
from .common import ship
from .context_mixing import op2_context_mixing
from .filter_audit import OP11_SQL, op11_filter_audit
from .hilbert_pack import op3_hilbert_pack
from .license_scan import OP10_SQL, op10_license_scan
from .line_quality import OP8_SQL, op8_line_quality
from .nn_descent import op1_nn_descent
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .segment_bpe import op4_segment_bpe
from .simhash import op6_simhash
from .token_records import op9_token_records
from .toxicity import op7_toxicity
from .url_filter import OP5_SQL, op5_url_filter


def shipped(query):
    """The query, with this package at hand for its Python workers."""
    @wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)
    return run


QUERIES = {
    "op1_nn_descent": op1_nn_descent,
    "op2_context_mixing": op2_context_mixing,
    "op3_hilbert_pack": op3_hilbert_pack,
    "op4_segment_bpe": op4_segment_bpe,
    "op5_url_filter": op5_url_filter,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_line_quality": op8_line_quality,
    "op9_token_records": op9_token_records,
    "op10_license_scan": op10_license_scan,
    "op11_filter_audit": op11_filter_audit,
    "op12_chat_format": op12_chat_format,
    "op13_prefix_trie": op13_prefix_trie,
}
QUERIES = {name: shipped(query) for name, query in QUERIES.items()}
ORACLE = {
    "op5_url_filter": OP5_SQL,
    "op8_line_quality": OP8_SQL,
    "op10_license_scan": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_chat_format": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
