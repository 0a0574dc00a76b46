"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from tapeloom.llm.bpe import op1_byte_bpe
from tapeloom.llm.collocations import OP13_SQL, op13_fm_collocations
from tapeloom.llm.column_bwt import op7_column_bwt
from tapeloom.llm.gif import op4_gif
from tapeloom.llm.line_runs import OP9_SQL, op9_line_runs
from tapeloom.llm.minhash import OP10_SQL, op10_circulant_minhash
from tapeloom.llm.multi_index import OP11_SQL, op11_inverted_multi_index
from tapeloom.llm.ngram_trie import op6_ngram_trie
from tapeloom.llm.periodic_runs import op12_periodic_runs
from tapeloom.llm.positional_index import OP5_SQL, op5_positional_index
from tapeloom.llm.string_kernel import op3_string_kernel
from tapeloom.llm.unit_dedup import OP8_SQL, op8_unit_hashing
from tapeloom.llm.url_filter import op2_url_model

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_url_model": op2_url_model,
    "op3_string_kernel": op3_string_kernel,
    "op4_gif": op4_gif,
    "op5_positional_index": op5_positional_index,
    "op6_ngram_trie": op6_ngram_trie,
    "op7_column_bwt": op7_column_bwt,
    "op8_unit_hashing": op8_unit_hashing,
    "op9_line_runs": op9_line_runs,
    "op10_circulant_minhash": op10_circulant_minhash,
    "op11_inverted_multi_index": op11_inverted_multi_index,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fm_collocations": op13_fm_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op5_positional_index": OP5_SQL,
    "op8_unit_hashing": OP8_SQL,
    "op9_line_runs": OP9_SQL,
    "op10_circulant_minhash": OP10_SQL,
    "op11_inverted_multi_index": OP11_SQL,
    "op13_fm_collocations": OP13_SQL,
}
