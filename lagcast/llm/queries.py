"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from lagcast.llm.chat_tree import op6_chat_prefix_tree
from lagcast.llm.conversation_repair import OP11_SQL, op11_conversation_audit
from lagcast.llm.jaccard_join import op8_skipping_jaccard
from lagcast.llm.mixing import op7_entropy_mix
from lagcast.llm.ngram_resampling import OP12_SQL, op12_arrow_resampling
from lagcast.llm.orc_output import op10_orc_tokens
from lagcast.llm.packing import op9_packed_sequences
from lagcast.llm.piecewise import op1_piecewise_prints
from lagcast.llm.quality import op5_importance_quality
from lagcast.llm.sharding import op2_minimax_shards
from lagcast.llm.tensor_minhash import op13_tensored_minhash
from lagcast.llm.va_file import OP3_SQL, op3_va_file_top5
from lagcast.llm.warc import OP4_SQL, op4_warc_round_trip

QUERIES = {f.__name__: f for f in (op1_piecewise_prints, op2_minimax_shards, op3_va_file_top5, op4_warc_round_trip, op5_importance_quality, op6_chat_prefix_tree, op7_entropy_mix, op8_skipping_jaccard, op9_packed_sequences, op10_orc_tokens, op11_conversation_audit, op12_arrow_resampling, op13_tensored_minhash)}
ORACLES = {"op3_va_file_top5": OP3_SQL, "op4_warc_round_trip": OP4_SQL, "op11_conversation_audit": OP11_SQL, "op12_arrow_resampling": OP12_SQL}
