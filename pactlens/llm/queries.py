"""The operators' queries, and the SQL of those that SQL can express."""

from pactlens.llm.chat_format import OP3_SQL, op3_chat_format
from pactlens.llm.filter_audit import OP12_SQL, op12_filter_audit
from pactlens.llm.infilling import OP11_SQL, op11_infilling
from pactlens.llm.language_id import op5_language_id
from pactlens.llm.minhash_dedup import op9_minhash_dedup
from pactlens.llm.packing import op2_best_fit_packing
from pactlens.llm.piece_encoding import op7_piece_encoding
from pactlens.llm.token_blocks import op4_token_blocks
from pactlens.llm.toxicity import op6_toxicity
from pactlens.llm.url_rules import OP10_SQL, op10_url_rules
from pactlens.llm.vector_dedup import OP1_SQL, op1_embedding_dedup
from pactlens.llm.vector_search import op8_hnsw_search
from pactlens.llm.warc_zip import OP13_SQL, op13_warc_packages

_ALL = (op1_embedding_dedup, op2_best_fit_packing, op3_chat_format, op4_token_blocks, op5_language_id, op6_toxicity, op7_piece_encoding, op8_hnsw_search, op9_minhash_dedup, op10_url_rules, op11_infilling, op12_filter_audit, op13_warc_packages)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op1_embedding_dedup": OP1_SQL, "op3_chat_format": OP3_SQL, "op10_url_rules": OP10_SQL, "op11_infilling": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_warc_packages": OP13_SQL}
