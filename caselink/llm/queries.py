"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from caselink.llm.alignment import op12_cross_tokenizer_alignment
from caselink.llm.embedding_dedup import OP3_SQL, op3_embedding_near_dedup
from caselink.llm.graph_search import OP11_SQL, op11_robust_pruned_graph
from caselink.llm.minhash_dedup import OP1_SQL, op1_minhash_near_dedup
from caselink.llm.mixing import OP4_SQL, op4_mixing_water_filling
from caselink.llm.pieces import op5_sentencepiece_merge_rounds
from caselink.llm.pii import op2_pii_anchor_expansion
from caselink.llm.repeats import op8_suffix_array_repeats
from caselink.llm.token_counts import op7_prefix_token_counts
from caselink.llm.topk_search import OP9_SQL, op9_kd_tree_top_k
from caselink.llm.toxicity import op10_toxicity_kneser_ney
from caselink.llm.warc import op6_warc_normaliser
from caselink.llm.whitening import op13_embedding_whitening

QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup,
    op2_pii_anchor_expansion,
    op3_embedding_near_dedup,
    op4_mixing_water_filling,
    op5_sentencepiece_merge_rounds,
    op6_warc_normaliser,
    op7_prefix_token_counts,
    op8_suffix_array_repeats,
    op9_kd_tree_top_k,
    op10_toxicity_kneser_ney,
    op11_robust_pruned_graph,
    op12_cross_tokenizer_alignment,
    op13_embedding_whitening,
)}
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op3_embedding_near_dedup": OP3_SQL,
    "op4_mixing_water_filling": OP4_SQL,
    "op9_kd_tree_top_k": OP9_SQL,
    "op11_robust_pruned_graph": OP11_SQL,
}
