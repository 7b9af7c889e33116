"""The queries of the corpus operators, over whole tables, and their SQL where SQL can express them."""

from ..session import shipped
from . import chat_format, exact_dedup, language_id, licenses, mixing, ngram_join, sentencepiece_lattice, sharding, substring_dedup, topk_search

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_bitmask_language": language_id.op2_bitmask_language,
    "op3_pivot_topk": topk_search.op3_pivot_topk,
    "op4_water_filling": mixing.op4_water_filling,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_license_expressions": licenses.op6_license_expressions,
    "op7_relational_chat": chat_format.op7_relational_chat,
    "op8_piece_lattice": sentencepiece_lattice.op8_piece_lattice,
    "op9_column_bwt": substring_dedup.op9_column_bwt,
    "op10_bounded_ring": sharding.op10_bounded_ring,
}
QUERIES = {name: shipped(query) for name, query in QUERIES.items()}
ORACLES = {
    "op1_ngram_jaccard": ngram_join.OP1_SQL,
    "op3_pivot_topk": topk_search.OP3_SQL,
    "op4_water_filling": mixing.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_license_expressions": licenses.OP6_SQL,
    "op7_relational_chat": chat_format.OP7_SQL,
    "op9_column_bwt": substring_dedup.OP9_SQL,
}
