"""Registered queries of the training-data operators, and SQL where it can express them."""

from . import conversation, decontaminate, exact_dedup, jaccard_join, line_dedup, lm_score, merkle, mixing, pii, quality, secret_scan, sharding, warc

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_mixing": mixing.op3_mixing,
    "op4_warc": warc.op4_warc,
    "op5_sharding": sharding.op5_sharding,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_quality": quality.op9_quality,
    "op10_pii": pii.op10_pii,
    "op11_merkle": merkle.op11_merkle,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_conversation": conversation.op13_conversation,
}

ORACLE_SQL = {
    "op3_mixing": mixing.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_line_dedup": line_dedup.OP12_SQL,
    "op13_conversation": conversation.OP13_SQL,
}
