"""Queries of the training-data operators, and SQL for those that SQL can express."""

from weft.llm import chat, decontaminate, mixing, pages, similar, substrings, surrogates, tokens, topk, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_topk": topk.op3_topk,
    "op4_html": pages.op4_html,
    "op5_repeats": substrings.op5_repeats,
    "op6_similar": similar.op6_similar,
    "op7_tokens": tokens.op7_tokens,
    "op8_chat": chat.op8_chat,
    "op9_mix": mixing.op9_mix,
    "op10_surrogates": surrogates.op10_surrogates,
}
SQL = {"op1_decontaminate": decontaminate.OP1_SQL, "op3_topk": topk.OP3_SQL, "op5_repeats": substrings.OP5_SQL, "op6_similar": similar.OP6_SQL, "op8_chat": chat.OP8_SQL, "op9_mix": mixing.OP9_SQL}
