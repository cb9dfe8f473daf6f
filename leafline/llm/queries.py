"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, jaccard, langid, mixing, phrases, secrets, sharding, tokens, topk, toxicity, variants, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_query,
    "op2_chat_snapshots": chat.op2_query,
    "op3_threshold_topk": topk.op3_query,
    "op4_language_spans": langid.op4_query,
    "op5_label_shards": sharding.op5_query,
    "op6_jaccard_groups": jaccard.op6_query,
    "op7_secret_trigrams": secrets.op7_query,
    "op8_suffix_decontamination": decontaminate.op8_query,
    "op9_warc_archives": warc.op9_query,
    "op10_toxicity_mil": toxicity.op10_query,
    "op11_phrase_collocations": phrases.op11_query,
    "op12_token_counts": tokens.op12_query,
    "op13_spelling_variants": variants.op13_query,
}

SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_chat_snapshots": chat.OP2_SQL,
    "op3_threshold_topk": topk.OP3_SQL,
    "op6_jaccard_groups": jaccard.OP6_SQL,
    "op7_secret_trigrams": secrets.OP7_SQL,
    "op8_suffix_decontamination": decontaminate.OP8_SQL,
    "op9_warc_archives": warc.OP9_SQL,
    "op11_phrase_collocations": phrases.OP11_SQL,
    "op13_spelling_variants": variants.OP13_SQL,
}
