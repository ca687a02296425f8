"""Queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from . import bitplanes, decontamination, htmltext, jaccard, linededup, mixing, periodic, pieces, pseudonyms, quality, spelling, topk, toxicity


def queries() -> dict:
    return {
        "op1_pivot_topk": topk.op1_pivot_topk,
        "op2_consensus_text": htmltext.op2_consensus_text,
        "op3_bitplane_tokens": bitplanes.op3_bitplane_tokens,
        "op4_quality_votes": quality.op4_quality_votes,
        "op5_raked_mixture": mixing.op5_raked_mixture,
        "op6_feistel_pseudonyms": pseudonyms.op6_feistel_pseudonyms,
        "op7_noisy_or_toxicity": toxicity.op7_noisy_or_toxicity,
        "op8_line_chunks": linededup.op8_line_chunks,
        "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
        "op10_positional_decontamination": decontamination.op10_positional_decontamination,
        "op11_piece_codec": pieces.op11_piece_codec,
        "op12_spelling_groups": spelling.op12_spelling_groups,
        "op13_periodic_runs": periodic.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_pivot_topk": topk.OP1_SQL, "op10_positional_decontamination": decontamination.OP10_SQL, "op12_spelling_groups": spelling.OP12_SQL}
