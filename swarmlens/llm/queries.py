"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from swarmlens.llm import bpe, chat_format, hpyp, infill, jaccard_join, langid, line_dedup, merkle, minhash_join, quality_crf, substring_dedup, tiling, token_counts


def queries() -> dict:
    return {
        "op1_decontamination": tiling.op1,
        "op2_byte_bpe": bpe.op2,
        "op3_line_dedup": line_dedup.op3,
        "op4_language_id": langid.op4,
        "op5_quality_crf": quality_crf.op5,
        "op6_chat_format": chat_format.op6,
        "op7_jaccard_join": jaccard_join.op7,
        "op8_hpyp_scores": hpyp.op8,
        "op9_token_counts": token_counts.op9,
        "op10_substring_dedup": substring_dedup.op10,
        "op11_minhash_join": minhash_join.op11,
        "op12_merkle_manifest": merkle.op12,
        "op13_fill_in_middle": infill.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_format": chat_format.OP6_SQL, "op13_fill_in_middle": infill.OP13_SQL}
