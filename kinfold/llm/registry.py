"""Contract queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from kinfold.llm import chat, jaccard, knn, langid, licenses, media, mixing, packing, pii, toxicity


def queries() -> dict:
    return {
        "op1_matroska": media.op1_matroska,
        "op2_language": langid.op2_language,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_pseudonyms": pii.op4_pseudonyms,
        "op5_chat": chat.op5_chat,
        "op6_jaccard_join": jaccard.op6_jaccard_join,
        "op7_licenses": licenses.op7_licenses,
        "op8_top_k": knn.op8_top_k,
        "op9_mixing": mixing.op9_mixing,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat": chat.OP5_SQL, "op6_jaccard_join": jaccard.OP6_SQL, "op8_top_k": knn.OP8_SQL}
