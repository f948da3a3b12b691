"""The registered queries of this subpackage and their SQL twins, where SQL can express them."""

from __future__ import annotations

from . import collocations, decontaminate, language, lexical, licences, neighbours, packing, quality, rans, repeats, secrets, simhash, suffix_tree


def queries() -> dict:
    return {
        "op1_suffix_tree": suffix_tree.op1_suffix_tree,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_simhash": simhash.op3_simhash,
        "op4_pack": packing.op4_pack,
        "op5_rans": rans.op5_rans,
        "op6_licences": licences.op6_licences,
        "op7_repeats": repeats.op7_repeats,
        "op8_secrets": secrets.op8_secrets,
        "op9_language": language.op9_language,
        "op10_quality": quality.op10_quality,
        "op11_ball_tree": lexical.op11_ball_tree,
        "op12_stripes": collocations.op12_stripes,
        "op13_posting_lists": neighbours.op13_posting_lists,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_licences": licences.oracle(), "op8_secrets": secrets.oracle(), "op11_ball_tree": lexical.oracle(), "op12_stripes": collocations.oracle()}
