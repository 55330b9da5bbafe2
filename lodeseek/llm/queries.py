"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import covertree, decontaminate, html, lines, minhash, packing, quality, substrings, token_files, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        covertree.op1_cover_tree_top_k,
        toxicity.op2_mil_toxicity,
        quality.op3_factorisation_quality,
        lines.op4_winnowed_lines,
        substrings.op5_longest_previous_factor,
        packing.op6_best_two_fit_packing,
        token_files.op7_arrow_token_files,
        decontaminate.op8_simhash_decontamination,
        html.op9_site_style_tree,
        minhash.op10_minhash_near_dedup,
    )
}
ORACLES: dict[str, str] = {"op1_cover_tree_top_k": covertree.ORACLE, "op4_winnowed_lines": lines.ORACLE, "op8_simhash_decontamination": decontaminate.ORACLE, "op10_minhash_near_dedup": minhash.ORACLE}
