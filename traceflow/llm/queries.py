"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them.

Read here, so that a module that isn't there is an error: only __spark_entry__.py may do without llm.
"""

from __future__ import annotations

from . import align, decontaminate, jaccard, langid, lines, neighbours, packing, runs, substring, suffix, tokenfile, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_substring_dedup": substring.op4_substring_dedup,
    "op5_suffix_dedup": suffix.op5_suffix_dedup,
    "op6_packing": packing.op6_packing,
    "op7_language": langid.op7_language,
    "op8_topk": topk.op8_topk,
    "op9_token_files": tokenfile.op9_token_files,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_neighbours": neighbours.op11_neighbours,
    "op12_runs": runs.op12_runs,
    "op13_align": align.op13_align,
}
ORACLE_SQL = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op3_jaccard": jaccard.OP3_SQL,
    "op8_topk": topk.OP8_SQL,
}
