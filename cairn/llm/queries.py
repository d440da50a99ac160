"""The registered queries of this package, one per operator, and their SQL where it can say the same."""

from __future__ import annotations

from . import alignment, dartminhash, imatch, langid, lines, machine, mixing, periodic, pieces, quality, suffixes, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_curriculum_mix": mixing.op2_curriculum_mix,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_warc_salvage": warc.op4_warc_salvage,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_dartminhash": dartminhash.op7_dartminhash,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_language_id": langid.op9_language_id,
    "op10_imatch": imatch.op10_imatch,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_quality_machine": machine.op12_quality_machine,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

SQL = {
    "op2_curriculum_mix": mixing.SQL,
    "op4_warc_salvage": warc.SQL,
    "op5_line_dedup": lines.SQL,
    "op6_quality_rules": quality.SQL,
    "op10_imatch": imatch.SQL,
}
